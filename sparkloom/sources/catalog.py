"""A small persistent catalog: declared tables stored as parquet beside JSON schemas.

All file access goes through Spark, so the database directory may be in any
store that Spark reaches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.sources.csv_loader import import_csv
from sparkloom.sources.ddl import TableDecl, parse_create_table


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]


class CatalogError(ValueError):
    """Unknown or repeated table."""


class Catalog:
    """Named tables of one database directory, visible as temp views."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._tables = spark, path.rstrip("/"), {}

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Catalog:
        """A new database; one that is there already stays as it is."""
        cat = cls(spark, path)
        p, fs = cat._file("_catalog")
        if fs.exists(p):
            raise CatalogError(f"database {cat.path} exists")
        cat._save()
        return cat

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        cat = cls(spark, path)
        for row in spark.read.schema("name string, spec string").json(f"{cat.path}/_catalog").collect():
            spec = json.loads(row.spec)
            cat._tables[row.name] = TableDef(row.name, T.StructType.fromJson(spec["schema"]), tuple(spec["key"]))
        for name in cat._tables:
            cat._view(name)
        return cat

    def create_table(self, ddl: str | TableDecl) -> TableDef:
        decl = parse_create_table(ddl) if isinstance(ddl, str) else ddl
        if decl.name in self._tables:
            raise CatalogError(f"table {decl.name} exists")
        self._tables[decl.name] = TableDef(decl.name, decl.schema, decl.primary_key)
        # files of this name can only be left from a drop that did not end
        self._write(decl.name, self.spark.createDataFrame([], decl.schema), "overwrite")
        self._save()
        return self._tables[decl.name]

    def import_csv(self, name: str, path: str, *, header: bool = True, delimiter: str = ",") -> None:
        t = self.get(name)
        self._write(name, import_csv(self.spark, t.schema, path, header=header, delimiter=delimiter), "append")

    def insert(self, name: str, df: DataFrame) -> None:
        t = self.get(name)
        self._write(name, df.select([df[f.name].cast(f.dataType) for f in t.schema]), "append")

    def drop_table(self, name: str) -> None:
        """Forgets the table, then deletes its files."""
        self.get(name)
        del self._tables[name]
        self.spark.catalog.dropTempView(name)
        self._save()
        p, fs = self._file(name)
        fs.delete(p, True)

    def get(self, name: str) -> TableDef:
        if name not in self._tables:
            raise CatalogError(f"no table {name}")
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.get(name).schema).parquet(f"{self.path}/{name}")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")
        self._view(name)

    def _view(self, name: str) -> None:
        self.table(name).createOrReplaceTempView(name)

    def _save(self) -> None:
        rows = [(t.name, json.dumps({"schema": json.loads(t.schema.json()), "key": list(t.primary_key)})) for t in self._tables.values()]
        self.spark.createDataFrame(rows, "name string, spec string").coalesce(1).write.mode("overwrite").json(f"{self.path}/_catalog")
