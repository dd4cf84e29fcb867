"""SELECT text in, DataFrame out."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.catalog import Catalog
from sparkloom.sources.tables import register


class EngineError(ValueError):
    """The statement is not a supported query, or does not resolve."""


#: Spellings that other engines accept and Spark's parser does not.
REWRITES = [(re.compile(r"=\s*ANY\s*\(\s*(?=SELECT\b)", re.I), "IN ("), (re.compile(r"=\s*SOME\s*\(\s*(?=SELECT\b)", re.I), "IN (")]


def _outside_strings(sql: str, f) -> str:
    return "".join(x if i % 2 else f(x) for i, x in enumerate(re.split(r"('(?:[^']|'')*')", sql)))


def _rewrite(sql: str) -> str:
    for pattern, to in REWRITES:
        sql = pattern.sub(to, sql)
    return sql


class Engine:
    """Runs single SELECT statements over temp views or a persistent catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog

    def register_dir(self, sf_dir: str, names: list[str] | None = None) -> Engine:
        register(self.spark, sf_dir, names)
        return self

    def sql(self, text: str) -> DataFrame:
        if not re.match(r"\s*(SELECT|WITH|\()", text, re.I):
            raise EngineError("only a single SELECT query is supported")
        try:
            return self.spark.sql(_outside_strings(text, _rewrite))
        except (AnalysisException, ParseException) as e:
            raise EngineError(str(e).splitlines()[0]) from e

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The physical plan as text."""
        df = self.sql(text)
        return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
