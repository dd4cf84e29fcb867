"""Delimited text with a declared schema; any bad field aborts the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(f: T.StructField) -> Column:
    text = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))  # an empty field is the empty text
    if not f.nullable:  # there is no NULL here: a text stays as it is, any other type must parse
        return text.cast(f.dataType).alias(f.name)
    return F.when(text.isin("NULL", "null"), F.lit(None)).otherwise(text).cast(f.dataType).alias(f.name)


def import_csv(spark: SparkSession, schema: T.StructType, path: str, *, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Rows of ``path`` by position.

    The texts ``NULL`` and ``null`` are NULL in every nullable column.  Fields are
    read as text and cast strictly, so one that does not parse (an empty one too,
    but in a text column) raises when the row is read.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])
    df = spark.read.csv(path, schema=texts, sep=delimiter, header=header, nullValue="\0", emptyValue="", enforceSchema=True, mode="FAILFAST")
    return df.select([_field(f) for f in schema])
