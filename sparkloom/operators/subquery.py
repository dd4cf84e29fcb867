"""Subqueries as joins, with SQL's three-valued results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(outer: DataFrame, inner: DataFrame, on: Column | None = None, negate: bool = False) -> DataFrame:
    """EXISTS / NOT EXISTS; without ``on`` the subquery is uncorrelated."""
    if on is None:
        inner, on = inner.select(F.lit(1).alias("_one")).limit(1), F.lit(True)
    return outer.join(inner, on, "left_anti" if negate else "left_semi")


def in_subquery(outer: DataFrame, key: str, inner: DataFrame, inner_key: str) -> DataFrame:
    return outer.join(inner.select(F.col(inner_key).alias("_in")), F.col(key) == F.col("_in"), "left_semi")


def not_in_subquery(outer: DataFrame, key: str, inner: DataFrame, inner_key: str) -> DataFrame:
    """NOT IN: no row qualifies once the subquery holds a NULL."""
    marked = mark_join(outer, key, inner, inner_key, mark="_mark")
    return marked.filter(~F.col("_mark")).drop("_mark")


def mark_join(outer: DataFrame, key: str, inner: DataFrame, inner_key: str, mark: str = "mark") -> DataFrame:
    """Every outer row with ``key IN (inner)`` as TRUE, FALSE or NULL.

    The inner side shrinks to its distinct keys; whether it has rows and NULLs
    is a one-row aggregate, so only that row is sent to every task.
    """
    keys = inner.select(F.col(inner_key).alias("_k"))
    facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_nn"))
    hits = keys.filter(F.col("_k").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    out = outer.join(hits, F.col(key) == F.col("_k"), "left_outer").join(F.broadcast(facts), F.lit(True), "inner")
    value = (
        F.when(F.col("_n") == 0, F.lit(False))
        .when(F.col("_hit"), F.lit(True))
        .when(F.col(key).isNull() | (F.col("_n") > F.col("_nn")), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    return out.withColumn(mark, value).drop("_k", "_hit", "_n", "_nn")


def right_mark_join(inner: DataFrame, inner_key: str, outer: DataFrame, key: str, mark: str = "mark") -> DataFrame:
    """The mark join with its sides swapped: every row of the right side, marked by the left one."""
    return mark_join(outer, key, inner, inner_key, mark)


def any_compare(outer: DataFrame, key: str, op: str, inner: DataFrame, inner_key: str, mark: str = "mark", on: tuple[str, str] | None = None) -> DataFrame:
    """``key op ANY (inner)`` as a three-valued column, from MIN, MAX and NULL facts.

    ``on``: (outer column, inner column) that a correlated subquery equates; the
    facts are then those of each group of the inner column.
    """
    if op == "=" and on is None:
        return mark_join(outer, key, inner, inner_key, mark)
    v, k, lo, hi, n = F.col(inner_key), F.col(key), F.col("_lo"), F.col("_hi"), F.coalesce("_n", F.lit(0))
    facts = [F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(v).alias("_nn")]
    tests = {"<": k < hi, "<=": k <= hi, ">": k > lo, ">=": k >= lo, "<>": (k != lo) | (k != hi), "=": F.col("_hit")}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    value = (
        F.when(n == 0, F.lit(False))
        .when(F.coalesce(tests[op], F.lit(False)), F.lit(True))
        .when(k.isNull() | (n > F.col("_nn")), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    if on is None:
        out = outer.join(F.broadcast(inner.agg(*facts)), F.lit(True))
    else:
        group = F.col(on[1]).alias("_on")
        out = outer.join(inner.groupBy(group).agg(*facts), F.col(on[0]) == F.col("_on"), "left_outer").drop("_on")
        if op == "=":
            hits = inner.filter(v.isNotNull()).select(group, v.alias("_k")).distinct().withColumn("_hit", F.lit(True))
            out = out.join(hits, (F.col(on[0]) == F.col("_on")) & (k == F.col("_k")), "left_outer").drop("_on")
    return out.withColumn(mark, value).drop("_lo", "_hi", "_n", "_nn", "_k", "_hit")


def scalar_correlated(outer: DataFrame, inner: DataFrame, key: str, inner_key: str, agg: Column, name: str) -> DataFrame:
    """One value per outer row, NULL where the subquery is empty."""
    grouped = inner.groupBy(F.col(inner_key).alias("_key")).agg(agg.alias(name))
    return outer.join(grouped, F.col(key) == F.col("_key"), "left_outer").drop("_key")


def count_correlated(outer: DataFrame, inner: DataFrame, key: str, inner_key: str, name: str) -> DataFrame:
    """A correlated COUNT(*): 0, not NULL, where nothing matches."""
    out = scalar_correlated(outer, inner, key, inner_key, F.count(F.lit(1)), name)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
