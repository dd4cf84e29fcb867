"""The relational algebra as thin functions over DataFrames.

Nothing here forces a physical strategy: no broadcast hints, repartitions or
caches, so Catalyst pushes filters and columns into scans and AQE picks join
strategies, coalesces partitions and splits skewed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: engine name -> (Spark's join type, swap the inputs first)
JOIN_TYPES = {
    "inner": ("inner", False),
    "cross": ("cross", False),
    "left": ("left_outer", False),
    "right": ("right_outer", False),
    "full": ("full_outer", False),
    "left_semi": ("left_semi", False),
    "left_anti": ("left_anti", False),
    "right_semi": ("left_semi", True),
    "right_anti": ("left_anti", True),
}


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is TRUE (three-valued logic)."""
    for c in conditions:
        df = df.filter(c)
    return df


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def map_columns(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner") -> DataFrame:
    """Any join of ``JOIN_TYPES``; right semi and anti keep the right side's columns.

    The ON condition of an outer join only decides matches; it never filters
    the preserved side.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    kind, swap = JOIN_TYPES[how]
    if swap:
        left, right = right, left
    return left.crossJoin(right) if on is None and kind == "cross" else left.join(right, on, kind)


def aggregate(df: DataFrame, keys: list[str | Column], *aggs: Column, having: Column | None = None) -> DataFrame:
    """GROUP BY with optional HAVING; no keys means one row, even for no input."""
    out = df.groupBy(*keys).agg(*aggs)
    return out if having is None else out.filter(having)


def order_by(df: DataFrame, *keys: tuple[str | Column, str] | str | Column, nulls_first: bool = False) -> DataFrame:
    """Sort by (key, 'asc'|'desc') pairs; NULLS LAST in both directions by default."""
    out = []
    for k in keys:
        key, way = k if isinstance(k, tuple) else (k, "asc")
        c = F.col(key) if isinstance(key, str) else key
        out.append(getattr(c, f"{way}_nulls_{'first' if nulls_first else 'last'}")())
    return df.orderBy(*out)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, k: int, *keys: tuple[str | Column, str] | str | Column) -> DataFrame:
    """ORDER BY ... LIMIT k: planned as TakeOrderedAndProject, k rows a task."""
    return order_by(df, *keys).limit(k)
