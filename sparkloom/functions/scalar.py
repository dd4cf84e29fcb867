"""Scalar expressions; all are JVM-side Column builders (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient truncated towards zero; NULL for a zero divisor."""
    d = F.when(b != 0, b)
    return F.try_divide(a - F.try_mod(a, d), d).cast("bigint")


def lenient_cast(c: Column, to: str) -> Column:
    """NULL where the text does not parse, instead of an ANSI error."""
    return c.try_cast(to)


def add_months(d: Column, n: int) -> Column:
    """Calendar months, clipped to the month's last day."""
    return F.add_months(d, n)


def add_days(d: Column, n: int) -> Column:
    return F.date_add(d, n)


def days_between(later: Column, earlier: Column) -> Column:
    """Signed number of days, NULL if either is NULL."""
    return F.datediff(later, earlier).cast("bigint")


def extract(field: str, d: Column) -> Column:
    """YEAR, MONTH or DAY of a date as bigint."""
    f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}.get(field.upper())
    if f is None:
        raise ValueError(f"EXTRACT supports YEAR, MONTH and DAY, not {field}")
    return f(d).cast("bigint")


def substring(s: Column, start: int, length: int) -> Column:
    """SUBSTRING(s FROM start FOR length), 1-based characters."""
    if start < 1 or length < 0:
        raise ValueError("start is 1-based and length is not negative")
    return F.substring(s, start, length)


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    """Anchored SQL LIKE."""
    return F.like(s, F.lit(pattern), F.lit(escape))


def case_when(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """Searched CASE; NULL without a matching branch and ELSE."""
    out = F.when(*branches[0])
    for cond, value in branches[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def simple_case(operand: Column, branches: list[tuple[object, object]], otherwise: object = None) -> Column:
    """CASE operand WHEN v THEN r; a branch value None matches NULL."""
    pairs = [(operand.isNull() if v is None else operand == F.lit(v), F.lit(r)) for v, r in branches]
    return case_when(*pairs, otherwise=None if otherwise is None else F.lit(otherwise))
