"""CREATE TABLE text -> declared schema and primary key.

Type mapping: every integer is 64 bit, FLOAT/DOUBLE/DECIMAL are doubles
(precision and scale are accepted and ignored), CHAR/VARCHAR/TEXT are strings
without padding or truncation.  Exactly one primary key, inline or as a table
constraint, is required; it is metadata, not an enforced constraint.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

SQL_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "INT": T.LongType(),
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DoubleType(),
    "TEXT": T.StringType(),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
}


class DdlError(ValueError):
    """A CREATE TABLE statement outside the supported subset."""


@dataclass(frozen=True)
class TableDecl:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]


def _split_top_level(body: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]] if p.strip()]


def parse_create_table(sql: str) -> TableDecl:
    m = re.fullmatch(r"\s*CREATE\s+TABLE\s+([A-Za-z_]\w*)\s*\((.*)\)\s*;?\s*", sql, re.I | re.S)
    if not m:
        raise DdlError("expected CREATE TABLE name (columns)")
    fields: list[T.StructField] = []
    keys: list[tuple[str, ...]] = []
    for item in _split_top_level(m[2]):
        if pk := re.fullmatch(r"PRIMARY\s+KEY\s*\((.*)\)", item, re.I | re.S):
            keys.append(tuple(c.strip() for c in pk[1].split(",")))
            continue
        col = re.fullmatch(r"([A-Za-z_]\w*)\s+([A-Za-z]+)\s*(?:\([\d\s,]*\))?\s*(.*)", item, re.S)
        if not col or col[2].upper() not in SQL_TYPES:
            raise DdlError(f"unsupported column definition: {item!r}")
        options = " ".join(col[3].upper().split())
        rest = options.replace("PRIMARY KEY", "").replace("NOT NULL", "").replace("NULL", "").strip()
        if rest:
            raise DdlError(f"unsupported column option {rest!r}")
        if "PRIMARY KEY" in options:
            keys.append((col[1],))
        fields.append(T.StructField(col[1], SQL_TYPES[col[2].upper()], "NOT NULL" not in options))
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise DdlError("a column name is declared twice")
    if len(keys) != 1:
        raise DdlError(f"exactly one primary key is required, found {len(keys)}")
    if unknown := [k for k in keys[0] if k not in names]:
        raise DdlError(f"primary key names unknown columns {unknown}")
    return TableDecl(m[1], T.StructType(fields), keys[0])
