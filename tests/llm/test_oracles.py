"""The corpus queries against their SQL, over a whole small table and over odd rows."""

import duckdb
import pytest
from helpers import SCHEMA, corpus

from sparkloom.llm import queries

DIR = "/root/testdata/sf0.001"
ODD = [(None, None, "", 0, ""), (None, "a b c", "", 0, ""), (5, "a b c", "", 0, ""), (5, "a b c", "", 0, ""), (7, "\x0b\t", "", 0, ""), (8, "É é Z z", "", 0, "")]


def both(spark, d, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'' if d == DIR else '/*.parquet'}')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, d)
    assert sorted(names) == sorted(got.columns)
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_table(spark, name):
    got, want = both(spark, DIR, name)
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows(spark, tmp_path, name):
    rows = corpus(21) + ODD
    text = next(r[1] for r in rows if r[1] and len(r[1].split()) > 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    items = [("i", " ".join(text.split()[3:25])), ("s", "b c"), (None, "a"), ("n", None), ("e", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    urls = [(1, "http://A.com/en/x?q"), (None, None), (1, "http://A.com/en/x?q"), (2, "x"), (3, "z://example.com/en/7")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, str(tmp_path), name)
    assert got == want
