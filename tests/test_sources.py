"""CREATE TABLE, CSV import and the persistent catalog."""

import datetime

import pytest

from sparkloom import Engine
from sparkloom.sources import Catalog, parse_create_table
from sparkloom.sources.catalog import CatalogError
from sparkloom.sources.ddl import DdlError

DDL = "CREATE TABLE people (name VARCHAR(20) NOT NULL, age INTEGER, city TEXT, born DATE, pay DECIMAL(15,2), PRIMARY KEY (name, age))"


def test_ddl():
    d = parse_create_table(DDL)
    assert [f.dataType.simpleString() for f in d.schema] == ["string", "bigint", "string", "date", "double"]
    assert d.primary_key == ("name", "age") and not d.schema["name"].nullable and d.schema["age"].nullable
    assert parse_create_table("create table t (a int primary key)").primary_key == ("a",)
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE t (a BLOB PRIMARY KEY)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "SELECT 1"):
        with pytest.raises(DdlError):
            parse_create_table(bad)


def test_catalog_round_trip(spark, tmp_path):
    cat = Catalog.create(spark, str(tmp_path / "db"))
    cat.create_table(DDL)
    with pytest.raises(CatalogError):
        cat.create_table(DDL)
    (tmp_path / "q.csv").write_text("Eve,1,x,2001-01-01,3\n")
    cat.import_csv("people", str(tmp_path / "q.csv"), header=False)
    again = Catalog.load(spark, str(tmp_path / "db"))
    assert again.get("people") == cat.get("people")
    row = Engine(spark, again).sql("SELECT name, age, born FROM people").first()
    assert tuple(row) == ("Eve", 1, datetime.date(2001, 1, 1))
    again.drop_table("people")
    assert Catalog.load(spark, str(tmp_path / "db")).names() == []
    assert not (tmp_path / "db" / "people").exists()
    again.create_table(DDL)  # a dropped name is free again, and empty
    assert again.table("people").count() == 0
    with pytest.raises(CatalogError):
        Catalog.create(spark, str(tmp_path / "db"))
    assert Catalog.load(spark, str(tmp_path / "db")).names() == ["people"]


def test_csv_nulls_and_failures(spark, tmp_path):
    from sparkloom.sources import import_csv

    schema = parse_create_table("CREATE TABLE t (a INT PRIMARY KEY, b TEXT)").schema
    (tmp_path / "a.csv").write_text("a|b\n1|NULL\n2|null\n3|x\n")
    assert [r.b for r in import_csv(spark, schema, str(tmp_path / "a.csv"), delimiter="|").orderBy("a").collect()] == [None, None, "x"]
    (tmp_path / "b.csv").write_text("a|b\nx|y\n")
    with pytest.raises(Exception):
        import_csv(spark, schema, str(tmp_path / "b.csv"), delimiter="|").collect()
    strict = parse_create_table("CREATE TABLE t (a INT PRIMARY KEY, b TEXT NOT NULL)").schema
    assert [r.b for r in import_csv(spark, strict, str(tmp_path / "a.csv"), delimiter="|").orderBy("a").collect()] == ["NULL", "null", "x"]
    wide = parse_create_table("CREATE TABLE t (a INT PRIMARY KEY, b INT, c DATE, d FLOAT, e TEXT)").schema
    (tmp_path / "c.csv").write_text("1,null,NULL,null,\n2,7,2001-02-03,1.5,NULL\n")
    got = [tuple(r) for r in import_csv(spark, wide, str(tmp_path / "c.csv"), header=False).orderBy("a").collect()]
    assert got == [(1, None, None, None, ""), (2, 7, datetime.date(2001, 2, 3), 1.5, None)]
    (tmp_path / "d.csv").write_text("null,1,2001-01-01,1,x\n")
    assert import_csv(spark, wide, str(tmp_path / "d.csv"), header=False).first().a is None
    keyed = parse_create_table("CREATE TABLE t (a INT NOT NULL, b INT, c DATE, d FLOAT, e TEXT, PRIMARY KEY (a))").schema
    with pytest.raises(Exception):
        import_csv(spark, keyed, str(tmp_path / "d.csv"), header=False).collect()
