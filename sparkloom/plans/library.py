"""Registered queries: each operator of the inventory once, beside its oracle.

``SHARED`` holds texts that both engines run as they stand.  ``BUILT`` holds
DataFrame compositions, each next to the SQL that states the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import functions as S
from sparkloom import operators as O
from sparkloom.plans.engine import Engine
from sparkloom.plans.tpch import OWN, TPCH
from sparkloom.sources.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]

SHARED: dict[str, str] = {
    # projections, filters and predicates
    "proj_columns": "SELECT c_custkey, c_name FROM customer",
    "proj_same_column_twice": "SELECT c_custkey AS a, c_custkey AS b FROM customer",
    "proj_star": "SELECT * FROM nation",
    "proj_table_star": "SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey",
    "proj_alias": "SELECT p_name AS title, p_size AS size_1 FROM part",
    "pred_comparisons": "SELECT o_orderkey, o_totalprice = 1000.0 AS eq, o_orderkey <> 5 AS ne, o_totalprice < 2000.0 AS lt, o_totalprice >= 2000.0 AS ge FROM orders",
    "pred_and_or_not": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 OR l_discount > 0.09) AND NOT (l_returnflag = 'R' AND l_linestatus = 'F')",
    "pred_three_valued_logic": "SELECT c_custkey, (n > 5 AND c_custkey < 0) AS a, (n > 5 OR c_custkey >= 0) AS o, NOT (n > 5) AS x FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS n FROM customer) t",
    "pred_is_null": "SELECT c_custkey, n IS NULL AS is_null, n IS NOT NULL AS is_not_null FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS n FROM customer) t",
    "pred_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20",
    "pred_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20",
    "pred_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "pred_not_in_list_null": "SELECT c_custkey, n NOT IN (1, 2) AS out_of_list FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS n FROM customer) t",
    "pred_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%' OR p_name LIKE '%ring' OR p_name LIKE '_ed %'",
    "pred_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%M%'",
    "pred_like_escape": "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'",
    "pred_case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS size_class FROM part",
    "pred_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    # joins written in SQL
    "join_comma_where": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_self_alias": "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_residual_on_outer": "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 48 AND o_orderstatus = 'F'",
    "join_or_common_equality": "SELECT n_name, s_name FROM nation, supplier WHERE (n_nationkey = s_nationkey AND n_regionkey = 1) OR (n_nationkey = s_nationkey AND s_acctbal < 0)",
    # aggregates written in SQL
    "agg_group_by_alias": "SELECT o_orderstatus AS st, COUNT(*) AS n FROM orders GROUP BY st",
    "agg_group_by_expression": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)",
    "agg_expression_over_aggregates": "SELECT l_returnflag, CAST(100 * SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS pct FROM lineitem GROUP BY l_returnflag",
    "agg_having_scalar_subquery": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT o_custkey) FROM orders)",
    "agg_null_keys_and_values": "SELECT n, COUNT(*) AS rows_, COUNT(b) AS vals, MIN(b) AS lo, MAX(b) AS hi FROM (SELECT NULLIF(c_nationkey, 3) AS n, NULLIF(c_mktsegment, 'BUILDING') AS b FROM customer) t GROUP BY n",
    # sorting
    "sort_expression": "SELECT p_partkey, p_size FROM part ORDER BY p_size * -1 DESC NULLS LAST, p_partkey NULLS LAST",
    "sort_aggregate": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC NULLS LAST, o_custkey NULLS LAST",
    # subqueries
    "sub_derived_table_aliases": "SELECT k, n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS t(k, n) WHERE n > 10",
    "sub_cte_used_twice": "WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a, (SELECT MAX(n) AS m FROM t) b WHERE a.n = b.m",
    "sub_cte_column_list": "WITH t(k, n) AS (SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey) SELECT k, n FROM t",
    "sub_scalar_where": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
    "sub_scalar_select_list": "SELECT n_name, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation",
    "sub_scalar_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sub_scalar_correlated_count_zero": "SELECT o_orderkey FROM orders WHERE 0 = (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey)",
    "sub_exists_correlated": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "sub_exists_uncorrelated": "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey = 3)",
    "sub_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey)",
    "sub_not_exists_uncorrelated": "SELECT r_name FROM region WHERE NOT EXISTS (SELECT * FROM nation WHERE n_nationkey = 99)",
    "join_comma_theta": "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_acctbal < n_nationkey * 100",
    "sort_ordinal": "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY 1 NULLS LAST, 2 DESC NULLS LAST",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sub_in_or": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR c_acctbal < 0",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "sub_not_in_with_null": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation WHERE n_regionkey = 3)",
    "sub_any_equal": "SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sub_lateral": "SELECT n_name, n, total FROM nation, LATERAL (SELECT COUNT(*) AS n, SUM(s_suppkey) AS total FROM supplier WHERE s_nationkey = n_nationkey) t",
    # scalar functions
    "fn_arithmetic": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus_, l_quantity - l_discount AS minus_, l_quantity * l_tax AS times_, l_extendedprice / l_quantity AS over_ FROM lineitem",
    "fn_interval_arithmetic": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-31' + INTERVAL '1' MONTH AND o_orderdate < DATE '1999-01-01' - INTERVAL '10' DAY + INTERVAL '1' YEAR",
    "fn_extract": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "fn_substring": "SELECT c_custkey, SUBSTRING(c_name FROM 2 FOR 4) AS piece FROM customer",
    "fn_cast": "SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR(20)) AS s, CAST(FLOOR(c_acctbal) AS BIGINT) AS i FROM customer",
    # extras that the engine gets from Spark
    "extra_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "extra_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
}


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _join(left: str, right: str, on: str, cols: list[str], how: str, lfilter: str = "true", rfilter: str = "true") -> Query:
    def run(spark, d):
        a, b = _t(spark, d, left, right)
        return O.join(a.filter(lfilter), b.filter(rfilter), F.expr(on) if on else None, how).select(*cols)

    return run


def _nulled(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.nullif(F.col(name), F.lit(value)))


def _mark(spark, d, op="="):
    cust, nat = _t(spark, d, "customer", "nation")
    inner = _nulled(nat.filter("n_regionkey = 3"), "n_nationkey", 3)
    return O.any_compare(_nulled(cust, "c_nationkey", 7), "c_nationkey", op, inner, "n_nationkey").select("c_custkey", "mark")


def _right_mark(spark, d):
    cust, nat = _t(spark, d, "customer", "nation")
    inner = _nulled(nat.filter("n_regionkey = 3"), "n_nationkey", 3)
    return O.right_mark_join(inner, "n_nationkey", _nulled(cust, "c_nationkey", 7), "c_nationkey").select("c_custkey", "mark")


def _any_sql(op: str) -> str:
    return f"SELECT c_custkey, NULLIF(c_nationkey, 7) {op} ANY (SELECT NULLIF(n_nationkey, 3) FROM nation WHERE n_regionkey = 3) AS mark FROM customer"


def _mark_correlated(spark, d, op):
    cust, supp = (_nulled(x.withColumn("size", F.floor(bal).cast("long") % 10), "size", 3) for x, bal in zip(_t(spark, d, "customer", "supplier"), ("c_acctbal", "s_acctbal"), strict=True))
    return O.any_compare(cust, "size", op, supp.withColumnRenamed("size", "s_size"), "s_size", on=("c_nationkey", "s_nationkey")).select("c_custkey", "mark")


def _any_correlated_sql(op: str) -> str:
    size = "NULLIF(CAST(floor({}_acctbal) AS BIGINT) % 10, 3)"
    return f"SELECT c_custkey, {size.format('c')} {op} ANY (SELECT {size.format('s')} FROM supplier WHERE s_nationkey = c_nationkey) AS mark FROM customer"


LO = "l_orderkey = o_orderkey"
BUILT: dict[str, tuple[Query, str]] = {
    "scan_pruned": (lambda s, d: O.project(table(s, d, "lineitem"), "l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem"),
    "scan_filtered": (
        lambda s, d: O.select(table(s, d, "lineitem"), F.col("l_quantity") > 45, F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity"),
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate < DATE '1996-01-01'",
    ),
    "proj_computed": (
        lambda s, d: O.map_columns(table(s, d, "part"), next_size=F.col("p_size") + 1).select("p_partkey", "next_size"),
        "SELECT p_partkey, p_size + 1 AS next_size FROM part",
    ),
    "proj_rename": (lambda s, d: O.rename(table(s, d, "region"), {"r_name": "name"}), "SELECT r_regionkey, r_name AS name FROM region"),
    "pred_simple_case_null": (
        lambda s, d: _nulled(table(s, d, "customer"), "c_nationkey", 3).select("c_custkey", S.simple_case(F.col("c_nationkey"), [(None, "none"), (1, "one")], "other").alias("c")),
        "SELECT c_custkey, CASE WHEN NULLIF(c_nationkey, 3) IS NULL THEN 'none' WHEN c_nationkey = 1 THEN 'one' ELSE 'other' END AS c FROM customer",
    ),
    "join_inner": (_join("orders", "lineitem", LO, ["o_orderkey", "l_linenumber", "o_custkey"], "inner"), f"SELECT o_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON {LO}"),
    "join_inner_residual": (
        _join("orders", "lineitem", LO + " AND l_extendedprice > o_totalprice", ["o_orderkey", "l_linenumber"], "inner"),
        f"SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON {LO} AND l_extendedprice > o_totalprice",
    ),
    "join_theta": (
        _join("supplier", "nation", "s_acctbal < n_nationkey * 100", ["s_suppkey", "n_nationkey"], "inner"),
        "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal < n_nationkey * 100",
    ),
    "join_left_outer": (_join("orders", "lineitem", LO, ["o_orderkey", "l_linenumber"], "left", rfilter="l_quantity > 40"), f"SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) l ON {LO}"),
    "join_right_outer": (_join("lineitem", "orders", LO, ["o_orderkey", "l_linenumber"], "right", lfilter="l_quantity > 40"), f"SELECT o_orderkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 40) l RIGHT JOIN orders ON {LO}"),
    "join_full_outer": (
        _join("supplier", "nation", "s_nationkey = n_nationkey AND s_acctbal > 5000", ["s_suppkey", "n_nationkey"], "full"),
        "SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    ),
    "join_left_semi": (_join("orders", "lineitem", LO, ["o_orderkey"], "left_semi"), f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE {LO})"),
    "join_left_anti": (_join("orders", "lineitem", LO, ["o_orderkey"], "left_anti"), f"SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE {LO})"),
    "join_right_semi": (_join("lineitem", "orders", LO, ["o_orderkey"], "right_semi"), f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE {LO})"),
    "join_right_anti": (_join("lineitem", "orders", LO, ["o_orderkey"], "right_anti"), f"SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE {LO})"),
    "join_cross": (_join("nation", "region", "", ["n_name", "r_name"], "cross"), "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_mark": (_mark, _any_sql("=")),
    "join_right_mark": (_right_mark, _any_sql("=")),
    "sub_any_greater": (lambda s, d: _mark(s, d, ">"), _any_sql(">")),
    "sub_any_less_equal": (lambda s, d: _mark(s, d, "<="), _any_sql("<=")),
    "sub_any_less": (lambda s, d: _mark(s, d, "<"), _any_sql("<")),
    "sub_any_greater_equal": (lambda s, d: _mark(s, d, ">="), _any_sql(">=")),
    "sub_any_not_equal": (lambda s, d: _mark(s, d, "<>"), _any_sql("<>")),
    **{f"sub_any_correlated_{name}": (lambda s, d, op=op: _mark_correlated(s, d, op), _any_correlated_sql(op)) for name, op in (("equal", "="), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">="), ("not_equal", "<>"))},
    "sub_not_in_mark": (
        lambda s, d: O.not_in_subquery(table(s, d, "customer"), "c_nationkey", table(s, d, "supplier").filter("s_acctbal < 0"), "s_nationkey").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    ),
    "sub_count_bug": (
        lambda s, d: O.count_correlated(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey", "n").select("o_orderkey", "n"),
        "SELECT o_orderkey, (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders",
    ),
    "agg_functions": (
        lambda s, d: O.aggregate(table(s, d, "lineitem"), ["l_returnflag"], F.sum("l_linenumber").alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_quantity").alias("lo"), F.max("l_shipdate").alias("hi"), F.count("l_tax").alias("c"), F.count(F.lit(1)).alias("n")),
        "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_quantity) AS lo, MAX(l_shipdate) AS hi, COUNT(l_tax) AS c, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_global": (
        lambda s, d: O.aggregate(table(s, d, "orders"), [], F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi")),
        "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders",
    ),
    "agg_global_empty": (
        lambda s, d: O.aggregate(table(s, d, "orders").filter("o_orderkey < 0"), [], F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi")),
        "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0",
    ),
    "agg_grouped_empty": (
        lambda s, d: O.aggregate(table(s, d, "orders").filter("o_orderkey < 0"), ["o_orderstatus"], F.count(F.lit(1)).alias("n")),
        "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus",
    ),
    "agg_having": (
        lambda s, d: O.aggregate(table(s, d, "orders"), ["o_custkey"], F.count(F.lit(1)).alias("n"), having=F.col("n") > 12),
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    ),
    "agg_count_distinct": (
        lambda s, d: O.aggregate(table(s, d, "lineitem"), ["l_returnflag"], F.count_distinct("l_suppkey").alias("n")),
        "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "sort_nulls_last": (
        lambda s, d: O.order_by(_nulled(table(s, d, "customer"), "c_nationkey", 3).select("c_custkey", "c_nationkey"), ("c_nationkey", "desc"), "c_custkey"),
        "SELECT c_custkey, NULLIF(c_nationkey, 3) AS c_nationkey FROM customer ORDER BY 2 DESC NULLS LAST, 1",
    ),
    "sort_nulls_first": (
        lambda s, d: O.order_by(_nulled(table(s, d, "customer"), "c_nationkey", 3).select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", nulls_first=True),
        "SELECT c_custkey, NULLIF(c_nationkey, 3) AS c_nationkey FROM customer ORDER BY 2 NULLS FIRST, 1",
    ),
    "limit_top_k": (
        lambda s, d: O.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", "desc"), "o_orderkey"),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    ),
    "limit_offset": (
        lambda s, d: O.limit(O.order_by(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), 10, 20),
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    ),
    "fn_int_div": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", S.int_div(F.col("o_orderkey"), F.lit(7)).alias("q")),
        "SELECT o_orderkey, o_orderkey // 7 AS q FROM orders",
    ),
    "fn_lenient_cast": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", S.lenient_cast(F.substring("n_name", 8, 2), "int").alias("i"), S.lenient_cast(F.col("n_name"), "int").alias("bad")),
        "SELECT n_nationkey, TRY_CAST(SUBSTRING(n_name, 8, 2) AS INTEGER) AS i, TRY_CAST(n_name AS INTEGER) AS bad FROM nation",
    ),
    "fn_lenient_cast_kinds": (
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", S.lenient_cast(F.col("o_orderdate").cast("date").cast("string"), "date").alias("d"), S.lenient_cast(F.col("o_orderstatus"), "date").alias("no_date"),
            S.lenient_cast(F.col("o_orderkey").cast("string"), "double").alias("x"), S.lenient_cast(F.col("o_orderpriority"), "double").alias("no_x"), F.col("o_orderdate").cast("date").cast("string").alias("t"),
        ),
        """SELECT o_orderkey, TRY_CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS DATE) AS d, TRY_CAST(o_orderstatus AS DATE) AS no_date, TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS x,
 TRY_CAST(o_orderpriority AS DOUBLE) AS no_x, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS t FROM orders""",
    ),
    "fn_days_between": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", S.days_between(F.col("o_orderdate").cast("date"), F.lit("1995-06-01").cast("date")).alias("n")),
        "SELECT o_orderkey, date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) AS n FROM orders",
    ),
    "fn_add_months_days": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", S.add_months(F.col("o_orderdate").cast("date"), 1).alias("m"), S.add_days(F.col("o_orderdate").cast("date"), -10).alias("t")),
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(o_orderdate AS DATE) - 10 AS t FROM orders",
    ),
    "fn_string_concat": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("/"), "n_name").alias("c")),
        "SELECT n_nationkey, n_name || '/' || n_name AS c FROM nation",
    ),
}


def _sql_query(text: str) -> Query:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, d: Engine(spark).register_dir(d, names).sql(text)


def queries() -> dict[str, Query]:
    return {k: _sql_query(v) for k, v in {**SHARED, **TPCH, **OWN}.items()} | {k: f for k, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {**SHARED, **TPCH, **{k: sql for k, (_, sql) in BUILT.items()}}
