"""The decision-support workload, adapted to the available tables.

Money sums run in DECIMAL and are cast to DOUBLE at the end, so results do not
depend on the order of addition.  One text serves Spark and the oracle, but for
those in ``OWN``.  The texts are those of a public benchmark (fixed values),
adapted to the tables at hand; partsupp is derived from lineitem.
"""

REV = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DOUBLE)"
PS = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS ps_availqty,
 MIN(FLOOR(l_extendedprice * 100 / l_quantity) / 100.0) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""

TPCH = {
    "tpch_q01": """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS sum_qty,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS sum_base_price, {REV} AS sum_disc_price,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) * (1 + CAST(l_tax AS DECIMAL(15,2)))) AS DOUBLE) AS sum_charge,
 ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 6) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc,
 COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '2001-09-02'
 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag NULLS LAST, l_linestatus NULLS LAST""",
    "tpch_q02": """SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, {PS} partsupp, nation, region
 WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_name LIKE '%ring' AND s_nationkey = n_nationkey
 AND n_regionkey = r_regionkey AND r_name = 'EUROPE' AND ps_supplycost = (SELECT MIN(ps_supplycost)
 FROM {PS} ps2, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey
 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
 ORDER BY s_acctbal DESC NULLS LAST, n_name NULLS LAST, s_name NULLS LAST, p_partkey NULLS LAST""",
    "tpch_q03": """SELECT l_orderkey, {REV} AS revenue, o_orderdate FROM customer, orders, lineitem
 WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
 AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate
 ORDER BY revenue DESC NULLS LAST, o_orderdate NULLS LAST""",
    "tpch_q04": """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1998-07-01'
 AND o_orderdate < DATE '1998-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
 GROUP BY o_orderpriority ORDER BY o_orderpriority NULLS LAST""",
    "tpch_q05": """SELECT n_name, {REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1998-01-01'
 AND o_orderdate < DATE '1998-01-01' + INTERVAL '1' YEAR GROUP BY n_name ORDER BY revenue DESC NULLS LAST""",
    "tpch_q06": """SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE) AS revenue
 FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-01-01' + INTERVAL '1' YEAR
 AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": """SELECT supp_nation, cust_nation, l_year, CAST(SUM(volume) AS DOUBLE) AS revenue FROM
 (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year,
 CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS volume
 FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey
 AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
 AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) AS shipping
 GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation NULLS LAST, cust_nation NULLS LAST, l_year NULLS LAST""",
    "tpch_q08": """SELECT o_year, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(SUM(volume) AS DOUBLE), 9) AS mkt_share
 FROM (SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year,
 CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS volume, n2.n_name AS nation
 FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey
 AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
 AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
 AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year ORDER BY o_year NULLS LAST""",
    "tpch_q09": """SELECT nation, o_year, CAST(SUM(amount) AS DOUBLE) AS sum_profit FROM (SELECT n_name AS nation,
 CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
 - CAST(ps_supplycost AS DECIMAL(15,2)) * CAST(l_quantity AS DECIMAL(15,2)) AS amount
 FROM part, supplier, lineitem, {PS} partsupp, orders, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey
 AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
 AND p_name LIKE '%ring%') AS profit GROUP BY nation, o_year ORDER BY nation NULLS LAST, o_year DESC NULLS LAST""",
    "tpch_q10": """SELECT c_custkey, c_name, {REV} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1998-10-01'
 AND o_orderdate < DATE '1998-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
 GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC NULLS LAST, c_custkey NULLS LAST""",
    "tpch_q11": """WITH ps AS (SELECT ps_partkey, SUM(CAST(ps_supplycost AS DECIMAL(15,2)) * ps_availqty) AS v FROM {PS} partsupp, supplier, nation
 WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey)
 SELECT ps_partkey, CAST(SUM(v) AS DOUBLE) AS value FROM ps GROUP BY ps_partkey
 HAVING CAST(SUM(v) AS DOUBLE) > (SELECT CAST(SUM(v) AS DOUBLE) * CAST(0.001 AS DOUBLE) FROM ps) ORDER BY value DESC NULLS LAST, ps_partkey NULLS LAST""",
    "tpch_q12": """SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
 CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1998-01-01'
 AND l_shipdate < DATE '1998-01-01' + INTERVAL '1' YEAR GROUP BY l_returnflag ORDER BY l_returnflag NULLS LAST""",
    "tpch_q13": """SELECT l_count, COUNT(*) AS orddist FROM (SELECT o_orderkey, COUNT(l_orderkey) FROM orders LEFT OUTER JOIN lineitem
 ON o_orderkey = l_orderkey AND l_returnflag NOT LIKE 'R%' GROUP BY o_orderkey) AS c_orders (o_key, l_count)
 GROUP BY l_count ORDER BY orddist DESC NULLS LAST, l_count DESC NULLS LAST""",
    "tpch_q14": """SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) ELSE 0 END) AS DOUBLE)
 / {REV}, 9) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1998-09-01'
 AND l_shipdate < DATE '1998-09-01' + INTERVAL '1' MONTH""",
    "tpch_q15": """WITH revenue AS (SELECT l_suppkey AS supplier_no, {REV} AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01'
 AND l_shipdate < DATE '1997-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
 SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no
 AND total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey NULLS LAST""",
    "tpch_q16": """SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {PS} partsupp, part
 WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
 AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size
 ORDER BY supplier_cnt DESC NULLS LAST, p_brand NULLS LAST, p_type NULLS LAST, p_size NULLS LAST""",
    "tpch_q17": """SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / 7.0 AS avg_yearly FROM lineitem, part
 WHERE p_partkey = l_partkey AND p_brand = 'Brand#23'
 AND l_quantity < (SELECT 0.2 * AVG(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "tpch_q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS sum_qty
 FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300)
 AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
 ORDER BY o_totalprice DESC NULLS LAST, o_orderdate NULLS LAST, o_orderkey NULLS LAST""",
    "tpch_q19": """SELECT {REV} AS revenue FROM lineitem, part WHERE
 (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 1 + 10 AND p_size BETWEEN 1 AND 5)
 OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 10 + 10 AND p_size BETWEEN 1 AND 10)
 OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 20 + 10 AND p_size BETWEEN 1 AND 15)""",
    "tpch_q20": """SELECT s_suppkey, s_name FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM {PS} partsupp
 WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND ps_availqty > (SELECT 0.5 * SUM(l_quantity)
 FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01'
 AND l_shipdate < DATE '1997-01-01' + INTERVAL '1' YEAR)) AND s_nationkey = n_nationkey AND n_name = 'NATION_4' ORDER BY s_name NULLS LAST""",
    "tpch_q21": """SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey
 AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
 AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
 AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
 AND s_nationkey = n_nationkey AND n_name = 'NATION_5' GROUP BY s_name ORDER BY numwait DESC NULLS LAST, s_name NULLS LAST""",
    "tpch_q22": """SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS totacctbal FROM
 (SELECT SUBSTRING(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM customer WHERE SUBSTRING(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'MA')
 AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0 AND SUBSTRING(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'MA'))
 AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS custsale
 GROUP BY cntrycode ORDER BY cntrycode NULLS LAST""",
    "sort_q100_two_keys": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus
 FROM lineitem ORDER BY l_returnflag NULLS LAST, l_linestatus NULLS LAST""",
    "scan_q101_lineitem": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem""",
}
#: Texts for Spark alone: only the parts asked for are grouped to partsupp, and it is derived once.
OWN = {
    "tpch_q02": """SELECT s_acctbal, s_name, n_name, p_partkey FROM (SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost,
 MIN(ps_supplycost) OVER (PARTITION BY ps_partkey) AS least FROM part, supplier, {PS} partsupp, nation, region
 WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_name LIKE '%ring' AND s_nationkey = n_nationkey
 AND n_regionkey = r_regionkey AND r_name = 'EUROPE') t WHERE ps_supplycost = least
 ORDER BY s_acctbal DESC NULLS LAST, n_name NULLS LAST, s_name NULLS LAST, p_partkey NULLS LAST""".replace(
        "{PS}", PS.replace("FROM lineitem", "FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15 AND p_name LIKE '%ring')")
    ),
    "tpch_q09": TPCH["tpch_q09"].replace("{PS}", PS.replace("FROM lineitem", "FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')")),
}
TPCH = {k: v.replace("{REV}", REV).replace("{PS}", PS) for k, v in TPCH.items()}
