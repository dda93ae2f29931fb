"""Scans, projections, predicates, joins, aggregates, windows, sorts, set operations, subqueries and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.recursion import fixpoint_distinct
from millrace.plans.registry import df_query, load, sql_query
from millrace.sources.partitions import RangePartitions
from millrace.storage import shared_root

# ---- scans ----
sql_query("scan_full", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
sql_query("scan_point", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
sql_query("scan_eq_prefix", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'O'")
sql_query("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
sql_query("scan_index_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
sql_query("row_count", "SELECT COUNT(*) AS n_rows FROM lineitem")
sql_query("functional_predicate", "SELECT p_partkey, p_name FROM part WHERE LOWER(p_type) = LOWER('promo') OR p_size * 2 = 40")
sql_query("derived_table", "SELECT d.s, d.n FROM (SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE d.n > 10")
sql_query("select_literal", "SELECT 1 AS one, 'x' AS letter, 2 + 3 AS five")
sql_query("values_row", "SELECT column_0, column_1 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(column_0, column_1)")

PARTITION_BOUNDS = (250, 500, 1000)


@df_query("scan_partition_prune", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 300")
def scan_partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are written by partition, and one partition's files are read."""
    parts, path = RangePartitions("o_custkey", PARTITION_BOUNDS), shared_root(spark, "partitioned")
    parts.tag(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).write.partitionBy("_partition").parquet(path)
    return parts.prune_equal(spark.read.parquet(path), 300).select("o_orderkey", "o_custkey")


@df_query("view_query", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = spark.sql("SELECT c_custkey, c_acctbal, c_mktsegment FROM {customer} WHERE c_acctbal > 5000", customer=load(spark, sf_dir, "customer"))
    return spark.sql("SELECT c_custkey, c_acctbal FROM {v} WHERE c_mktsegment = 'BUILDING'", v=rich)


# ---- projection ----
sql_query("project_alias", "SELECT n_nationkey AS k, n_name AS name FROM nation")
sql_query("project_star", "SELECT * FROM supplier")
sql_query("project_qualified_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
sql_query("project_expr", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity + 1 AS q1 FROM lineitem")
sql_query("subquery_scalar", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders) AS top_price FROM customer WHERE c_custkey <= 20")
sql_query("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


@df_query("generated_column", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem")
def generated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").withColumn("gross", F.expr("ROUND(l_extendedprice * (1 + l_tax), 4)")).select("l_orderkey", "l_linenumber", "gross")


# ---- predicates ----
sql_query("filter_compare", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 20 AND p_retailprice <> 1000 AND p_brand >= 'Brand#2'")
sql_query("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11')")
sql_query("filter_is_null", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL")
sql_query("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O%' AND p_brand NOT LIKE '%1'")
sql_query("filter_between", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 910 AND 950 AND p_size NOT BETWEEN 10 AND 20")
sql_query("filter_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) OR p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
sql_query("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql_query("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql_query("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
sql_query("subquery_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")

# ---- joins ----
sql_query("join_inner", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
sql_query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
sql_query("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql_query("join_full", "SELECT c.k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k")
sql_query("join_where_order_limit", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000 ORDER BY o.o_orderkey DESC LIMIT 25")
sql_query("join_semi", "SELECT n_nationkey, n_name FROM nation n WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
sql_query("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
sql_query("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
sql_query("join_three_way", "SELECT r.r_name, COUNT(*) AS suppliers, ROUND(SUM(s.s_acctbal), 2) AS bal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
sql_query("join_theta", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")

# ---- aggregates ----
sql_query(
    "group_by_multi",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 4) AS avg_disc
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
sql_query("agg_count_star", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
sql_query("agg_count_col", "SELECT c.c_nationkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 GROUP BY c.c_nationkey")
sql_query("agg_sum", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS lines, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag")
sql_query("agg_min_max", "SELECT o_orderstatus, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(o_orderpriority) AS first_p FROM orders GROUP BY o_orderstatus")
sql_query("agg_avg", "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS avg_bal FROM customer GROUP BY c_mktsegment")
sql_query("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
sql_query("group_by_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000")
sql_query("group_by_derived", "SELECT seg, SUM(n) AS total FROM (SELECT c_mktsegment AS seg, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) d GROUP BY seg", "SELECT seg, CAST(SUM(n) AS BIGINT) AS total FROM (SELECT c_mktsegment AS seg, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) d GROUP BY seg")
sql_query("group_by_order_limit", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 15")
sql_query("agg_global", "SELECT COUNT(*) AS n, ROUND(AVG(l_quantity), 4) AS q, MAX(l_shipdate) AS last_ship FROM lineitem")
sql_query("group_by_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("group_by_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# ---- windows: frames are always written out ----
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
sql_query("win_row_number", f"SELECT o_orderkey, CAST(ROW_NUMBER() {_W} AS BIGINT) AS rn FROM orders")
sql_query("win_rank", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM orders")
sql_query("win_dense_rank", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM orders")
sql_query("win_lag", f"SELECT o_orderkey, LAG(o_orderkey) {_W} AS p, LAG(o_orderkey, 2, CAST(0 AS BIGINT)) {_W} AS p2 FROM orders")
sql_query("win_lead", f"SELECT o_orderkey, LEAD(o_orderkey) {_W} AS nx, LEAD(o_orderkey, 1, CAST(-1 AS BIGINT)) {_W} AS n1 FROM orders")
sql_query("win_sum_running", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
sql_query("win_sum_partition", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
sql_query("win_partition_order", "SELECT l_orderkey, l_linenumber, CAST(ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_quantity * -1, l_linenumber) AS BIGINT) AS rn FROM lineitem")
sql_query("win_rows_frame", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 2) AS around FROM orders")

# ---- sorts and limits ----
sql_query("order_by_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey")
sql_query("limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
sql_query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
sql_query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
# An aggregate over the filtered scan, not a window over one partition, counts what LIMIT cuts.
sql_query("found_rows", "SELECT p.o_orderkey, t.found FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 5) p CROSS JOIN (SELECT COUNT(*) AS found FROM orders WHERE o_totalprice > 200000) t")

# ---- set operations ----
_C, _S = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 7000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000"
sql_query("union_distinct", f"{_C} UNION {_S}")
sql_query("union_all", f"{_C} UNION ALL {_S}")
sql_query("intersect", f"{_C} INTERSECT {_S}")
sql_query("except", f"SELECT n_nationkey AS k FROM nation EXCEPT {_S}")
sql_query("except_all", f"{_C} EXCEPT ALL {_S}")
sql_query("intersect_all", f"{_C} INTERSECT ALL {_S}")
sql_query("set_op_nested", f"SELECT k FROM (({_C} UNION {_S}) EXCEPT (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1)) u ORDER BY k LIMIT 12")

# ---- common table expressions ----
sql_query("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
sql_query("cte_chained", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k, n FROM a WHERE n > 10) SELECT c.c_name, b.n FROM b JOIN customer c ON c.c_custkey = b.k")
sql_query("cte_recursive", "WITH RECURSIVE seq(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM seq WHERE n < 15) SELECT n, f FROM seq")


@df_query(
    "cte_recursive_distinct",
    """WITH RECURSIVE edge AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS a, CAST((c_nationkey * 7 + 3) % 25 AS BIGINT) AS b FROM customer),
       reach(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.b FROM reach r JOIN edge e ON e.a = r.k) SELECT k FROM reach""",
)
def cte_recursive_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = load(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS a", "CAST((c_nationkey * 7 + 3) % 25 AS BIGINT) AS b").distinct()
    start = spark.range(1, 2).toDF("k")
    return fixpoint_distinct(start, lambda work: work.join(edge, F.col("k") == F.col("a")).select(F.col("b").alias("k")))
