"""Joins, semi-joins and anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import joins
from loomquery.queries import register, register_sql
from loomquery.sources.tables import load, replicated

register_sql("join_inner_3way", """
SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM customer AS c
INNER JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
register_sql("join_left_null_ext", """
SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000
GROUP BY c.c_custkey""")
register_sql("join_left_outer_filter", "SELECT c.c_custkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
register_sql("join_left_replicated", "SELECT n.n_name, count(s.s_suppkey) AS n FROM nation AS n LEFT JOIN supplier AS s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name")
register_sql("join_theta", "SELECT a.r_name AS a, b.r_name AS b FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey")
register_sql("join_left_theta", "SELECT a.n_nationkey, count(b.r_regionkey) AS n FROM nation AS a LEFT JOIN region AS b ON a.n_nationkey < b.r_regionkey * 2 GROUP BY a.n_nationkey")
register_sql("cross_on_true", "SELECT count(*) AS n, count(DISTINCT r.r_name) AS regions FROM region AS r JOIN nation AS n ON TRUE")
register_sql("join_self_alias", "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
register_sql("join_on_subquery", """
SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey
AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) WHERE o.o_totalprice > 150000""")
register_sql("join_subqueries", """
SELECT a.k, a.n, b.m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) AS a
JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) AS b ON a.k = b.k""")
register_sql("join_colocated", """
SELECT o.o_orderpriority, count(*) AS lines, round(sum(l.l_extendedprice), 2) AS price FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderpriority""")
register_sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
register_sql("semi_exists", "SELECT r_name FROM region WHERE EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey > 20)")
register_sql("anti_not_exists", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey > 100)")
register_sql("anti_not_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
register_sql("anti_not_in_large", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_acctbal > 0")
register_sql("anti_not_in_row", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, 1 FROM orders WHERE o_totalprice > 50000) AND l_quantity > 40""")
register_sql("anti_not_in_row_null", """
SELECT v.a, v.b FROM (VALUES (1, 1), (NULL, 2), (3, NULL), (4, 4), (6, 6), (NULL, NULL)) AS v(a, b)
WHERE (v.a, v.b) NOT IN (SELECT w.c, w.d FROM (VALUES (1, 1), (5, 2), (NULL, 4)) AS w(c, d))""")
register_sql("anti_not_in_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT v.a FROM (VALUES (1), (NULL)) AS v(a))")


@register("join_broadcast_api", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast_api(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "nation")
    return joins.inner(t["customer"], t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), replicate=True).groupBy("n_name").agg(F.count("*").alias("n"))


@register("join_repartition_api", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY l_returnflag")
def join_repartition_api(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "part")
    small = replicated(t["part"].filter("p_size < 10").select("p_partkey"))
    return joins.inner(t["lineitem"].select("l_partkey", "l_returnflag"), small, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("anti_not_in_api", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_not_in_api(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "orders")
    return joins.not_in(t["customer"], "c_custkey", t["orders"].select("o_custkey")).select("c_custkey")


@register("semi_anti_api", """
SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti_api(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return joins.union_all(count(joins.semi(t["customer"], t["orders"], on), "semi"), count(joins.anti(t["customer"], t["orders"], on), "anti"))
