"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import aggregates
from loomquery.queries import register, register_sql
from loomquery.sources.tables import load

register_sql("agg_all_kinds", """
SELECT n_regionkey, count(*) AS c, count(n_name) AS cn, CAST(sum(n_nationkey) AS INT) AS s, CAST(avg(n_nationkey) AS DOUBLE) AS a,
       total(n_nationkey) AS t, min(n_name) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey""", """
SELECT n_regionkey, count(*) AS c, count(n_name) AS cn, CAST(sum(n_nationkey) AS BIGINT) AS s, round(avg(n_nationkey), 10) AS a,
       CAST(sum(n_nationkey) AS DOUBLE) AS t, min(n_name) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey""")
register_sql("agg_distinct_multi", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, CAST(sum(DISTINCT o_custkey) AS INT) AS s FROM orders GROUP BY o_orderstatus""", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus""")
register_sql("agg_distinct_null", "SELECT count(DISTINCT v.a) AS c, CAST(sum(DISTINCT v.a) AS INT) AS s FROM (VALUES (1), (NULL), (1), (2)) AS v(a)", "SELECT count(DISTINCT v.a) AS c, CAST(sum(DISTINCT v.a) AS BIGINT) AS s FROM (VALUES (1), (NULL), (1), (2)) AS v(a)")
register_sql("agg_total_empty", "SELECT total(o_totalprice) AS t, count(*) AS c, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0", "SELECT 0.0::DOUBLE AS t, count(*) AS c, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
register_sql("agg_global", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_ FROM orders")
register_sql("agg_sum_decimal", "SELECT CAST(sum(v.a) AS TEXT) AS s FROM (VALUES (9223372036854775807), (9223372036854775807)) AS v(a)", "SELECT CAST(sum(v.a) AS VARCHAR) AS s FROM (VALUES (9223372036854775807), (9223372036854775807)) AS v(a)")
register_sql("having_filter", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) > 1000")
register_sql("having_without_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
register_sql("group_by_expression", "SELECT o_custkey % 10 AS d, count(*) AS n FROM orders GROUP BY o_custkey % 10")
register_sql("group_by_alias_ordinal", "SELECT o_orderstatus AS s, o_orderpriority, count(*) AS n FROM orders GROUP BY s, 2")
register_sql("group_by_no_aggregate", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
register_sql("group_by_integer_division", "SELECT o_custkey / 100 AS d, count(*) AS n FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS d, count(*) AS n FROM orders GROUP BY 1")
register_sql("group_two_stage", "SELECT l_partkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_shipdate >= to_date('1997-01-01', '%Y-%m-%d') GROUP BY l_partkey", "SELECT l_partkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_partkey")
register_sql("string_agg_single", "SELECT r_name, string_agg(r_name) AS a, group_concat(DISTINCT r_name) AS b FROM region GROUP BY r_name", "SELECT r_name, string_agg(r_name, ',') AS a, string_agg(DISTINCT r_name, ',') AS b FROM region GROUP BY r_name")


@register("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), '' ORDER BY left(n_name, 1)) AS firsts FROM nation GROUP BY n_regionkey")
def string_agg_ordered(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")["nation"]
    return nation.groupBy("n_regionkey").agg(aggregates.string_agg("n_name", "|").alias("names"), aggregates.string_agg(F.substring("n_name", 1, 1), "", distinct=True).alias("firsts"))


@register("agg_typed_api", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) AS s, round(avg(o_custkey), 6) AS a, CAST(sum(o_orderkey) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus")
def agg_typed_api(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")["orders"]
    return orders.groupBy("o_orderstatus").agg(aggregates.sum_("o_custkey").cast("double").alias("s"), F.round(aggregates.avg_("o_custkey").cast("double"), 6).alias("a"), aggregates.total("o_orderkey").alias("t"))
