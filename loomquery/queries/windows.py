"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomquery.operators import aggregates
from loomquery.queries import register, register_sql
from loomquery.sources.tables import load

register_sql("win_row_number", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer")
register_sql("win_row_number_no_order", "SELECT max(rn) AS m, count(DISTINCT rn) AS n FROM (SELECT row_number() OVER () AS rn FROM nation) AS s")
register_sql("win_row_number_partition_no_order", "SELECT n_regionkey, max(rn) AS m FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey) AS rn FROM nation) AS s GROUP BY n_regionkey")
register_sql("win_last_value_range", "SELECT n_nationkey, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM nation")
register_sql("win_default_frame", "SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey) AS peers, last_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS l, count(*) OVER (PARTITION BY n_regionkey) AS whole FROM nation")
register_sql("win_rows_frame_sum", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c,
       min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders""")
register_sql("win_rows_single_bound", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS 1 PRECEDING) AS INT) AS s FROM nation", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS 1 PRECEDING) AS BIGINT) AS s FROM nation")
register_sql("win_range_offset", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS c, max(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 1 + 1 PRECEDING AND CURRENT ROW) AS m FROM nation")
register_sql("win_filter_over", """
SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c,
       CAST(sum(n_nationkey) FILTER (WHERE n_name LIKE '%A%') OVER (PARTITION BY n_regionkey) AS INT) AS s FROM nation""", """
SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c,
       CAST(sum(n_nationkey) FILTER (WHERE n_name LIKE '%A%') OVER (PARTITION BY n_regionkey) AS BIGINT) AS s FROM nation""")
register_sql("win_named", """
SELECT n_nationkey, CAST(sum(n_nationkey) OVER w AS INT) AS s, count(*) OVER w AS c, max(n_name) OVER v AS m FROM nation
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey), v AS (PARTITION BY n_regionkey)""", """
SELECT n_nationkey, CAST(sum(n_nationkey) OVER w AS BIGINT) AS s, count(*) OVER w AS c, max(n_name) OVER v AS m FROM nation
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey), v AS (PARTITION BY n_regionkey)""")
register_sql("win_nulls_order", "SELECT v.a, v.b, row_number() OVER (ORDER BY v.a NULLS LAST, v.b DESC NULLS FIRST) AS rn FROM (VALUES (1, 2), (NULL, 1), (1, NULL), (2, 5)) AS v(a, b)")
register_sql("win_all_aggregates", """
SELECT n_nationkey, CAST(avg(n_nationkey) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS a, min(n_name) OVER (PARTITION BY n_regionkey) AS lo,
       total(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS t,
       string_agg(n_name, '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM nation""", """
SELECT n_nationkey, round(avg(n_nationkey) OVER (PARTITION BY n_regionkey), 10) AS a, min(n_name) OVER (PARTITION BY n_regionkey) AS lo,
       CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS DOUBLE) AS t,
       string_agg(n_name, '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM nation""")
register_sql("win_partition_expression", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey % 5, o_orderstatus ORDER BY o_orderkey) AS c FROM orders")
register_sql("win_partition_subquery", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey + (SELECT 1) ORDER BY n_nationkey) AS c FROM nation", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c FROM nation")


@register("win_filter_api", "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey) AS c FROM nation")
def win_filter_api(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")["nation"]
    even = F.count(aggregates.when(F.col("n_nationkey") % 2 == 0)).over(Window.partitionBy("n_regionkey"))
    return nation.select("n_nationkey", even.alias("c"))
