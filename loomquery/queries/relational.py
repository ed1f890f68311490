"""Scans, projections, predicates, sorts, limits, set operations and CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import joins
from loomquery.queries import register, register_sql
from loomquery.sources.tables import bucket_id, load

register_sql("q1_dialect", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= to_date('1998-09-02', '%Y-%m-%d')
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")

register_sql("scan_projection", "SELECT o_orderkey AS k, o_totalprice * 2 AS double_price, o_orderstatus FROM orders AS o WHERE o_totalprice > 100000")
register_sql("scan_subquery", "SELECT s.k, s.n FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) AS s WHERE s.k >= 2")
register_sql("scan_indexed_by", "SELECT c_custkey FROM customer INDEXED BY customer_pk WHERE c_acctbal < 500", "SELECT c_custkey FROM customer WHERE c_acctbal < 500")
register_sql("select_without_scan", "SELECT 1 + 2 AS a, 'x' AS b, count(*) AS c", "SELECT CAST(1 + 2 AS BIGINT) AS a, 'x' AS b, count(*) AS c")
register_sql("select_asterisk", "SELECT r.*, n.n_name FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey")
register_sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
register_sql("output_names", "SELECT r_regionkey + 1, r_name FROM region", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS col_1, r_name FROM region")
register_sql("values_source", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
register_sql("values_columns", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(\"COLUMN_1\", \"COLUMN_2\")")
register_sql("quoted_names", 'SELECT "n_name" AS "Name" FROM nation WHERE "n_nationkey" < 5')

register_sql("filter_between_like", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%a%' AND p_size NOT BETWEEN 14 AND 15")
register_sql("filter_like_escape", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%' ESCAPE '!' AND c_mktsegment NOT LIKE '_U%'")
register_sql("filter_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%BRASS%' OR p_name ILIKE 'P%1'")
register_sql("filter_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
register_sql("filter_row_in", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 8))")
register_sql("filter_row_equal", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_linenumber, l_returnflag) = (1, 'R')")
register_sql("filter_in_values", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN (VALUES ('1-URGENT'), ('2-HIGH')) AND o_orderstatus NOT IN (VALUES ('F'))")
register_sql("filter_boolean_logic", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 1000 OR o_orderstatus = 'F') AND (o_custkey % 2 = 0 OR o_custkey <> 7) AND o_totalprice != 5.5")
register_sql("filter_is_tests", """
SELECT v.a, (v.a IS NULL) AS n, (v.b IS TRUE) AS t, (v.b IS NOT FALSE) AS nf, (v.b IS UNKNOWN) AS u
FROM (VALUES (1, true), (2, false), (NULL, NULL)) AS v(a, b) WHERE v.a IS NOT NULL OR v.b IS UNKNOWN""", """
SELECT v.a, (v.a IS NULL) AS n, (v.b IS NOT DISTINCT FROM true) AS t, (v.b IS DISTINCT FROM false) AS nf, (v.b IS NULL) AS u
FROM (VALUES (1, true), (2, false), (NULL, NULL)) AS v(a, b) WHERE v.a IS NOT NULL OR v.b IS NULL""")
register_sql("filter_three_valued", "SELECT v.a FROM (VALUES (1), (NULL), (3)) AS v(a) WHERE NOT (v.a = 1)")
register_sql("case_buckets", """
SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS bucket,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
register_sql("parameters", "SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_name > $2", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_name > 'A'", 1, "A")
register_sql("parameters_unnumbered", "SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8", 2, 8)
register_sql("scalar_subquery_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
register_sql("scalar_subquery_select", "SELECT r_name, (SELECT count(*) FROM nation) AS nations, r_regionkey + (SELECT max(n_regionkey) FROM nation) AS shifted FROM region")
register_sql("scalar_subquery_group_order", """
SELECT n_regionkey + (SELECT min(r_regionkey) FROM region) AS k, count(*) AS n FROM nation
GROUP BY n_regionkey + (SELECT min(r_regionkey) FROM region) HAVING count(*) > (SELECT 0) ORDER BY (SELECT 1), k""", """
SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey""")
register_sql("concat_precedence", "SELECT n_name || n_nationkey + 1 || '!' AS s FROM nation", "SELECT n_name || (n_nationkey + 1) || '!' AS s FROM nation")

register_sql("order_nulls", """
SELECT v.a, row_number() OVER (ORDER BY v.a DESC NULLS LAST, v.b) AS last_, row_number() OVER (ORDER BY v.a, v.b) AS first_
FROM (VALUES (1, 1), (NULL, 2), (3, 3)) AS v(a, b) ORDER BY v.a NULLS FIRST""", """
SELECT v.a, row_number() OVER (ORDER BY v.a DESC NULLS LAST, v.b) AS last_, row_number() OVER (ORDER BY v.a NULLS FIRST, v.b) AS first_
FROM (VALUES (1, 1), (NULL, 2), (3, 3)) AS v(a, b)""")
register_sql("order_ordinal_alias", "SELECT n_regionkey AS r, n_name FROM nation ORDER BY r DESC, 2")
register_sql("order_in_cte", "WITH c AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40), d AS (SELECT s.o_orderkey FROM (SELECT o_orderkey FROM c ORDER BY o_orderkey LIMIT 20) AS s) SELECT o_orderkey FROM d")
register_sql("limit_all", "SELECT r_name FROM region LIMIT NULL", "SELECT r_name FROM region")
register_sql("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
register_sql("topk_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
register_sql("limit_union", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 12")

register_sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
register_sql("union_all_nested", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
register_sql("union_all_versions", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < to_date('1995-01-01', '%Y-%m-%d') AND o_custkey IN (1, 2, 3, 4, 5)
UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= to_date('1995-01-01', '%Y-%m-%d') AND (o_custkey = 7 OR o_custkey = 8)""", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' AND o_custkey IN (1, 2, 3, 4, 5)
UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND (o_custkey = 7 OR o_custkey = 8)""")
register_sql("except_distinct", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
register_sql("except_null", "SELECT v.a FROM (VALUES (1), (NULL), (2), (2)) AS v(a) EXCEPT SELECT w.a FROM (VALUES (NULL), (1)) AS w(a)")
register_sql("set_precedence", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region UNION SELECT 3")
register_sql("cte_multi_ref", """
WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT a.k, round(a.total, 2) AS total FROM big AS a JOIN big AS b ON a.k = b.k WHERE a.total > (SELECT avg(total) * 2 FROM big)""")
register_sql("cte_columns_values", "WITH c(a, b) AS (VALUES (1, 'x'), (2, 'y')), d(x) AS (SELECT a * 10 FROM c) SELECT c.b, d.x FROM c JOIN d ON d.x = c.a * 10", "SELECT 'x' AS b, 10::BIGINT AS x UNION ALL SELECT 'y', 20")


@register("except_replicated", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def except_replicated(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "nation")
    return joins.except_(t["customer"].select(F.col("c_nationkey").alias("k")), t["nation"].filter("n_regionkey = 1").select("n_nationkey"))


@register("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_distinct(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("k")).intersect(t["supplier"].select("s_nationkey"))


@register("bucket_pruning", "SELECT true AS within, count(*) AS orders, count(DISTINCT o_custkey) AS keys FROM orders")
def bucket_pruning(spark, sf_dir):
    """Equal keys share a bucket, and buckets count from 1."""
    rows = load(spark, sf_dir, "orders")["orders"].withColumn("bucket_id", bucket_id("o_custkey"))
    per_key = rows.groupBy("o_custkey").agg(F.countDistinct("bucket_id").alias("b"), F.min("bucket_id").alias("low"), F.max("bucket_id").alias("high"), F.count("*").alias("n"))
    return per_key.agg(F.bool_and((F.col("b") == 1) & F.col("low").between(1, 3000)).alias("within"), F.sum("n").alias("orders"), F.count("*").alias("keys"))
