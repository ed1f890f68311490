"""Scalar functions, operators and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import dates, nested, strings
from loomquery.queries import register, register_sql
from loomquery.sources.tables import load

register_sql("string_funcs", """
SELECT n_name, lower(n_name) AS lo, upper(n_name) AS up, substr(n_name, 2) AS tail, substr(n_name, 2, 3) AS mid, coalesce(NULL, n_name, 'x') AS c,
       n_name || '-' || n_nationkey || '-' || true AS cat FROM nation""")
register_sql("concat_null", "SELECT 'a' || NULL AS n, 'b' || 1 AS i, 'c' || 1.5 AS d", "SELECT CAST(NULL AS VARCHAR) AS n, 'b1' AS i, 'c1.5' AS d")
register_sql("substring_forms", """
SELECT substring(n_name FROM 2 FOR 3) AS a, substring(n_name, 2, 3) AS b, substring(n_name FOR 4) AS c, substring(n_name FROM 3) AS d, substring(n_name, 2) AS e, n_nationkey FROM nation""", """
SELECT substring(n_name, 2, 3) AS a, substring(n_name, 2, 3) AS b, substring(n_name, 1, 4) AS c, substring(n_name, 3) AS d, substring(n_name, 2) AS e, n_nationkey FROM nation""")
register_sql("numeric_widening", "SELECT s_suppkey, s_nationkey * 2147483647 + 1 AS wide, s_acctbal + s_nationkey AS mixed, s_nationkey / 2 + s_acctbal AS halved FROM supplier", """
SELECT s_suppkey, s_nationkey * 2147483647::BIGINT + 1 AS wide, s_acctbal + s_nationkey AS mixed, s_nationkey // 2 + s_acctbal AS halved FROM supplier""")
register_sql("substring_pattern_columns", """
SELECT c.c_custkey, substring(c.c_name FROM p.r) AS first_, substring(c.c_name SIMILAR p.s ESCAPE p.e) AS part, substring(c.c_name FROM p.k FOR 3) AS three
FROM customer AS c JOIN (VALUES ('[0-9]+', '%#"[0-9]{3}#"', '#', 2), ('(C)u', 'C!"_!"%', '!', 4)) AS p(r, s, e, k) ON TRUE""", """
SELECT c_custkey, CASE p.n WHEN 1 THEN regexp_extract(c_name, '[0-9]+') ELSE regexp_extract(c_name, '(C)u', 1) END AS first_,
CASE p.n WHEN 1 THEN right(c_name, 3) ELSE substring(c_name, 2, 1) END AS part, substring(c_name, p.k, 3) AS three FROM customer, (VALUES (1, 2), (2, 4)) AS p(n, k)""")
register_sql("substring_regex", "SELECT n_nationkey, substring(n_name FROM '[AEIOU][A-Z]') AS v, substring(n_name FROM 'N(.)') AS g FROM nation", """
SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '[AEIOU][A-Z]') THEN regexp_extract(n_name, '[AEIOU][A-Z]') END AS v,
       CASE WHEN regexp_matches(n_name, 'N(.)') THEN regexp_extract(n_name, 'N(.)', 1) END AS g FROM nation""")
register_sql("substring_similar", """
SELECT n_nationkey, substring(n_name FROM '%#"A_#"%' FOR '#') AS f, substring(n_name SIMILAR '#"[A-Z]+#"IA' ESCAPE '#') AS s FROM nation""", """
SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '^.*?A.') THEN regexp_extract(n_name, '^.*?(A.)', 1) END AS f,
       CASE WHEN regexp_matches(n_name, '^[A-Z]+IA$') THEN regexp_extract(n_name, '^([A-Z]+)IA$', 1) END AS s FROM nation""")
register_sql("trim_forms", "SELECT trim('  a ') AS a, trim(LEADING 'x' FROM 'xxaxx') AS b, trim(TRAILING 'xy' FROM 'axyx') AS c, trim(BOTH 'x' FROM 'xax') AS d", "SELECT trim('  a ') AS a, ltrim('xxaxx', 'x') AS b, rtrim('axyx', 'xy') AS c, trim('xax', 'x') AS d")
register_sql("arithmetic_integers", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey + 1 - 2 * 3 AS x, (o_orderkey + 5) / 2 / 3 AS y FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_orderkey + 1 - 2 * 3 AS x, (o_orderkey + 5) // 2 // 3 AS y FROM orders")
register_sql("arithmetic_doubles", "SELECT o_orderkey, o_totalprice / 2 AS h, abs(0 - o_totalprice) AS a, abs(o_orderkey - 100) AS b FROM orders")
register_sql("date_literal_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN to_date('1996-01-01', '%Y-%m-%d') AND to_date('31.03.1996', '%d.%m.%Y')", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
register_sql("date_to_char", "SELECT o_orderkey, to_char(o_orderdate, '%Y/%m/%d %H:%M') AS d, to_char(NULL::datetime, '%Y') AS n FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS d, NULL::VARCHAR AS n FROM orders")
register_sql("date_now", "SELECT current_date <= current_timestamp AS a, localtimestamp(0) <= current_timestamp AS b, to_char(current_date, '%H:%M:%S') AS c", "SELECT true AS a, true AS b, '00:00:00' AS c")
register_sql("array_index", "SELECT vec_id, embedding[1] AS first_, embedding[9999] AS none, embedding[1 + 1] AS second_ FROM embeddings", "SELECT vec_id, embedding[1] AS first_, embedding[9999] AS none, embedding[2] AS second_ FROM embeddings")
register_sql("array_literal", "SELECT ARRAY[n_nationkey, n_regionkey, NULL][2] AS b, (ARRAY['x', n_name])[2] AS n, ARRAY[1, 2][ARRAY[2, 1][1]] AS nested FROM nation", "SELECT n_regionkey AS b, n_name AS n, 2 AS nested FROM nation")
register_sql("array_cast", "SELECT ('1.5' || n_nationkey)::double AS d, (ARRAY[1, 2]::double[])[2] AS a, (ARRAY[1, 2]::text[])[1] AS t FROM nation", "SELECT CAST('1.5' || n_nationkey AS DOUBLE) AS d, 2.0::DOUBLE AS a, '1' AS t FROM nation")
register_sql("json_path", "SELECT event_id, json_extract_path(props, 'k') AS k, json_extract_path(props, 'none', 'x') AS n, props['k']::int + 1 AS i FROM events", "SELECT event_id, props ->> '$.k' AS k, NULL::VARCHAR AS n, CAST(props ->> '$.k' AS BIGINT) + 1 AS i FROM events")
register_sql("cast_forms", """
SELECT CAST(n_nationkey AS TEXT) AS t, n_nationkey::double AS d, CAST('12' AS INT) AS i, 'on'::bool AS y, CAST('off' AS BOOLEAN) AS n,
       to_char('2024-02-03T04:05:06Z'::datetime, '%Y-%m-%d %H:%M:%S') AS iso, to_char('Sat, 03 Feb 2024 04:05:06 +0000'::datetime, '%d.%m.%Y') AS mail,
       'A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11'::uuid AS u, (2.7)::int AS f, -1.5::int AS g FROM nation""", """
SELECT CAST(n_nationkey AS VARCHAR) AS t, n_nationkey::DOUBLE AS d, 12::BIGINT AS i, true AS y, false AS n, '2024-02-03 04:05:06' AS iso, '03.02.2024' AS mail,
       'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS u, 2::BIGINT AS f, -2::BIGINT AS g FROM nation""")


@register("functions_api", "SELECT event_id, props ->> '$.k' AS k, strftime(ts, '%Y-%m') AS month, regexp_extract(event_type, '^.*?([aeiou].)', 1) AS part FROM events WHERE regexp_matches(event_type, '^.*?[aeiou].')")
def functions_api(spark, sf_dir):
    events = load(spark, sf_dir, "events")["events"]
    part = strings.substring_similar(F.col("event_type"), '%#"[aeiou]_#"%', "#")
    rows = events.select("event_id", nested.json_extract_path(F.col("props"), "k").alias("k"), dates.to_char(F.col("ts"), "%Y-%m").alias("month"), part.alias("part"))
    return rows.filter("part IS NOT NULL")


@register("array_index_api", "SELECT vec_id, embedding[3] AS third, NULL::FLOAT AS none FROM embeddings")
def array_index_api(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")["embeddings"]
    return rows.select("vec_id", nested.at(F.col("embedding"), 3).alias("third"), nested.at(F.col("embedding"), F.lit(None)).alias("none"))
