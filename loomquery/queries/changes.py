"""Changes to tables, blocks, procedures and definitions. Each query works on tables of its own."""

from __future__ import annotations

from loomquery.queries import register, wide
from loomquery.session import Session

_NATIONS = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS n FROM nation"


def _session(spark, sf_dir) -> Session:
    """A session with table t (id, name, n), which holds the nations."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, n INT) DISTRIBUTED BY (id)")
    s.sql("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return s


def _changed(name: str, oracle: str, *statements: str, result: str = "SELECT id, name, n FROM t"):
    def run(spark, sf_dir):
        s = _session(spark, sf_dir)
        for statement in statements:
            s.sql(statement)
        return s.sql(result)

    integers = [c for c in ("id", "n", "key", "c") if c in result.split("FROM")[0].replace(",", " ").split()]
    register(name, wide(oracle, *integers))(run)


_changed("insert_select", f"{_NATIONS} UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region", "INSERT INTO t (id, name) SELECT r_regionkey + 100, r_name FROM region")
_changed("insert_conflict_nothing", f"{_NATIONS} UNION ALL SELECT 200, 'new', 9", "INSERT INTO t VALUES (1, 'x', 9), (200, 'new', 9) ON CONFLICT DO NOTHING")
_changed("insert_conflict_replace", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'x' ELSE n_name END AS name, CASE WHEN n_nationkey = 1 THEN 9 ELSE n_regionkey END AS n FROM nation UNION ALL SELECT 200, 'new', 9", "INSERT INTO t VALUES (1, 'x', 9), (200, 'new', 9) ON CONFLICT DO REPLACE")
_changed("update_where", "SELECT n_nationkey AS id, CASE WHEN n_regionkey > 2 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_regionkey > 2 THEN n_regionkey * 10 + n_nationkey // 2 ELSE n_regionkey END AS n FROM nation", "UPDATE t SET n = n * 10 + id / 2, name = lower(name) WHERE n > 2")
_changed("update_from", "SELECT n_nationkey AS id, CASE WHEN r_regionkey < 3 THEN r_name ELSE n_name END AS name, n_regionkey AS n FROM nation JOIN region ON n_regionkey = r_regionkey", "UPDATE t SET name = r.r_name FROM region AS r WHERE t.n = r.r_regionkey AND r.r_regionkey < 3")
_changed("delete_where", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS n FROM nation WHERE NOT (n_regionkey = 2 OR n_name LIKE 'A%')", "DELETE FROM t WHERE n = 2 OR name LIKE 'A%'")
_changed("delete_null_condition", f"{_NATIONS} UNION ALL SELECT 300, NULL, NULL", "INSERT INTO t (id) VALUES (300)", "DELETE FROM t WHERE n > 1000")
_changed("truncate_table", "SELECT 0 AS c", "TRUNCATE TABLE t", result="SELECT count(*) AS c FROM t")
_changed("alter_table", "SELECT n_nationkey AS key, n_name AS name, NULL::BIGINT AS more FROM nation", "ALTER TABLE t ADD COLUMN more INT", "ALTER TABLE t DROP COLUMN n", "ALTER TABLE t RENAME COLUMN id TO key", "ALTER TABLE t RENAME TO u", result="SELECT key, name, more FROM u")
_changed("procedure_call", f"{_NATIONS} UNION ALL SELECT 400, 'by call', 1", "CREATE PROCEDURE add(INT, TEXT) LANGUAGE SQL AS $$ INSERT INTO t (id, name, n) VALUES ($1, $2, 1) $$", "CALL add(400, 'by call')")
_changed("block_upsert", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey = 3 THEN n_regionkey + 50 ELSE n_regionkey END AS n FROM nation UNION ALL SELECT 500, 'fresh', 50", "DO $$ BEGIN INSERT INTO t VALUES (3, 'fresh', 50), (500, 'fresh', 50) ON CONFLICT (id) DO UPDATE SET n = n + 50; END $$")
_changed("block_if_let", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey = 4 THEN n_regionkey + 7 WHEN n_nationkey = 5 THEN NULL ELSE n_regionkey END AS n FROM nation", """DO $$ BEGIN
LET low = (SELECT n FROM t WHERE id = 4); LET none = (SELECT n FROM t WHERE id = 1000);
IF low >= 0 THEN UPDATE t SET n = low + 7 WHERE id = 4; END IF;
IF none > 0 THEN DELETE FROM t; END IF;
UPDATE t SET n = none WHERE id = 5; END $$""")


@register("block_return_query", "SELECT 1 AS id, n_name AS name FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 2, n_name FROM nation WHERE n_nationkey = 2")
def block_return_query(spark, sf_dir):
    s = _session(spark, sf_dir)
    return s.sql("DO $$ BEGIN LET x = (SELECT name FROM t WHERE id = $1); RETURN QUERY SELECT $1 AS id, x AS name; RETURN QUERY SELECT 2, name FROM t WHERE id = 2; END $$", 1)


@register("block_rollback", wide(_NATIONS, "id", "n"))
def block_rollback(spark, sf_dir):
    s = _session(spark, sf_dir)
    try:
        s.sql("DO $$ BEGIN DELETE FROM t WHERE id < 10; INSERT INTO t (id) VALUES (20); END $$")
    except ValueError:  # key 20 is taken, so the deletion is undone
        return s.sql("SELECT id, name, n FROM t")
    raise AssertionError("the block should have failed")


@register("block_transfer", wide("SELECT 1 AS id, 70 AS balance UNION ALL SELECT 2, 130", "id", "balance"))
def block_transfer(spark, sf_dir):
    s = Session(spark)
    s.sql("CREATE TABLE a (id INT PRIMARY KEY, balance INT)")
    s.sql("INSERT INTO a VALUES (1, 100), (2, 100)")
    s.sql("DO $$ BEGIN LET have = (SELECT balance FROM a WHERE id = $1); IF have >= $3 THEN UPDATE a SET balance = balance - $3 WHERE id = $1; UPDATE a SET balance = balance + $3 WHERE id = $2; END IF; END $$", 1, 2, 30)
    return s.sql("SELECT id, balance FROM a")


@register("explain_plan", "SELECT true AS pushed")
def explain_plan(spark, sf_dir):
    lines = Session(spark, sf_dir).sql("EXPLAIN (RAW) SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) = (7, 'F')")
    return lines.selectExpr("bool_or(plan LIKE '%PushedFilters%EqualTo(o_custkey,7)%EqualTo(o_orderstatus,F)%') AS pushed")


@register("row_limit_option", wide("SELECT 5 AS n, true AS refused", "n"))
def row_limit_option(spark, sf_dir):
    s = Session(spark, sf_dir)
    n = s.sql("SELECT r_name FROM region OPTION (sql_motion_row_max = 5)").count()
    try:
        s.sql("SELECT n_name FROM nation OPTION (sql_motion_row_max = 5)")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, refused)], "n bigint, refused boolean")


def _refused(name: str, *statements: str, result: str = "SELECT id, name, n FROM t", oracle: str = _NATIONS, first: tuple = ()):
    """Every statement must fail, and the table be read as before."""
    def run(spark, sf_dir):
        s = _session(spark, sf_dir)
        for statement in first:
            s.sql(statement)
        for statement in statements:
            try:
                done = s.sql(statement)
                if done is not None:
                    done.collect()
            except Exception:  # noqa: BLE001  of the dialect, of Spark's analyzer or of its job
                continue
            raise AssertionError(f"should have failed: {statement}")
        return s.sql(result)

    register(name, wide(oracle, *[c for c in ("id", "n", "c") if c in result.split("FROM")[0].replace(",", " ").split()]))(run)


_REQUIRED = ("CREATE TABLE r (id INT PRIMARY KEY, n INT NOT NULL)", "INSERT INTO r SELECT id, n FROM t")
_R = "SELECT n_nationkey AS id, n_regionkey AS n FROM nation"
_refused("refused_null_in_block", "DO $$ BEGIN DELETE FROM r WHERE id > 3; INSERT INTO r SELECT 100, NULL; END $$", result="SELECT id, n FROM r", oracle=_R, first=_REQUIRED)
_refused("refused_null_update", "UPDATE r SET n = NULL WHERE id = 3", "ALTER TABLE r ADD COLUMN c INT NOT NULL", "INSERT INTO r (id) VALUES (100)", result="SELECT id, n FROM r", oracle=_R, first=_REQUIRED)
_refused("refused_division_by_zero", "UPDATE t SET n = 1 / n", "DO $$ BEGIN DELETE FROM t WHERE id = 1; UPDATE t SET n = 1 / n; END $$", "SELECT 1 / (n_nationkey - n_nationkey) AS x FROM nation")
_refused("refused_duplicate_keys", "INSERT INTO t (id) VALUES (3)", "INSERT INTO t (id) VALUES (100), (100)", "DO $$ BEGIN DELETE FROM t WHERE id > 3; INSERT INTO t (id) VALUES (1); END $$")
_refused("refused_aggregates", "SELECT sum(count(name)) AS x FROM t", "SELECT count(*) AS c FROM t GROUP BY count(*)", "SELECT n FROM t GROUP BY row_number() OVER (ORDER BY n)", "SELECT name FROM t GROUP BY n")
_refused("refused_functions", "SELECT rank() OVER (ORDER BY id) AS x FROM t", "SELECT stddev(n) AS x FROM t", "SELECT length(name) AS x FROM t", "SELECT n FROM t GROUP BY ROLLUP (n)", "SELECT id FROM t CROSS JOIN region", "SELECT id FROM t JOIN nation USING (id)")
_refused("drop_table", "SELECT id FROM r", "INSERT INTO r VALUES (1, 1)", first=(*_REQUIRED, "DROP TABLE r", "DROP TABLE IF EXISTS r"))


@register("not_null_added", wide("SELECT 1 AS id, 5 AS c", "id", "c"))
def not_null_added(spark, sf_dir):
    """NOT NULL of a column added to a table without rows holds for later inserts."""
    s = Session(spark)
    for statement in ("CREATE TABLE e (id INT PRIMARY KEY)", "ALTER TABLE e ADD COLUMN c INT NOT NULL", "INSERT INTO e VALUES (1, 5)"):
        s.sql(statement)
    try:
        s.sql("INSERT INTO e (id) VALUES (2)")
    except ValueError:
        return s.sql("SELECT id, c FROM e")
    raise AssertionError("the insert should have failed")


@register("bucket_filter", wide("SELECT c_custkey AS id, c_nationkey AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT count(*), max(c_nationkey) FROM customer", "id", "n"))
def bucket_filter(spark, sf_dir):
    """The bucket of a key holds its row; all buckets hold all rows; an asterisk hides bucket_id."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE c (id INT PRIMARY KEY, n INT) DISTRIBUTED BY (id)")
    s.sql("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer")
    bucket = s.sql("SELECT bucket_id FROM c WHERE id = 7").first()[0]
    return s.sql("SELECT * FROM c WHERE bucket_id = $1 AND id = 7 UNION ALL SELECT sum(b.k)::int, max(b.n) FROM (SELECT bucket_id, count(*) AS k, max(n) AS n FROM c GROUP BY bucket_id) AS b", bucket)
