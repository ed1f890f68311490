"""The dialect's rules, statements that it refuses, and changes to tables."""

import datetime

import pytest

from loomquery.dialect import DialectError, parse, to_spark
from loomquery.functions.dates import pattern
from loomquery.functions.strings import similar_regex
from loomquery.operators.dml import ConflictError
from loomquery.session import Session


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, n INT, d DOUBLE)")
    s.sql("INSERT INTO t VALUES (1, 'a', 10, 1.5), (2, 'b', 7, 2.5), (3, NULL, NULL, NULL)")
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 7 / 2", [(3,)]),
        ("SELECT (0 - 7) / 2, 7.0 / 2 > 3.4, 9 / 2 / 2, 9 / (4 / 2)", [(-3, True, 2, 4)]),
        ("SELECT '7 / 2' || 1 / 1", [("7 / 21",)]),
        ("SELECT 1 || 2 + 3", [("15",)]),
        ("SELECT ARRAY[1, 2][3], ARRAY[1, 2][0], ARRAY[1, 2][0 - 1]", [(None, None, None)]),
        ("SELECT 'on'::bool, 'f'::bool, NULL::bool", [(True, False, None)]),
        ("SELECT substring('velvet' FROM '%#\"l_e#\"_' FOR '#')", [("lve",)]),
        ("SELECT substring('abc' FROM 'z')", [(None,)]),
        ("SELECT '{\"a b\": {\"c.d\": 3}}'['a b']['c.d'], json_extract_path('{\"a\": 1}', 'b')", [("3", None)]),
        ("SELECT total(x.v), count(*) FROM (SELECT 1 AS v) AS x WHERE x.v > 5", [(0.0, 0)]),
        ("SELECT row_number() OVER () FROM (VALUES (1), (2)) AS v(a)", [(1,), (2,)]),
        ("SELECT to_date('02.03.2024 10:11', '%d.%m.%Y %H:%M')", [(datetime.datetime(2024, 3, 2),)]),
        ("VALUES (1, 'x')", [(1, "x")]),
        ("SELECT 2147483647 + 1, 3 - 1 - 1, substr('abc', 1 + 1)", [(2147483648, 1, "bc")]),
        ("SELECT row_number() OVER w, sum(a) OVER w, count(*) OVER v FROM (VALUES (4)) AS t(a) WINDOW w AS (), v AS (PARTITION BY a ORDER BY a ROWS 1 + 1 PRECEDING)", [(1, 4, 1)]),
        ("WITH a AS (SELECT 1 AS x), b AS (SELECT x + 1 AS y FROM a) SELECT y FROM b UNION SELECT x FROM a", [(2,), (1,)]),
    ],
)
def test_queries(spark, text, want):
    assert sorted(rows(Session(spark).sql(text)), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a FROM t RIGHT JOIN u ON true", "SELECT a FROM t LIMIT 1 OFFSET 2", "SELECT a FROM t FULL JOIN u ON true", "SELECT a FROM t NATURAL JOIN u",
        "SELECT count(*) FILTER (WHERE true) FROM t", "SELECT count(DISTINCT a) OVER () FROM t", "SELECT current_time", "SELECT a FROM t OPTION (nothing = 1)",
        "SELECT a::nothing", "SELECT (a, b) = (1, 2, 3)", "SELECT a FROM t LIMIT x", "SELECT ( 1", "SELECT string_agg(a, b) FROM t", "SELECT INTERSECT SELECT 1",
        "SELECT to_date('x', '%Q')", "SELECT CAST(1 INT)", "SELECT localtimestamp(7)",
    ],
)
def test_refused(text):
    with pytest.raises(DialectError):
        to_spark(text)


def test_rules():
    assert to_spark("SELECT a FROM t WHERE (a, b) = (1, 2) LIMIT ALL").count("AND") == 1
    assert "`Ä``x`" in to_spark('SELECT "Ä`x" FROM t')
    assert "row_number() OVER (PARTITION BY a ORDER BY 1" in to_spark("SELECT row_number() OVER (PARTITION BY a) FROM t").replace("( ", "(")
    assert "CASE WHEN a > 1 THEN 1 END" in to_spark("SELECT count(*) FILTER (WHERE a > 1) OVER w FROM t WINDOW w AS (ORDER BY a)")
    assert "INDEXED" not in to_spark("SELECT a FROM t INDEXED BY i WHERE a = 1").upper()
    assert parse("-- a comment\nSELECT 1 /* and another */")[0].low == "select"
    assert pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    assert pattern("%d o'clock %%") == "dd' o''clock %'" and pattern("") == "yyyy-MM-dd HH:mm:ss"
    assert similar_regex("a%b_")[0] == "(?s)^(a.*b.)$"


def test_result_names(s):
    assert s.sql("SELECT id, id + 1, n AS m, t.name, count(*) OVER () FROM t").columns == ["id", "col_2", "m", "name", "col_5"]
    assert s.sql("VALUES (1, 2)").columns == ["COLUMN_1", "COLUMN_2"]


def test_types(s):
    df = s.sql("SELECT n / 3 AS q, d / 3 AS r, sum(n) AS s, avg(n) AS a, sum(d) AS e FROM t GROUP BY n / 3, d / 3")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "decimal(38,0)", "decimal(32,10)", "double"]


def test_insert(s):
    with pytest.raises(ConflictError):
        s.sql("INSERT INTO t (id) VALUES (1)")
    with pytest.raises(ConflictError):
        s.sql("INSERT INTO t (id) VALUES (8), (8)")
    s.sql("INSERT INTO t (id, n) VALUES (1, 99), (4, 4) ON CONFLICT DO NOTHING")
    s.sql("INSERT INTO t (id, n) SELECT id, 0 FROM t WHERE id = 2 ON CONFLICT DO REPLACE")
    assert rows(s.sql("SELECT id, name, n FROM t ORDER BY id")) == [(1, "a", 10), (2, None, 0), (3, None, None), (4, None, 4)]
    with pytest.raises(DialectError):
        s.sql("INSERT INTO t (name) VALUES ('no key')")
    with pytest.raises(DialectError):
        s.sql("INSERT INTO t (id, id) VALUES (1, 2)")
    with pytest.raises(DialectError):
        s.sql("INSERT INTO t (id) VALUES (9) ON CONFLICT (id) DO UPDATE SET n = n + 1")


def test_update_and_delete(s):
    s.sql("UPDATE t SET n = n + $1 WHERE name = 'a'", 5)
    s.sql("UPDATE t SET name = u.s FROM (SELECT id AS k, 'x' || id AS s FROM t) AS u WHERE t.id = u.k AND u.k > 1")
    assert rows(s.sql("SELECT id, name, n FROM t ORDER BY id")) == [(1, "a", 15), (2, "x2", 7), (3, "x3", None)]
    s.sql("DELETE FROM t WHERE n > 10")
    assert s.sql("SELECT id FROM t").count() == 2
    for text in ("UPDATE t SET id = 1", "UPDATE t SET n = 1, n = 2", "UPDATE t SET n = sum(n)", "UPDATE t SET none = 1"):
        with pytest.raises(DialectError):
            s.sql(text)
    s.sql("TRUNCATE t")
    assert s.sql("SELECT id FROM t").count() == 0


def test_versions_are_stored(spark, tmp_path):
    s = Session(spark, storage=str(tmp_path))
    s.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    for i in range(3):
        s.sql("INSERT INTO t VALUES ($1)", i)
    assert sorted(rows(s.sql("SELECT id FROM t"))) == [(0,), (1,), (2,)]
    assert len(list((tmp_path / "t").iterdir())) == 3


def test_blocks(s):
    out = s.sql("DO $$ BEGIN LET x = (SELECT n FROM t WHERE id = $1); IF x > 5 THEN IF x > 100 THEN DELETE FROM t; END IF; UPDATE t SET n = x * 2 WHERE id = $1; END IF; RETURN QUERY SELECT x AS v; RETURN QUERY SELECT n FROM t WHERE id = $1; END $$", 1)
    assert rows(out) == [(10,), (20,)]
    with pytest.raises(ConflictError):
        s.sql("DO $$ BEGIN DELETE FROM t WHERE id = 1; INSERT INTO t (id) VALUES (2); END $$")
    assert s.sql("SELECT id FROM t").count() == 3
    for text in (
        "DO $$ BEGIN LET x = (SELECT id FROM t); END $$", "DO $$ BEGIN LET x = (SELECT 1); LET x = (SELECT 2); END $$", "DO $$ BEGIN DROP TABLE t; END $$",
        "DO $$ BEGIN RETURN QUERY SELECT 1; RETURN QUERY SELECT 'a'; END $$", "DO $$ SELECT 1 $$", "DO $$ BEGIN SELECT 1 END $$",
    ):
        with pytest.raises(DialectError):
            s.sql(text)


def test_upsert(s):
    s.sql("DO $$ BEGIN LET k = (SELECT 3); INSERT INTO t (id, n) VALUES (1, 1), (9, 9) ON CONFLICT (id) DO UPDATE SET n = n - k, d = 0.5; END $$")
    assert rows(s.sql("SELECT id, n, d FROM t WHERE id IN (1, 9) ORDER BY id")) == [(1, 7, 0.5), (9, 9, None)]
    with pytest.raises(DialectError):
        s.sql("DO $$ BEGIN INSERT INTO t (id) VALUES (1) ON CONFLICT (n) DO UPDATE SET n = n + 1; END $$")


def test_definitions(s):
    s.sql("CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY)")
    with pytest.raises(DialectError):
        s.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    s.sql("CREATE UNLOGGED TABLE g (a INT NOT NULL, b TEXT[], PRIMARY KEY (a)) DISTRIBUTED GLOBALLY OPTION (TIMEOUT = 3.0)")
    assert s.table("g").placed is None and s.table("t").placed == ["id"]
    s.sql("CREATE UNIQUE INDEX i ON g USING TREE (a)")
    s.sql("ALTER INDEX i RENAME TO j")
    s.sql("DROP INDEX j")
    s.sql("ALTER TABLE g ADD COLUMN c INT NOT NULL, RENAME COLUMN b TO bb")
    s.sql("ALTER TABLE g ALTER COLUMN c TYPE TEXT")
    s.sql("DROP TABLE IF EXISTS none")
    s.sql("DROP TABLE g")
    for text in ("DROP TABLE g", "CREATE TABLE x (a INT)", "CREATE TABLE x (a INT PRIMARY KEY, a TEXT)", "CREATE TABLE x (a INT[][] PRIMARY KEY)", "CREATE TABLE x (a INT PRIMARY KEY) PARTITION BY HASH (a)", "CREATE ROLE r", "ALTER TABLE t DROP COLUMN id"):
        with pytest.raises(DialectError):
            s.sql(text)
    for text in ("BEGIN", "COMMIT", "SET x = 1", "CREATE SCHEMA s", "ALTER SYSTEM SET a = 1", ";"):
        assert s.sql(text) is None


def test_procedures(s):
    s.sql("CREATE PROCEDURE p(INT, INT) AS $$ UPDATE t SET n = $2 WHERE id = $1 $$")
    s.sql("CALL p(1, 2 + 3)")
    s.sql("ALTER PROCEDURE p RENAME TO q")
    s.sql("CALL q($1, $2)", 2, 6)
    assert rows(s.sql("SELECT n FROM t WHERE id < 3 ORDER BY id")) == [(5,), (6,)]
    for text in ("CALL p(1, 2)", "CALL q(1)", "CREATE PROCEDURE r() AS $$ SELECT 1 $$"):
        with pytest.raises(DialectError):
            s.sql(text)
    s.sql("DROP PROCEDURE q")


def test_explain(s):
    for facet in ("", "(LOGICAL)", "(RAW, FMT)", "(BUCKETS)", "(FORWARD)", "(CONTEXT)"):
        assert s.sql(f"EXPLAIN {facet} SELECT id FROM t WHERE n > 3").count() > 0
    assert "count(*)" in " ".join(r[0] for r in s.sql("EXPLAIN (CONTEXT) SELECT count(*) FROM t").collect())
    assert s.sql("EXPLAIN DO $$ BEGIN SELECT 1; END $$").count() == 1


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    s = Session(spark, "/root/testdata/sf0.001")
    plan = "\n".join(r[0] for r in s.sql("EXPLAIN (FMT) SELECT l_orderkey FROM lineitem WHERE (l_linenumber, l_returnflag) = (1, 'R')").collect())
    assert "EqualTo(l_linenumber,1)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan


def test_except_is_anti_join(spark):
    """A EXCEPT B holds the different rows of A that B doesn't."""
    from pyspark.sql import functions as F

    from loomquery.operators import joins

    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    got = {r[0] for r in joins.except_(a, b).collect()}
    assert got == {r[0] for r in a.distinct().join(b.withColumnRenamed("x", "y"), F.col("x").eqNullSafe(F.col("y")), "left_anti").collect()} == {1, None}
    assert joins.not_in(a, "x", b).count() == 2 and joins.not_in(a, "x", spark.createDataFrame([(None,)], "x int")).count() == 0
    assert joins.not_in(a, "x", b.limit(0)).count() == 4


def test_changes_by_columns(spark):
    """The builders that the statements stand on."""
    from pyspark.sql import functions as F

    from loomquery.operators import dml
    from loomquery.sources.tables import Table

    t = Table(spark.createDataFrame([(1, 10, True), (2, None, False)], "id bigint, n bigint, flag boolean"), ["id"])
    out = dml.update(t, {"n": F.col("n") + 1}, F.col("n") > 5)
    assert sorted(rows(out.df)) == [(1, 11, True), (2, None, False)]
    assert rows(dml.delete(t, F.col("n") > 5).df) == [(2, None, False)] and dml.delete(t).df.count() == 0
    new = spark.createDataFrame([(1, 5, True), (3, 7, True)], "id bigint, n bigint, flag boolean")
    got = dml.upsert(t, new, {"n": ("-", F.lit(4)), "flag": ("and", F.lit(False))})
    assert sorted(rows(got.df)) == [(1, 6, False), (2, None, False), (3, 7, True)]
    assert sorted(rows(dml.insert(t, new, conflict="replace").df), key=str) == [(1, 5, True), (2, None, False), (3, 7, True)]
    with pytest.raises(DialectError):
        dml.insert(t, new.drop("n"))
    with pytest.raises(ConflictError):
        dml.upsert(t, new.union(new), {})


def test_entry_without_the_corpus_modules():
    """The engine's own queries don't need them."""
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    try:
        importlib.util.find_spec = lambda name, *a: None if name in ("loomquery.llm", "corpus_pipeline") else real(name, *a)
        assert entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    finally:
        importlib.util.find_spec = real


def test_not_in_sends_no_whole_side(spark):
    s = Session(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text in ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT l_orderkey FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, o_custkey FROM orders)"):
            plan = s.sql(text)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_not_in_compares_one_row_a_key(spark):
    """Joins of NOT IN have no condition beyond their keys: with one, a column that is the same in all rows is compared row by row."""
    s = Session(spark, "/root/testdata/sf0.001")
    for text in ("(l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, 1 FROM orders)", "(l_orderkey, l_linenumber, l_suppkey) NOT IN (SELECT o_orderkey, 1, o_custkey FROM orders)"):
        plan, joins = s.sql(f"SELECT l_orderkey FROM lineitem WHERE {text}")._jdf.queryExecution().sparkPlan(), []
        todo = [plan]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                joins.append(node)
        assert joins and all(j.nodeName() != "BroadcastNestedLoopJoin" and j.condition().isEmpty() for j in joins)


def test_not_in_with_nulls_by_brute_force(spark):
    import itertools
    import random

    random.seed(5)
    s = Session(spark)
    for width, drawn, nulls in ((1, 2, ()), (2, 0, ()), (2, 2, ()), (2, 2, (0,)), (2, 3, (0, 1)), (3, 3, ()), (3, 3, (0, 2))):
        left = list(itertools.product((1, 2, None), repeat=width)) * 2
        right = [tuple(None if i in nulls and random.random() < 0.6 else random.choice((1, 2, 3)) for i in range(width)) for _ in range(drawn)] * 2
        kinds = ", ".join(f"c{i} int" for i in range(width))
        s.register("l", spark.createDataFrame(left, kinds))
        s.register("r", spark.createDataFrame(right, kinds))
        for fixed in (False, True)[: width if width < 3 else 1]:  # a literal in the query's last column
            against = [(*r[:-1], 1) for r in right] if fixed else right
            names = [f"c{i}" for i in range(width)]
            row = f"({', '.join(names)})" if width > 1 else names[0]
            got = s.sql(f"SELECT {', '.join(names)} FROM l WHERE {row} NOT IN (SELECT {', '.join([*names[:-1], '1'] if fixed else names)} FROM r)")
            want = [x for x in left if all(any(a is not None and b is not None and a != b for a, b in zip(x, r, strict=True)) for r in against)]
            assert sorted(rows(got), key=str) == sorted(want, key=str), (width, right, fixed)


def test_buckets_are_pushed_and_hidden(spark):
    s = Session(spark, "/root/testdata/sf0.001")
    s.sql("CREATE TABLE c (id INT PRIMARY KEY, n INT) DISTRIBUTED BY (id)")
    s.sql("INSERT INTO c SELECT o_orderkey, o_custkey FROM orders")
    assert s.sql("SELECT * FROM c").columns == ["id", "n"]
    df = s.sql("SELECT x.*, x.bucket_id FROM c AS x WHERE bucket_id = 17")
    assert df.columns == ["id", "n", "bucket_id"] and s.sql("SELECT * FROM c WHERE bucket_id > 0 UNION ALL SELECT * FROM c").columns == ["id", "n"]
    assert "PushedFilters: [IsNotNull(bucket_id), EqualTo(bucket_id,17)]" in df._jdf.queryExecution().executedPlan().toString()
    files = s.tables["c"].df.inputFiles()
    bounds = []
    import pyarrow.parquet as pq

    for f in files:
        column = pq.read_table(f.removeprefix("file://")).column("bucket_id").to_pylist()
        assert column == sorted(column)
        bounds.append((column[0], column[-1]))
    bounds.sort()
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False)) and files
    s.close()
