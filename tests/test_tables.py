"""Tables, statements, transactions, constraints, persistence; expectations of the small fixtures."""

import datetime as dt
import decimal
import os
import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions.types import coerce, spark_type
from sluice import __main__ as prompt
from sluice.operators.database import Database, MaxRowsError, Session, TransactionError
from sluice.operators.errors import ColumnNotFoundError, EngineError, StatementError
from sluice.operators.query import Select, join_any, not_in
from sluice.operators.table import ConstraintError, Sequence, Table, number_rows
from sluice.plans import dialect
from sluice.sources import files, scratch


@pytest.fixture(scope="module")
def users(spark):
    rows = [(i, f"CODE{i}", f"User{i}", 18 + i % 82, decimal.Decimal(100 + i % 9000), i % 2 == 0) for i in range(1, 601)]
    df = spark.createDataFrame(rows, "ID long, USER_CODE string, NAME string, AGE int, BALANCE decimal(12,2), ACTIVE boolean")
    return df.cache()


@pytest.mark.parametrize(
    ("condition", "rows"),
    [
        ("AGE IN (50, 51, 52)", 21),
        ("AGE IN (50, NULL, 52)", 14),
        ("AGE NOT IN (50, 51, 52)", 579),
        ("AGE IN (50, 51, 52) AND BALANCE > 100 OR NAME = 'User600'", 22),
        ("AGE IN (50, 51, 52) OR BALANCE > 5000 AND NAME = 'User600'", 21),
        ("AGE < 30", 95),
        ("AGE < 30 AND ACTIVE = TRUE", 47),
        ("(AGE < 35 AND ACTIVE = TRUE) OR BALANCE > 500", 244),
        ("AGE = 50 OR BALANCE > 5000 ORDER BY ID LIMIT 10 OFFSET 5", 2),
        ("NAME LIKE 'User60_'", 1),
    ],
)
def test_counts_over_600_users(spark, users, condition, rows):
    db = Database(spark)
    db.register("USERS", users)
    assert db.execute(f"SELECT ID FROM USERS WHERE {condition}").count() == rows


def test_left_join_keeps_unmatched_rows(spark):
    db = Database(spark)
    db.register("USERS", spark.createDataFrame([(i, f"u{i}") for i in range(1, 8)], "ID long, NAME string"))
    db.register("PROFILES", spark.createDataFrame([(i, i) for i in range(1, 7)], "PROFILE_ID long, USER_ID long"))
    on = "ON USERS.ID = PROFILES.USER_ID"
    assert db.execute(f"SELECT NAME, PROFILE_ID FROM USERS LEFT OUTER JOIN PROFILES {on}").count() == 7
    assert db.execute(f"SELECT NAME, PROFILE_ID FROM USERS RIGHT INNER JOIN PROFILES {on}").count() == 6


def test_aggregates_skip_null(spark):
    db = Database(spark)
    db.execute("CREATE TABLE AGG_TEST (ID LONG PRIMARY KEY SEQUENCE(agg_seq 1 1), AMOUNT INTEGER)")
    for v in ("10", "20", "NULL", "30", "NULL"):
        db.execute(f"INSERT INTO AGG_TEST (AMOUNT) VALUES ({v})")
    row = db.execute("SELECT COUNT(*), COUNT(AMOUNT), SUM(AMOUNT), AVG(AMOUNT), MIN(AMOUNT), MAX(AMOUNT) FROM AGG_TEST").first()
    assert tuple(row) == (5, 3, 60, 20.0, 10, 30)
    assert [r.ID for r in db.execute("SELECT ID FROM AGG_TEST ORDER BY ID").collect()] == [1, 2, 3, 4, 5]


def test_types_and_literals():
    assert spark_type("BIGDECIMAL(12, 2)").simpleString() == "decimal(12,2)"
    assert coerce("2024-01-31", "DATE") == dt.date(2024, 1, 31)
    assert coerce("2024-01-31 10:11:12.123", "DATETIME_MS") == dt.datetime(2024, 1, 31, 10, 11, 12, 123000)
    for value, kind in (("300", "BYTE"), (40000, "SHORT"), ("ab", "CHAR"), ("x", "UUID"), ("nan", "DOUBLE"), (1.5, "INTEGER"), ("MAYBE", "BOOLEAN"), ("2024-13-01", "DATE")):
        with pytest.raises(ValueError):
            coerce(value, kind)
    with pytest.raises(ValueError):
        spark_type("JSON")


def test_constraints(spark):
    db = Database(spark)
    db.execute("CREATE TABLE T (ID LONG PRIMARY KEY, CODE STRING, N INTEGER)")
    db.execute("CREATE UNIQUE INDEX ON T (CODE)")
    db.execute("INSERT INTO T (ID, CODE, N) VALUES (1, 'a', -1)")
    db.execute("INSERT INTO T (ID, CODE, N) VALUES (2, NULL, 2)")
    db.execute("INSERT INTO T (ID, CODE, N) VALUES (3, NULL, 2)")
    for bad in ("(1, 'b', 1)", "(NULL, 'b', 1)", "(4, 'a', 1)", "('x', 'b', 1)"):
        with pytest.raises(ValueError):
            db.execute(f"INSERT INTO T (ID, CODE, N) VALUES {bad}")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO T (ID, CODE) VALUES (9, 'z')")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE T SET ID = 5")
    with pytest.raises(ConstraintError):
        db.execute("CREATE UNIQUE INDEX n_index ON T (N)")
    db.execute("CREATE HASH INDEX ON T (N)")
    assert ("HASH INDEX", "N") in db.tables["T"].indexes
    assert db.execute("SELECT * FROM T").count() == 3
    with pytest.raises(KeyError):
        db.execute("DELETE FROM NONE WHERE ID = 1")


def test_bulk_insert_is_all_or_nothing(spark):
    t = Table.create(spark, "B", {"ID": "INTEGER", "NAME": "CHAR"}, "ID").insert(["ID", "NAME"], [1, "a"])
    with pytest.raises(ConstraintError):
        t.bulk_insert(spark.createDataFrame([(2, "b"), (2, "c")], "ID int, NAME string"))
    with pytest.raises(ConstraintError):
        t.bulk_insert(spark.createDataFrame([(1, "b")], "ID int, NAME string"))
    with pytest.raises(ConstraintError):
        t.bulk_insert(spark.createDataFrame([(3, "bc")], "ID int, NAME string"))
    assert t.bulk_insert(spark.createDataFrame([(i, "b") for i in range(2, 500)], "ID int, NAME string")).df.count() == 499
    s = Table.create(spark, "S", {"ID": "LONG", "NAME": "STRING"}, "ID", (Sequence("q", "ID", 5, 2),)).bulk_insert(spark.createDataFrame([("x",), ("y",), ("z",)], "NAME string"))
    assert sorted(map(tuple, s.df.collect())) == [(5, "x"), (7, "y"), (9, "z")]
    assert s.insert(["NAME"], ["w"]).df.where("NAME = 'w'").first().ID == 11


def test_many_changes_keep_plans_short(spark):
    t = Table("N", spark.range(5).toDF("ID"))
    for i in range(30):
        t = t.update({"ID": F.col("ID") + 1}, f"ID >= {i}")
    assert sorted(r.ID for r in t.df.collect()) == [30, 31, 32, 33, 34]
    assert t.changes < 12


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).repartition(7).select(((F.col("id") * 37) % 1000).alias("k"))
    got = {r.k: r.n for r in number_rows(df, "n", 1, 1, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_transactions(spark):
    db = Database(spark)
    db.execute("CREATE TABLE X (ID LONG, NAME STRING)")
    one, two = Session(db), Session(db)
    names = lambda s: sorted(r.NAME for r in s.execute("SELECT NAME FROM X").collect())
    one.execute("BEGIN TRANSACTION ISOLATION LEVEL READ COMMITTED")
    one.execute("INSERT INTO X (ID, NAME) VALUES (1, 'a')")
    assert names(one) == ["a"] and names(two) == []
    two.execute("SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED")
    assert names(two) == ["a"]
    two.execute("SET TRANSACTION ISOLATION LEVEL SERIALIZABLE")
    one.execute("COMMIT")
    assert names(two) == ["a"]
    one.execute("START TRANSACTION")
    one.execute("DELETE FROM X")
    two.execute("INSERT INTO X (ID, NAME) VALUES (2, 'b')")
    assert names(one) == []
    one.execute("ROLLBACK TRANSACTION")
    assert names(one) == ["a", "b"]
    one.execute("SET SESSION AUTOCOMMIT = OFF")
    one.execute("UPDATE X SET NAME = 'c' WHERE ID = 2")
    assert names(two) == ["a", "b"]
    one.execute("COMMIT")
    assert names(two) == ["a", "c"]
    with pytest.raises(TransactionError):
        one.execute("COMMIT")
    db.execute("DROP TABLE X")
    with pytest.raises(KeyError):
        db.execute("ANALYZE TABLE X")


def test_row_limit(spark):
    db = Database(spark, max_rows=50)
    db.register("L", spark.range(100).toDF("ID"))
    with pytest.raises(MaxRowsError):
        db.execute("SELECT ID FROM L")
    assert db.execute("SELECT /* MAX_ROWS=100 */ ID FROM L").count() == 100
    assert db.execute("SELECT /* MAX_ROWS=0 */ ID FROM L").count() == 100
    with pytest.raises(MaxRowsError):
        db.execute("SELECT /* MAX_ROWS=1 */ ID FROM L WHERE ID < 2")


def test_subqueries_in_changes(spark):
    db = Database(spark)
    db.register("A", spark.range(10).toDF("ID"))
    db.register("B", spark.createDataFrame([(1,), (3,), (None,)], "A_ID long"))
    db.execute("DELETE FROM A WHERE ID IN (SELECT A_ID FROM B)")
    assert sorted(r.ID for r in db.execute("SELECT ID FROM A").collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    db.execute("UPDATE A SET ID = 100 WHERE ID > (SELECT MAX(A_ID) FROM B) AND ID < 6")
    assert sorted(r.ID for r in db.execute("SELECT ID FROM A").collect()) == [0, 2, 6, 7, 8, 9, 100, 100]


def test_explain_and_analyze(spark):
    db = Database(spark)
    db.register("A", spark.range(10).toDF("ID"))
    plan = [r.plan for r in db.execute("EXPLAIN ANALYZE SELECT ID FROM A WHERE ID > 3").collect()]
    assert any("Filter" in x for x in plan) and "rows: 6" in plan
    db.execute("EXPLAIN DELETE FROM A WHERE ID > 3")
    assert db.execute("SELECT ID FROM A").count() == 10
    db.execute("EXPLAIN ANALYZE DELETE FROM A WHERE ID > 3")
    assert tuple(db.execute("ANALYZE TABLE A").first()) == ("A", 4, 1.0)


def test_saved_tables_keep_constraints(spark, tmp_path):
    db = Database(spark)
    db.execute("CREATE TABLE P (ID LONG PRIMARY KEY SEQUENCE(p_seq 10 5), NAME STRING, BORN DATE, AMOUNT BIGDECIMAL, T DATETIME_MS, C CHAR, U UUID)")
    db.execute("INSERT INTO P (NAME, BORN, AMOUNT, T, C, U) VALUES ('it''s \"x\"', '1990-05-01', 12.50, '2024-01-31 10:11:12.123', 'Z', '123e4567-e89b-12d3-a456-426614174000')")
    db.execute("INSERT INTO P (NAME, BORN, AMOUNT, T, C, U) VALUES (NULL, NULL, NULL, NULL, NULL, NULL)")
    db.save_all(str(tmp_path))
    back = Database(spark)
    back.load_all(str(tmp_path), ["P"])
    assert sorted(map(tuple, back.tables["P"].df.collect())) == sorted(map(tuple, db.tables["P"].df.collect()))
    back.execute("INSERT INTO P (NAME, BORN, AMOUNT, T, C, U) VALUES ('n', NULL, NULL, NULL, NULL, NULL)")
    assert back.execute("SELECT ID FROM P WHERE NAME = 'n'").first().ID == 20
    assert back.tables["P"].primary_key == "ID"


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', decimal.Decimal("1.50"), dt.date(2024, 1, 2)), (2, "", None, None), (3, None, None, None)], "id int, s string, n decimal(10,2), d date")
    files.write_csv(df.coalesce(1), str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert text.splitlines()[0] == "id,s,n,d" and '2,"",,' in text and "3,,," in text and '1,"a ""b"", c\nd",1.50,2024-01-02' in text
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "x"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_dialect_leaves_literals_alone():
    sql = "SELECT \"My Col\", 'LEFT INNER JOIN \"q\"' FROM a LEFT  INNER JOIN b ON a.x = b.x /* MAX_ROWS=7 */"
    assert dialect.spark_select(sql) == "SELECT `My Col`, 'LEFT INNER JOIN \"q\"' FROM a INNER JOIN b ON a.x = b.x "
    assert dialect.hint(sql) == 7
    assert dialect.parse("UPDATE t SET a = 'x WHERE, y', b = 2 WHERE c = ' SET '").parts == {"set": {"A": "'x WHERE, y'", "B": "2"}, "where": "c = ' SET '"}
    assert dialect.split_top("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
    assert dialect.parse("(" * 150 + "x" + ")" * 150).kind == "query"


def test_quoted_tables(spark):
    db = Database(spark)
    db.execute('CREATE TABLE "MyTable" (ID LONG PRIMARY KEY, "myColumn" STRING)')
    db.execute("INSERT INTO \"MyTable\" (ID, \"myColumn\") VALUES (1, 'x')")
    assert db.execute('SELECT "myColumn" FROM "MyTable"').first()[0] == "x"


def test_cross_join_takes_no_condition(spark):
    a = spark.range(3).toDF("a")
    assert Select(a).join(spark.range(4).toDF("b"), "CROSS").df().count() == 12
    with pytest.raises(ValueError):
        Select(a).join(a, "CROSS", "true")
    assert Select(a).order_by(F.desc("a")).offset(1).df("a + 1 AS x").collect()[0].x == 2


TRUTH = st.sampled_from([True, False, None])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(TRUTH, TRUTH), min_size=1, max_size=9))
def test_three_valued_logic(spark, pairs):
    both = lambda a, b: False if a is False or b is False else None if a is None or b is None else True
    negate = lambda a: None if a is None else not a
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a boolean, b boolean")
    for r in df.selectExpr("a", "b", "a AND b AS x", "a OR b AS y", "NOT (a AND b) AS z").collect():
        assert r.x is both(r.a, r.b) and r.y is negate(both(negate(r.a), negate(r.b))) and r.z is negate(both(r.a, r.b))
    t = Table("t", df)
    assert t.delete("a AND b").df.count() == sum(both(a, b) is not True for a, b in pairs)


def test_joins_against_loops(spark):
    r = random.Random(4)
    left = [(i, r.choice([None, 1, 2, 3])) for i in range(20)]
    right = [(i, r.choice([None, 1, 2, 5])) for i in range(15)]
    a, b = spark.createDataFrame(left, "i int, k int"), spark.createDataFrame(right, "j int, l int")
    pairs = [(x, y) for x, k in left for y, v in right if k is not None and k == v]
    outer = pairs + [(x, None) for x, k in left if not any(p[0] == x for p in pairs)]
    full = outer + [(None, y) for y, v in right if not any(p[1] == y for p in pairs)]
    for kind, want in (("INNER", pairs), ("LEFT", outer), ("FULL", full)):
        assert sorted(map(tuple, Select(a).join(b, kind, "k = l").df("i", "j").collect()), key=str) == sorted(want, key=str)


def test_not_in_against_loops(spark):
    r = random.Random(9)
    for keys in ([], [None], [1, 2], [1, None], [5, 5, 1]):
        rows = [(r.choice([None, 1, 2, 3, 5]),) for _ in range(20)]
        df, other = spark.createDataFrame(rows, "a int"), spark.createDataFrame([(k, "x") for k in keys], "a int, b string")
        want = [x for (x,) in rows if not keys or (x is not None and None not in keys and x not in keys)]
        got = not_in(df, F.col("a") if "a" not in other.columns else df["a"], other)
        assert sorted((x.a for x in got.collect()), key=str) == sorted(want, key=str), keys


def test_not_in_is_no_broadcast_of_all_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = not_in(spark.range(100).toDF("a"), F.col("a"), spark.range(50).select(F.when(F.col("id") > 3, F.col("id")).otherwise(0).alias("k")))
        assert sorted(x.a for x in got.collect()) == [1, 2, 3, *range(50, 100)]
        plan = got._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_on_any_of_some_equalities(spark):
    r = random.Random(5)
    left = [(i, r.choice([None, 1, 2, 3]), r.choice([None, 1, 2])) for i in range(20)]
    right = [(j, r.choice([None, 1, 2, 5]), r.choice([None, 2, 3])) for j in range(15)]
    a, b = spark.createDataFrame(left + left[:3], "i int, k int, m int"), spark.createDataFrame(right, "j int, l int, o int")
    got = join_any(a, b, [F.col("k") == F.col("l"), F.col("m") == F.col("o"), F.col("k") == F.col("o")])
    same = lambda x, y: x is not None and x == y
    want = [(i, j) for i, k, m in left + left[:3] for j, v, o in right if same(k, v) or same(m, o) or same(k, o)]
    assert sorted((x.i, x.j) for x in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_default_names_of_aggregates():
    named = dialect.named_aggregates
    assert named("SELECT COUNT(*), sum( A ) FROM T") == "SELECT COUNT(*) AS `COUNT(*)`, sum( A ) AS `SUM(A)` FROM T"
    for same in ("SELECT A FROM T", "SELECT COUNT(*) AS N FROM T", "SELECT COUNT(A) + COUNT(B) FROM T", "SELECT DISTINCT A FROM T", "WITH X AS (SELECT COUNT(*) FROM T) SELECT * FROM X"):
        assert " ".join(named(same).split()) == same
    assert named("SELECT 'FROM', MAX((SELECT 1 FROM U)) FROM T").endswith("AS `MAX((SELECT 1 FROM U))` FROM T")


def test_results_are_run_once_in_order_and_keep_equal_names(spark):
    db = Database(spark, max_rows=100)
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    db.register("T", spark.range(30).mapInArrow(seen, "id long"))
    got = db.execute("SELECT * FROM T ORDER BY id DESC")
    assert [x.id for x in got.collect()] == list(range(29, -1, -1)) and got.count() == 30
    assert runs.value == 30
    db.register("U", spark.range(3).toDF("id"))
    both = db.execute("SELECT * FROM U A JOIN U B ON A.id = B.id")
    assert both.columns == ["id", "id"] and both.count() == 3
    with pytest.warns(UserWarning, match="near the limit"):
        db.execute("SELECT id FROM T /* MAX_ROWS=31 */")
    assert not [t for t in spark.catalog.listTables() if t.name in ("t", "u", "T", "U")]


def test_errors_slow_log_and_prompt(spark):
    db = Database(spark, slow_seconds=0.0)
    shown = []
    lines = ["CREATE TABLE P (ID INTEGER PRIMARY KEY,\n", " NAME STRING);\n", "INSERT INTO P (ID, NAME) VALUES (1, 'a;b');\n", "INSERT INTO P (ID, NAME) VALUES (1, 'c');\n", "SELECT * FROM P;\n", "SELECT * FROM Q;\n", "quit\n", "DROP TABLE P;\n"]
    prompt.run(db, lines, show=shown.append)
    assert shown[:2] == ["create_table P", "insert P"] and shown[2].startswith("ConstraintError") and shown[3:5] == ["ID | NAME", "1 | a;b"] and shown[5].startswith("TableNotFoundError")
    assert len(db.slow) == 5 and all(s >= 0 for _, s in db.slow)
    for sql, kind in (("SELECT X FROM P", ColumnNotFoundError), ("SELECT FROM WHERE", EngineError), ("CREATE TABLE R (A JSON)", StatementError), ("INSERT INTO P (ID, NAME) VALUES (1, ((2)", StatementError)):
        with pytest.raises(kind):
            db.execute(sql)
    db.execute("ANALYZE TABLE P")
    assert db.statistics["P"]["row_count"] == 1 and db.statistics["P"]["analyzed_at"].tzinfo


def test_csv_header_of_each_file_and_of_an_empty_table(spark, tmp_path):
    df = spark.range(6).repartition(3).toDF("n")
    files.write_csv(df, str(tmp_path / "a"))
    assert all(p.read_text().startswith("n\n") for p in (tmp_path / "a").glob("part-*") if p.stat().st_size)
    assert sorted(x.n for x in files.read_csv(spark, str(tmp_path / "a"), df.schema, line_breaks=False).collect()) == list(range(6))
    files.write_csv(df.limit(0), str(tmp_path / "b"))
    assert "".join(p.read_text() for p in (tmp_path / "b").glob("part-*")) == "n\n"
    assert files.read_csv(spark, str(tmp_path / "b"), df.schema).collect() == []


def test_scratch_folder_must_be_shared():
    def session(master, **conf):
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.root(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.root(session("local-cluster[2,1,1024]"))
    assert scratch.root(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://shared"})) == "hdfs://shared"
    assert scratch.root(session("local[4]")).startswith("file://")


def test_scratch_tables_are_forgotten(spark):
    t = scratch.written(spark.range(3))
    path = t._scratch.removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(path)
    scratch.forget(t)
    assert not os.path.isdir(path)
