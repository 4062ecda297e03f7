"""DDL, DML, constraints, transactions, recovery and EXPLAIN, through sessions on a folder."""

import io
import uuid

import pytest

from lodestone import cli
from lodestone.errors import EngineError
from lodestone.session import Session
from tests.support import rows


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


@pytest.fixture
def db(spark, root):
    session = Session(spark, root)
    run(session, "CREATE DATABASE company")
    return session


def run(session, *statements):
    for statement in statements:
        result = session.execute(statement)
        assert result.success, f"{statement}: {result.message}"
    return result.message


def refused(session, statement, message):
    result = session.execute(statement)
    assert not result.success and message in result.message, result.message


def test_insert_update_delete(db):
    run(db, "CREATE TABLE E (id INT, name STRING NULL, pay DOUBLE)")
    assert run(db, 'INSERT INTO E VALUES (1, "a", 1.0), (2, NULL, 2.0)') == "inserted 2 row(s)"
    assert run(db, 'INSERT INTO E VALUES (3, "c", 3.0)') == "inserted 1 row(s)"
    assert run(db, "UPDATE E SET pay = 9.5 WHERE id > 1") == "updated 2 row(s)"
    assert run(db, "DELETE FROM E WHERE name = NULL") == "deleted 1 row(s)"
    assert rows(db, "SELECT * FROM E ORDER BY id") == [(1, "a", 1.0), (3, "c", 9.5)]
    refused(db, "INSERT INTO E VALUES (1)", "column count")
    refused(db, 'INSERT INTO E VALUES ("x", "y", 1.0)', "type mismatch")
    refused(db, "INSERT INTO E VALUES (NULL, NULL, 1.0)", "NOT NULL constraint violation on column id")
    refused(db, "UPDATE E SET nope = 1", "unknown update column")
    assert run(db, "DELETE FROM E") == "deleted 2 row(s)"


def test_keys_and_checks(db):
    run(db, "CREATE TABLE A (id INT PRIMARY KEY, email STRING NULL UNIQUE, v DOUBLE NULL CHECK (v > 0.0 OR v = -1.0))", 'INSERT INTO A VALUES (1, "x", 1.0), (2, NULL, NULL), (3, NULL, -1.0)')
    refused(db, "INSERT INTO A VALUES (1, NULL, 1.0)", "UNIQUE constraint violation on column id")
    refused(db, 'INSERT INTO A VALUES (5, "x", 1.0)', "UNIQUE constraint violation on column email")
    refused(db, "INSERT INTO A VALUES (6, NULL, 1.0), (6, NULL, 1.0)", "UNIQUE")
    refused(db, "INSERT INTO A VALUES (7, NULL, -2.0)", "CHECK constraint violation: v > 0.0 OR v = -1.0")
    refused(db, "UPDATE A SET v = -2.0 WHERE id = 1", "CHECK constraint violation")
    assert len(rows(db, "SELECT id FROM A")) == 3


def test_L22_update_is_atomic(db):
    run(db, "CREATE TABLE A (id INT PRIMARY KEY, k INT UNIQUE)", "INSERT INTO A VALUES (1, 10), (2, 20), (3, 30)")
    refused(db, "UPDATE A SET k = 99 WHERE id > 1", "UNIQUE constraint violation on column k")
    assert rows(db, "SELECT k FROM A ORDER BY id") == [10, 20, 30]


def test_composite_keys(db):
    run(db, "CREATE TABLE P (a INT, b INT, PRIMARY KEY (a, b))", "CREATE TABLE K (id INT PRIMARY KEY, a INT NULL, b INT NULL, FOREIGN KEY (a, b) REFERENCES P(a, b) ON DELETE SET NULL)", "INSERT INTO P VALUES (1, 2), (1, 3)")
    run(db, "INSERT INTO K VALUES (10, 1, 2), (11, 1, NULL), (12, NULL, 2)")
    refused(db, "INSERT INTO P VALUES (1, 2)", "UNIQUE")
    refused(db, "INSERT INTO K VALUES (13, 9, 9)", "FOREIGN KEY constraint violation on column a, b")
    refused(db, "INSERT INTO K VALUES (13, 1, 9)", "FOREIGN KEY")
    run(db, "DELETE FROM P WHERE b = 2")
    assert rows(db, "SELECT * FROM K ORDER BY id") == [(10, None, None), (11, 1, None), (12, None, 2)]
    refused(db, "CREATE TABLE Q (a INT REFERENCES P(a))", "exact PRIMARY KEY or UNIQUE")
    refused(db, "CREATE TABLE Q (a INT, b INT, FOREIGN KEY (a, b) REFERENCES P(a, b) ON DELETE SET NULL)", "requires nullable")


def family(db, action):
    run(db, "CREATE TABLE P (id INT PRIMARY KEY)", f"CREATE TABLE C (id INT PRIMARY KEY, p INT NULL, FOREIGN KEY (p) REFERENCES P(id) {action})", "INSERT INTO P VALUES (1), (2)", "INSERT INTO C VALUES (10, 1), (11, 1), (20, 2)")
    return db


def test_delete_actions(spark, tmp_path):
    def made(action):
        session = Session(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
        run(session, "CREATE DATABASE d")
        return family(session, action)

    cascade = made("ON DELETE CASCADE")
    run(cascade, "DELETE FROM P WHERE id = 1")
    assert rows(cascade, "SELECT id FROM C") == [20]
    nulls = made("ON DELETE SET NULL")
    run(nulls, "DELETE FROM P WHERE id = 1")
    assert rows(nulls, "SELECT p FROM C ORDER BY id") == [None, None, 2]
    plain = made("")
    refused(plain, "DELETE FROM P WHERE id = 1", "key is still referenced")
    refused(plain, "UPDATE P SET id = 7 WHERE id = 1", "key is still referenced")
    refused(plain, "DROP TABLE P", "referenced by a FOREIGN KEY")
    refused(plain, "RENAME TABLE P TO Q", "referenced by a FOREIGN KEY")
    both = made("ON UPDATE CASCADE")
    run(both, "UPDATE P SET id = 7 WHERE id = 1")
    assert rows(both, "SELECT p FROM C ORDER BY id") == [7, 7, 2]
    away = made("ON UPDATE SET NULL")
    run(away, "UPDATE P SET id = 7 WHERE id = 1")
    assert rows(away, "SELECT p FROM C ORDER BY id") == [None, None, 2]


def test_self_reference_and_depth(db, monkeypatch):
    from lodestone.catalog import dml

    monkeypatch.setattr(dml, "MAX_ACTION_DEPTH", 4)
    run(db, "CREATE TABLE N (id INT PRIMARY KEY, up INT NULL, FOREIGN KEY (up) REFERENCES N(id) ON DELETE CASCADE)", "INSERT INTO N VALUES (1, NULL), (2, 1), (3, 2), (4, 3)")
    run(db, "DELETE FROM N WHERE id = 1")
    assert rows(db, "SELECT id FROM N") == []
    run(db, "INSERT INTO N VALUES (1, NULL), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)")
    refused(db, "DELETE FROM N WHERE id = 1", "CASCADE depth exceeded")
    assert len(rows(db, "SELECT id FROM N")) == 7


def test_ddl(db):
    run(db, "CREATE TABLE T (id INT PRIMARY KEY, a INT NULL, CHECK (a > 0))", "INSERT INTO T VALUES (1, 5)", "CREATE INDEX i ON T(a)", "CREATE INDEX j ON T((a+1))")
    refused(db, "CREATE TABLE T (x INT)", "already exists")
    refused(db, "ALTER TABLE T DROP COLUMN a", "used by CHECK")
    refused(db, "ALTER TABLE T ADD COLUMN b INT NOT NULL", "needs a DEFAULT")
    refused(db, "DROP INDEX __pk_id ON T", "cannot drop constraint index")
    run(db, "ALTER TABLE T ADD COLUMN b STRING NOT NULL DEFAULT \"x\"", "ALTER TABLE T RENAME COLUMN a TO c")
    assert db.query("SELECT * FROM T").columns == ["id", "c", "b"]
    refused(db, "INSERT INTO T VALUES (2, -1, \"y\")", "CHECK constraint violation: c > 0")
    run(db, "ALTER TABLE T DROP COLUMN c CASCADE", 'INSERT INTO T VALUES (2, "y")')
    assert rows(db, "SELECT * FROM T ORDER BY id") == [(1, "x"), (2, "y")]
    run(db, "ALTER TABLE T ADD COLUMN c INT NULL")  # the old column does not come back
    assert rows(db, "SELECT c FROM T") == [None, None]
    run(db, "RENAME TABLE T TO U")
    assert rows(db, "LIST TABLES") == ["U"]
    run(db, "DROP TABLE U", "DROP DATABASE company")
    refused(db, "LIST TABLES", "no active database")


def test_transaction_visibility(spark, root, db):
    run(db, "CREATE TABLE T (id INT, v INT)", "INSERT INTO T VALUES (1, 1), (2, 2)")
    reader, writer = Session(spark, root), Session(spark, root)
    run(reader, "BEGIN")
    assert rows(reader, "SELECT v FROM T ORDER BY id") == [1, 2]
    run(writer, "BEGIN", "UPDATE T SET v = 9 WHERE id = 1")
    assert rows(writer, "SELECT v FROM T ORDER BY id") == [9, 2]
    assert rows(reader, "SELECT v FROM T ORDER BY id") == [1, 2]
    run(writer, "COMMIT")
    assert rows(reader, "SELECT v FROM T ORDER BY id") == [1, 2]
    refused(reader, "COMMIT", "serialization failure")  # it read a row that has been written since
    assert rows(reader, "SELECT v FROM T ORDER BY id") == [9, 2]
    refused(reader, "COMMIT", "no active transaction")
    run(reader, "BEGIN")
    refused(reader, "BEGIN", "already active")
    refused(reader, "DROP DATABASE company", "in a transaction")
    run(reader, "CREATE TABLE X (id INT)", "INSERT INTO X VALUES (1)", "ROLLBACK")
    assert rows(reader, "LIST TABLES") == ["T"]


@pytest.mark.parametrize(
    ("first", "second", "conflict"),
    [
        (["SELECT v FROM T WHERE id = 2", "UPDATE T SET v = 0 WHERE id = 1"], ["SELECT v FROM T WHERE id = 1", "UPDATE T SET v = 0 WHERE id = 2"], True),  # write skew
        (["UPDATE T SET v = 5 WHERE id = 1"], ["UPDATE T SET v = 6 WHERE id = 1"], True),
        (["INSERT INTO T VALUES (7, 50)"], ["SELECT id FROM T WHERE v > 40", "INSERT INTO T VALUES (8, 1)"], True),  # phantom
        (["INSERT INTO T VALUES (7, 50)"], ["INSERT INTO T VALUES (8, 60)"], False),
        (["UPDATE T SET v = 5 WHERE id = 1"], ["SELECT v FROM U", "INSERT INTO U VALUES (1)"], False),
        (["INSERT INTO U VALUES (1)"], ["INSERT INTO U VALUES (1)"], True),  # the same key
    ],
)
def test_serializable(spark, root, db, first, second, conflict):
    run(db, "CREATE TABLE T (id INT, v INT)", "CREATE TABLE U (v INT PRIMARY KEY)", "INSERT INTO T VALUES (1, 1), (2, 2)")
    one, two = Session(spark, root), Session(spark, root)
    run(one, "BEGIN")
    run(two, "BEGIN")
    run(one, *first)
    run(two, *second)
    run(one, "COMMIT")
    if conflict:
        refused(two, "COMMIT", "serialization failure")
    else:
        run(two, "COMMIT")
        assert len(rows(db, "SELECT id FROM T")) == len([s for s in first + second if "INTO T" in s]) + 2
    run(two, "BEGIN", "ROLLBACK")


def test_save_load_and_recovery(spark, root, db):
    from lodestone.catalog.store import Store

    run(db, "CREATE TABLE T (id INT)", "INSERT INTO T VALUES (1)", "SAVE DATABASE", "INSERT INTO T VALUES (2)")
    Store._stores.clear()
    again = Session(spark, root)  # as after a restart: commits since the save are there
    assert rows(again, "SELECT id FROM T ORDER BY id") == [1, 2]
    run(again, "LOAD DATABASE")
    assert rows(again, "SELECT id FROM T") == [1]
    run(again, "BEGIN", "INSERT INTO T VALUES (3)", "SAVE DATABASE")
    refused(again, "COMMIT", "no active transaction")
    run(again, "BEGIN", "INSERT INTO T VALUES (4)", "LOAD DATABASE company")
    assert rows(again, "SELECT id FROM T ORDER BY id") == [1, 3]
    refused(again, "LOAD DATABASE nowhere", "no saved database")


def test_crash_points(spark, root, db):
    from lodestone.catalog.store import Store

    run(db, "CREATE TABLE T (id INT)")
    for point, expected in (("before", []), ("after", [1])):
        run(db, "BEGIN", "INSERT INTO T VALUES (1)")
        db.arm_crash(point)
        refused(db, "COMMIT", "simulated crash")
        Store._stores.clear()
        db = Session(spark, root)
        assert rows(db, "SELECT id FROM T") == expected
    before = db.durable_syncs
    db.set_durability(False)
    run(db, "INSERT INTO T VALUES (2)")
    assert db.durable_syncs == before


def test_prepared(db):
    run(db, "CREATE TABLE T (id INT, v STRING NULL)", 'PREPARE add AS "INSERT INTO T VALUES (?, ?);"', 'EXECUTE add VALUES (1, "a")', "EXECUTE add VALUES (2, NULL)", 'PREPARE q AS "SELECT id FROM T WHERE v = ?"')
    assert rows(db, "EXECUTE q VALUES (NULL)") == [2]
    refused(db, "EXECUTE q VALUES ()", "not enough")
    refused(db, "EXECUTE q VALUES (1, 2)", "too many")
    refused(db, "EXECUTE nope VALUES (1)", "unknown prepared statement")
    refused(db, "SELECT id FROM T WHERE id = ?", "EXECUTE")
    assert db.prepared_ast("q") is not None


def plan(db, sql):
    return "\n".join(r[0] for r in db.execute(sql).rows)


def test_explain(db):
    run(db, "CREATE TABLE E (id INT, dept INT, city INT, name STRING)", "CREATE INDEX a ON E(id)", "CREATE INDEX b ON E(dept)", "CREATE INDEX c ON E(city)")
    run(db, "INSERT INTO E VALUES " + ", ".join(f'({i}, {i % 10}, {i // 10 % 10}, "n{i}")' for i in range(200)), "ANALYZE TABLE E")
    assert plan(db, "EXPLAIN SELECT name FROM E WHERE id = 1").startswith("hash index equality lookup on id\nresidual: no\nest_rows=1 cost=1")
    assert "multi-index intersect on dept, city" in plan(db, "EXPLAIN SELECT name FROM E WHERE dept = 1 AND city = 1")
    assert "multi-index union on dept, city" in plan(db, "EXPLAIN SELECT name FROM E WHERE dept = 1 OR city = 1")
    assert "union(dept, city)" in plan(db, "EXPLAIN SELECT name FROM E WHERE id < 190 AND dept = 1 AND (dept = 2 OR city = 1)")
    assert "hash index IN lookup on dept (2 values)" in plan(db, "EXPLAIN SELECT name FROM E WHERE dept = 1 OR dept = 2")
    assert "ordered index range lookup on id" in plan(db, "EXPLAIN SELECT name FROM E WHERE id > 190")
    assert "full table scan" in plan(db, 'EXPLAIN SELECT name FROM E WHERE name ~ "x"')
    text = plan(db, "EXPLAIN ANALYZE SELECT name FROM E WHERE dept = 1 AND name = \"n1\"")
    assert "residual: yes" in text and "actual_rows=1" in text and "candidates=20" in text and "actual_time_ms=" in text
    assert plan(db, "EXPLAIN WITH w AS (SELECT id, name FROM E WHERE dept > 2) SELECT name FROM w WHERE id = 1").startswith("hash index equality lookup on id\nresidual filter applied after index lookup\ninlined CTE w")
    assert "materialized CTE w" in plan(db, "EXPLAIN WITH w AS MATERIALIZED (SELECT id, name FROM E) SELECT name FROM w WHERE id = 1")
    assert plan(db, "EXPLAIN UPDATE E SET name = \"x\" WHERE id = 1").startswith("update: hash index equality")
    assert plan(db, "EXPLAIN DELETE FROM E WHERE id = 1").startswith("delete: hash index equality")
    assert plan(db, 'EXPLAIN INSERT INTO E VALUES (1, 1, 1, "a")') == "insert: 1 row(s) into E"
    assert "hash join" in plan(db, "EXPLAIN SELECT * FROM E a JOIN E b ON a.name = b.name") and plan(db, "EXPLAIN SELECT COUNT(*) FROM E").endswith("aggregation")
    run(db, "CREATE INDEX d ON E(dept, city)", "CREATE INDEX t ON E((trigram(name)))", "CREATE INDEX n ON E((-id))")
    assert "composite index equality" in plan(db, "EXPLAIN SELECT name FROM E WHERE dept = 1 AND city = 1")
    assert "trigram index intersect on name" in plan(db, 'EXPLAIN SELECT name FROM E WHERE name LIKE "%n19%"')
    assert "expression hash index equality lookup on (-id)" in plan(db, "EXPLAIN SELECT name FROM E WHERE (-id) = -5")


def test_many_segments_merge(db, monkeypatch):
    from lodestone.catalog import store

    monkeypatch.setattr(store, "MAX_SEGMENTS", 3)
    run(db, "CREATE TABLE T (id INT PRIMARY KEY)", *(f"INSERT INTO T VALUES ({i})" for i in range(6)))
    assert len(db.current_database.tables["T"].segments) <= 3 and rows(db, "SELECT id FROM T ORDER BY id") == list(range(6))


def test_large_segments_are_not_merged(db, monkeypatch):
    from lodestone.catalog import store

    monkeypatch.setattr(store, "MAX_SEGMENTS", 2)
    monkeypatch.setattr(store, "SMALL_BYTES", 0)
    run(db, "CREATE TABLE T (id INT PRIMARY KEY)", *(f"INSERT INTO T VALUES ({i})" for i in range(4)))
    assert len(db.current_database.tables["T"].segments) == 4 and rows(db, "SELECT id FROM T ORDER BY id") == list(range(4))


def test_a_change_rewrites_the_files_that_it_hits(db, spark):
    db.import_table("T", spark.range(0, 1000, 1, 8).selectExpr("id", "id AS v"), primary="id")
    before = set(db.current_database.tables["T"].segments)
    assert len(before) == 8
    run(db, "UPDATE T SET v = 0 WHERE id = 500")
    assert len(before - set(db.current_database.tables["T"].segments)) == 1
    run(db, "DELETE FROM T WHERE id = 900")
    assert len(before - set(db.current_database.tables["T"].segments)) == 2
    assert rows(db, "SELECT COUNT(*), SUM(v) FROM T") == [(999, 499500 - 500 - 900)]


def test_vacuum(db, spark, root):
    run(db, "CREATE TABLE T (id INT)", "INSERT INTO T VALUES (1), (2)", "INSERT INTO T VALUES (3)", "SAVE DATABASE", "UPDATE T SET id = 9 WHERE id = 1", "DELETE FROM T WHERE id = 9", "CREATE TABLE U (id INT)", "INSERT INTO U VALUES (1)", "DROP TABLE U")
    run(db, "BEGIN")
    with pytest.raises(EngineError, match="transactions are open"):
        db.vacuum()
    run(db, "ROLLBACK")
    assert db.vacuum() >= 2 and db.vacuum() == 0
    assert rows(db, "SELECT id FROM T ORDER BY id") == [2, 3]
    run(db, "LOAD DATABASE")
    assert rows(db, "SELECT id FROM T ORDER BY id") == [1, 2, 3]


def test_store_of_another_application(spark, root, db):
    from lodestone.catalog.store import Store

    assert Store.at(spark, root) is db.store and Store.at(spark, root + "/") is db.store
    Store._stores[("ended", root)] = Store._stores.pop((spark.sparkContext.applicationId, root))
    assert Store.at(spark, root) is not db.store


def test_tables_by_themselves(db):
    run(db, "CREATE TABLE T (id INT PRIMARY KEY, v INT NULL)", "CREATE INDEX i ON T(v)", "INSERT INTO T VALUES (1, 5), (2, NULL)")
    db.insert_row("T", (3, 5))
    with pytest.raises(EngineError, match="UNIQUE"):
        db.insert_row("T", (3, 6))
    found = {r["id"]: r["__row_id"] for r in db.lookup("T", {"v": 5}).collect()}
    assert set(found) == {1, 3} and [r["id"] for r in db.lookup("T", {"v": None}).collect()] == [2]
    assert db.row("T", found[3]) == (3, 5) and db.row("T", 999) is None
    assert db.update_row("T", found[3], "v", 8) and not db.update_row("T", 999, "v", 8)
    assert db.row("T", found[3]) == (3, 8) and db.erase_row("T", found[1]) and not db.erase_row("T", found[1])
    assert rows(db, "SELECT * FROM T ORDER BY id") == [(2, None), (3, 8)]
    with pytest.raises(EngineError, match="no index"):
        db.lookup("T", {"id": 1, "v": 2})
    table = db.detach_table("T")
    refused(db, "SELECT id FROM T", "unknown table T")
    db.attach_table(table)
    with pytest.raises(EngineError, match="already exists"):
        db.attach_table(table)
    db.clone_database("copy")
    run(db, "DELETE FROM T")
    assert db.current_database.name == "copy" and rows(db, "SELECT id FROM T") == []


def test_explain_runs_nothing(db, spark):
    run(db, "CREATE TABLE T (id INT, up INT)", "INSERT INTO T VALUES (1, 0), (2, 1), (3, 2)")
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "explain")
    text = plan(db, "EXPLAIN WITH RECURSIVE r AS (SELECT id FROM T WHERE id = 1 UNION SELECT T.id FROM T JOIN r ON T.up = r.id), m AS MATERIALIZED (SELECT id FROM T) SELECT r.id FROM r JOIN m ON r.id = m.id")
    assert "materialized recursive CTE r" in text and not context.statusTracker().getJobIdsForGroup(group)
    context.setLocalProperty("spark.jobGroup.id", None)


def test_import(db, spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert db.import_table("T", df, primary="id") == 2
    run(db, 'INSERT INTO T VALUES (3, "c")', "UPDATE T SET v = \"z\" WHERE id = 2")
    assert rows(db, "SELECT * FROM T ORDER BY id") == [(1, "a"), (2, "z"), (3, "c")]
    refused(db, 'INSERT INTO T VALUES (2, "c")', "UNIQUE")


def test_cli(spark, root):
    out, errors = io.StringIO(), io.StringIO()
    script = ["CREATE DATABASE d;\n", "CREATE TABLE T (id INT, n STRING NULL);\n", "-- a comment\n", 'INSERT INTO T VALUES (1, "x"), (2, NULL);\n', "SELECT * FROM T ORDER BY id;\n", "SELECT nope FROM T;\n", "EXIT;\n", "never"]
    assert cli.main(root, script, out, errors, spark) == 0
    assert out.getvalue().splitlines() == ["created database", "created table", "inserted 2 row(s)", "selected rows", "id\tn", "1\tx", "2\tNULL", "bye"]
    assert errors.getvalue() == "error: unknown column nope\n"


def test_parquet_folder(spark, tmp_path):
    from lodestone.sources.tables import ParquetFolder

    spark.range(3).toDF("id").write.parquet(f"file://{tmp_path}/T.parquet")
    folder = ParquetFolder(spark, f"file://{tmp_path}/")
    assert list(folder) == ["T"] and len(folder) == 1 and "U" not in folder
    session = Session(spark, tables=folder)
    assert rows(session, "SELECT id FROM T WHERE id > 0 ORDER BY id") == [1, 2]
    refused(session, "SELECT id FROM U", "unknown table U")
