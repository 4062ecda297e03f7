"""Queries with the answers they must give, and the deviations decided on, by their ledger number."""

import pytest

from lodestone.operators.recursion import Limits
from tests.support import bag, rows, session


@pytest.fixture(scope="module")
def db(spark):
    return session(spark)


CASES = [
    # filters, order
    ("SELECT title FROM Boats WHERE metres > 9.0 ORDER BY metres DESC LIMIT 2", ["Heron", "Osprey"]),
    ("SELECT id FROM Boats WHERE (-metres) < -12.0 ORDER BY id", [1, 3]),
    ("SELECT id FROM Gauges WHERE (level-4) > 3 ORDER BY id", [2, 3]),
    ('SELECT skipper FROM Logs WHERE skipper LIKE "In%" ORDER BY id', ["Ines", "Inga"]),
    ('SELECT id FROM Logs WHERE entry LIKE "%calm%" ORDER BY id', [1, 3]),
    ('SELECT id FROM Logs WHERE entry LIKE "f_g"', [2]),
    ('SELECT skipper FROM Logs WHERE entry ~ "^sea.*later$"', ["Inga"]),
    ('SELECT id FROM Signs WHERE call LIKE "%a%"', [3]),
    ("SELECT id FROM Signs WHERE call = NULL", [2]),
    ('SELECT id FROM Signs WHERE call < "N" ORDER BY id', [2, 3]),
    ("SELECT id FROM Signs WHERE call > NULL ORDER BY id", [1, 3]),
    ('SELECT id FROM Signs WHERE call IN (NULL, "Sol") ORDER BY id', [1, 2]),
    ("SELECT tag FROM Crates WHERE id = 1 AND (dry = 1 OR red = 1) ORDER BY tag", ["dry", "red"]),
    # joins
    ("SELECT Boats.title, Ports.town FROM Boats LEFT JOIN Ports ON Boats.port = Ports.id ORDER BY Boats.title", [("Heron", "Bergen"), ("Kestrel", None), ("Osprey", "Bergen"), ("Plover", None)]),
    ("SELECT b.title, p.town FROM Boats b RIGHT JOIN Ports p ON b.port = p.id WHERE p.id > 7 ORDER BY p.town", [(None, "Oban"), (None, "Vigo")]),
    ("SELECT b.id, p.town FROM Boats b FULL OUTER JOIN Ports p ON b.port = p.id WHERE b.id > 1 ORDER BY b.id", [(2, None), (3, "Bergen"), (4, None)]),
    ("SELECT COUNT(*) FROM Boats b FULL OUTER JOIN Ports p ON b.port = p.id", [6]),
    ("SELECT COUNT(*) FROM Boats CROSS JOIN Ports", [12]),
    ("SELECT Tides.mark, Moons.phase FROM Tides JOIN Moons ON Tides.slot = Moons.slot ORDER BY Tides.mark", [("third tide", "waxing"), ("unknown tide", "unseen")]),
    ("SELECT b.title, q.least FROM Boats b LEFT JOIN Quotas q ON b.metres > q.least ORDER BY b.title LIMIT 3", [("Heron", 10.0), ("Heron", 13.0), ("Kestrel", None)]),
    ('SELECT b.title FROM Boats b LEFT JOIN Ports p ON b.port = p.id WHERE p.town > "A" ORDER BY b.title', ["Heron", "Osprey"]),
    # aggregates
    ("SELECT zone, COUNT(*), SUM(paid) FROM Fees GROUP BY zone ORDER BY zone", [(None, 2, 12.25), (2, 1, 9.0), (3, 2, 32.0)]),
    ("SELECT SUM(level), AVG(level), MIN(drift), COUNT(drift) FROM Gauges", [(30, 10.0, 0.5, 2)]),
    ("SELECT COUNT(*), MIN(note), SUM(id) FROM Vacant", [(0, None, None)]),
    # set operations
    ("SELECT id FROM P INTERSECT ALL SELECT id FROM Q", [6, 6]),
    ("SELECT id FROM P EXCEPT ALL SELECT id FROM Q ORDER BY id", [5, 6, 7]),
    ("SELECT id FROM P UNION SELECT id FROM Q EXCEPT SELECT id FROM S ORDER BY id", [5, 7, 8]),
    # recursion
    ("WITH RECURSIVE rig AS (SELECT id, above, label FROM Gear WHERE label = \"mast\" UNION ALL SELECT Gear.id, Gear.above, Gear.label FROM Gear JOIN rig ON Gear.above = rig.id) SELECT label FROM rig ORDER BY id", ["mast", "boom", "reef"]),
    ("WITH RECURSIVE reach AS (SELECT src FROM Lanes WHERE src = 2 UNION SELECT Lanes.dst FROM Lanes JOIN reach ON Lanes.src = reach.src) SELECT src FROM reach ORDER BY src", [1, 2, 3, 4]),
    ("WITH RECURSIVE up AS (SELECT id FROM Locks WHERE id = 10 UNION SELECT Locks.after FROM Locks JOIN down ON Locks.id = down.id), down AS (SELECT id FROM Locks WHERE id = 20 UNION SELECT Locks.after FROM Locks JOIN up ON Locks.id = up.id) SELECT id FROM down ORDER BY id", [20, 40]),
    # subqueries
    ("SELECT title FROM Boats WHERE EXISTS (SELECT boat FROM Trips WHERE boat = Boats.id AND miles > 300.0)", ["Heron"]),
    ("SELECT title FROM Boats b WHERE EXISTS (SELECT s.port FROM Berths s JOIN Ports p ON s.port = p.id WHERE s.boat = b.id) ORDER BY id", ["Heron", "Osprey"]),
    ("SELECT title FROM Boats b WHERE EXISTS (SELECT id FROM Ports WHERE EXISTS (SELECT boat FROM Trips WHERE boat = b.id AND EXISTS (SELECT miles FROM Trips t WHERE t.boat = b.id AND t.miles < 20.0)))", ["Plover"]),
    ("SELECT title FROM Boats WHERE id IN (SELECT boat FROM Trips WHERE boat = id) ORDER BY id", ["Heron", "Kestrel", "Plover"]),
    ("SELECT title FROM Boats WHERE EXISTS (WITH far AS (SELECT boat FROM Trips WHERE boat = Boats.id AND miles > 50.0) SELECT boat FROM far) ORDER BY id", ["Heron", "Kestrel"]),
    ("SELECT title FROM Boats b WHERE id = 3 OR EXISTS (SELECT * FROM Trips t WHERE t.boat = b.id AND t.miles < 20.0) ORDER BY id", ["Osprey", "Plover"]),
    ("SELECT title FROM Boats WHERE id IN (SELECT COUNT(*) FROM Trips WHERE boat = Boats.id)", []),
    ("SELECT title FROM Boats WHERE id IN (SELECT COUNT(*) FROM Berths) ORDER BY id", ["Osprey"]),
    # CTEs over joins
    ("WITH moored AS (SELECT * FROM Boats JOIN Berths ON id = boat) SELECT Boats.title, Berths.port FROM moored ORDER BY Boats.title LIMIT 2", [("Heron", 7), ("Kestrel", 4)]),
]


@pytest.mark.parametrize(("sql", "expected"), CASES)
def test_answers(db, sql, expected):
    assert rows(db, sql) == expected


def test_output_names(db):
    assert db.query("SELECT zone, COUNT(*), MAX(paid) FROM Fees GROUP BY zone").columns == ["zone", "COUNT(*)", "MAX(paid)"]
    assert db.query("SELECT b.title FROM Boats b JOIN Ports p ON b.port = p.id").columns == ["Boats.title"]


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT id FROM Boats JOIN Ports ON port = id", "ambiguous"), ("SELECT *, COUNT(*) FROM P", "not allowed with aggregates"),
        ("SELECT title, COUNT(*) FROM Boats", "GROUP BY or an aggregate"), ("SELECT COUNT(*) FROM Boats GROUP BY keel", "unknown GROUP BY column"),
        ("SELECT id FROM P UNION SELECT id, town FROM Ports", "equal column counts"), ('SELECT id FROM Logs WHERE entry ~ "(["', "invalid regex"),
        ("SELECT keel FROM P", "unknown column"), ("SELECT id FROM Wharf", "unknown table"), ("SELECT SUM(town) FROM Ports", "numeric"),
    ],
)
def test_errors(db, sql, message):
    result = db.execute(sql)
    assert not result.success and message in result.message


def deep(levels: int) -> str:
    inner = "SELECT boat FROM Berths WHERE boat = b.id"
    for i in range(levels - 1):
        inner = f"SELECT id FROM Ports p{i} WHERE EXISTS ({inner})"
    return f"SELECT title FROM Boats b WHERE EXISTS ({inner}) ORDER BY id"


def test_correlation_depth(db):
    for levels in (3, 8):
        assert rows(db, deep(levels)) == ["Heron", "Kestrel", "Osprey"]
    assert "maximum depth" in db.execute(deep(9)).message


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT title FROM Boats b WHERE EXISTS (WITH RECURSIVE rig AS (SELECT id FROM Gear WHERE id = 3 UNION ALL SELECT Gear.id FROM Gear JOIN rig ON Gear.above = rig.id) SELECT id FROM rig WHERE rig.id = b.id)", ["Osprey"]),
        ("SELECT title FROM Boats b WHERE id IN (SELECT boat FROM Trips WHERE boat = b.id AND miles > 80.0 UNION SELECT id FROM Gear WHERE label = \"keel\")", ["Heron", "Kestrel", "Plover"]),
        ("SELECT title FROM Boats b WHERE id IN (SELECT boat FROM Trips t WHERE t.boat = b.id EXCEPT SELECT boat FROM Berths)", ["Plover"]),
        ("SELECT title FROM Boats b WHERE 12.75 = b.metres OR id IN (SELECT boat FROM Trips t WHERE t.boat = b.id AND t.miles > 90.0)", None),
        ("SELECT title FROM Boats b WHERE id IN (SELECT boat FROM Trips t WHERE t.boat = b.id ORDER BY miles LIMIT 1)", ["Heron", "Kestrel", "Plover"]),
        ("SELECT title FROM Boats b WHERE EXISTS (SELECT boat, COUNT(*) FROM Trips t WHERE t.boat = b.id GROUP BY boat)", ["Heron", "Kestrel", "Plover"]),
        ("SELECT title FROM Boats b WHERE EXISTS (SELECT x.boat FROM (SELECT boat, miles FROM Trips WHERE miles < 50.0) AS x WHERE x.boat = b.id)", ["Heron", "Plover"]),
        ("SELECT title FROM Boats b WHERE EXISTS (SELECT * FROM Trips t LEFT JOIN Berths s ON t.boat = s.boat WHERE s.port = b.port AND t.boat = b.id)", ["Heron", "Kestrel", "Plover"]),
        ("SELECT title FROM Boats b WHERE EXISTS (SELECT * FROM Berths s WHERE s.boat > b.id)", ["Heron", "Kestrel"]),
        ("SELECT title FROM Boats WHERE id IN (SELECT boat FROM Berths) AND (port = 4 OR EXISTS (SELECT * FROM Ports p WHERE p.id = Boats.port)) AND title LIKE \"%e%\"", ["Heron", "Kestrel", "Osprey"]),
        ("SELECT mark FROM Tides WHERE slot IN (SELECT slot FROM Moons)", ["third tide", "unknown tide"]),
        ("SELECT phase FROM Moons WHERE EXISTS (SELECT * FROM Tides WHERE Tides.slot = Moons.slot)", ["unseen", "waxing"]),
        ("WITH far AS (SELECT boat FROM Trips WHERE miles > 80.0) SELECT title FROM Boats WHERE id IN (SELECT boat FROM far)", ["Heron", "Kestrel"]),
        ("SELECT id FROM P UNION ALL SELECT id FROM Q WHERE id IN (SELECT id FROM S)", [5, 6, 6, 6, 6, 6, 7]),
        ("SELECT title FROM Boats b WHERE EXISTS (SELECT * FROM Quotas q WHERE q.least > b.metres ORDER BY least LIMIT 1)", ["Kestrel", "Osprey", "Plover"]),
    ],
)
def test_subqueries_of_all_shapes(db, sql, expected):
    if expected is None:
        assert not db.execute(sql).success  # a literal cannot stand on the left
    else:
        assert bag(db, sql) == expected


def test_ctes_are_made_once(spark, monkeypatch):
    from lodestone.operators import recursion
    from lodestone.plans import compiler

    made, run, checkpointed = [], recursion.run, compiler.checkpointed
    monkeypatch.setattr(compiler, "checkpointed", lambda df: made.append("table") or checkpointed(df))
    monkeypatch.setattr(recursion, "run", lambda *a: made.append("recursion") or run(*a))
    sql = "WITH RECURSIVE m AS MATERIALIZED (SELECT id FROM Ports), rig AS (SELECT id FROM Gear WHERE id = 2 UNION SELECT Gear.id FROM Gear JOIN rig ON Gear.above = rig.id) SELECT COUNT(*) FROM m JOIN rig ON m.id > rig.id"
    assert rows(session(spark), sql) == [9] and sorted(made) == ["recursion", "table"]


def test_recursion_caps(spark):
    small = session(spark, limits=Limits(iterations=3, rows=50))
    sql = "WITH RECURSIVE t AS ACCUMULATOR (SELECT id FROM Gear WHERE id = 1 UNION ALL SELECT Gear.id FROM Gear JOIN t ON Gear.above = t.id) SELECT id FROM t"
    assert "maximum iteration count" in small.execute(sql).message
    few = session(spark, limits=Limits(iterations=50, rows=6))
    assert "maximum row count" in few.execute(sql).message


@pytest.mark.parametrize("local", [0, 3, 20_000])
def test_recursion_of_large_and_small_rounds(spark, monkeypatch, local):
    """Rounds that pass from local rows to checkpoints, NULL and NaN among the rows, give what local ones give."""
    from lodestone.operators import recursion

    monkeypatch.setattr(recursion, "LOCAL_ROWS", local)
    steps = [(None, 1.0), (1, float("nan")), (1, float("nan")), (2, None), (3, -0.0), (3, 0.0)]
    tables = {"Steps": spark.createDataFrame(steps, "at long, v double"), "Go": spark.createDataFrame([(1.0, 1), (1.0, 2), (2.0, 3), (3.0, 1)], "at double, next long").selectExpr("CAST(at AS BIGINT) AS at", "next")}
    engine = session(spark)
    engine.given = tables
    found = rows(engine, "WITH RECURSIVE t AS (SELECT at, v FROM Steps UNION SELECT Go.next, t.v FROM Go JOIN t ON Go.at = t.at) SELECT at, v FROM t")
    assert sorted(map(repr, found)) == sorted(map(repr, [(None, 1.0), *((i, v) for i in (1, 2, 3) for v in (float("nan"), None, 0.0))]))


# deviations, decided on
def test_L1_limit_zero(db):
    assert rows(db, "SELECT id FROM P LIMIT 0") == []


def test_L3_kinds_never_equal_but_ordered(db):
    assert rows(db, "SELECT id FROM Boats WHERE metres = 6") == []
    assert bag(db, "SELECT id FROM Boats WHERE metres > 100") == [1, 2, 3, 4]
    assert bag(db, "SELECT id FROM Boats WHERE id < 0.25") == [1, 2, 3, 4]


def test_L4_limit_in_cte_comes_first(db):
    assert rows(db, "WITH one AS (SELECT id FROM Ports ORDER BY id DESC LIMIT 1) SELECT id FROM one WHERE id < 9") == []


def test_L5_group_in_cte_is_counted_over(db):
    assert rows(db, "WITH g AS (SELECT zone, COUNT(*) FROM Fees GROUP BY zone) SELECT COUNT(*) FROM g") == [3]


def test_L6_cte_hides_other_columns(db):
    assert "unknown column" in db.execute("WITH g AS (SELECT id FROM Ports) SELECT town FROM g").message


def test_L7_alias_of_cte(db):
    assert rows(db, "WITH g AS (SELECT id FROM Ports) SELECT h.id FROM g h WHERE h.id = 8") == [8]


def test_L8_inner_scope_first(db):
    assert bag(db, "SELECT title FROM Boats WHERE EXISTS (SELECT id FROM Ports WHERE id = 9)") == ["Heron", "Kestrel", "Osprey", "Plover"]


def test_L9_duplicates_in_list(db):
    assert rows(db, "SELECT id FROM Ports WHERE id IN (8, 8, 8)") == [8]
    assert rows(db, "SELECT id FROM Boats WHERE id IN (SELECT boat FROM Trips) ORDER BY id") == [1, 2, 4]


def test_L10_two_partial_ors(db):
    assert bag(db, "SELECT tag FROM Crates WHERE (id = 1 OR red = 1) AND (dry = 1 OR red = 1)") == ["both, of two", "dry", "red"]


def test_L12_backslash_is_plain(db):
    assert rows(db, r'SELECT id FROM Logs WHERE entry LIKE "\\s%"') == []


def test_L14_arithmetic_on_null(db):
    assert rows(db, "SELECT id FROM Gauges WHERE (-drift) < -2.0 ORDER BY id") == [2, 3]


def test_L17_exists_over_join(db):
    assert rows(db, "SELECT b.title FROM Boats b JOIN Ports p ON b.port = p.id WHERE EXISTS (SELECT * FROM Trips t WHERE t.boat = b.id)") == ["Heron"]


def test_L18_outer_on_the_left(db):
    assert rows(db, 'SELECT title FROM Boats b WHERE EXISTS (SELECT * FROM Trips t WHERE b.id = t.boat AND b.title LIKE "P%")') == ["Plover"]


def test_L19_exists_over_aggregate(db):
    assert bag(db, "SELECT town FROM Ports WHERE EXISTS (SELECT COUNT(*) FROM Vacant)") == ["Bergen", "Oban", "Vigo"]


def test_L21_set_operations_need_one_type(db):
    assert "differ in type" in db.execute("SELECT id FROM P UNION SELECT town FROM Ports").message


def test_L24_self_join(db):
    assert rows(db, "SELECT a.town, b.town FROM Ports a JOIN Ports b ON a.id < b.id ORDER BY a.id LIMIT 1")[0][0] == "Bergen"


def test_L26_cte_uses_sibling(db):
    assert rows(db, "WITH a AS (SELECT id FROM Ports WHERE id > 7), b AS MATERIALIZED (SELECT id FROM a) SELECT COUNT(*) FROM b") == [2]
