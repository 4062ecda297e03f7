"""Helpers of the engine's tests: a small harbour as DataFrames, and answers as plain rows."""

from lodestone.errors import EngineError
from lodestone.session import Session

HARBOUR = {
    "Boats": ("id long, title string, metres double, port long", [(1, "Heron", 14.5, 7), (2, "Kestrel", 9.25, 4), (3, "Osprey", 12.75, 7), (4, "Plover", 6.0, None)]),
    "Ports": ("id long, town string", [(7, "Bergen"), (8, "Oban"), (9, "Vigo")]),
    "Trips": ("boat long, miles double", [(1, 40.0), (1, 310.5), (2, 88.0), (4, 12.5), (6, 5.0)]),
    "Berths": ("boat long, port long", [(1, 7), (2, 4), (3, 8)]),
    "Logs": ("id long, skipper string, entry string", [(1, "Ines", "calm sea at dawn"), (2, "Tomas", "fog"), (3, "Inga", "sea mist, calm later")]),
    "Signs": ("id long, call string", [(1, "Sol"), (2, None), (3, "Mar")]),
    "Tides": ("id long, slot long, mark string", [(1, None, "unknown tide"), (2, 3, "third tide")]),
    "Moons": ("id long, slot long, phase string", [(11, None, "unseen"), (12, 3, "waxing"), (13, 4, "full")]),
    "Quotas": ("id long, least double", [(1, 10.0), (2, 13.0)]),
    "Fees": ("id long, zone long, paid double", [(1, 3, 30.5), (2, None, 8.0), (3, None, 4.25), (4, 3, 1.5), (5, 2, 9.0)]),
    "Gauges": ("id long, level long, drift double", [(1, 6, 0.5), (2, 9, 2.5), (3, 15, None)]),
    "Vacant": ("id long, note string", []),
    "P": ("id long", [(5,), (6,), (6,), (6,), (7,)]),
    "Q": ("id long", [(6,), (6,), (8,)]),
    "S": ("id long", [(6,)]),
    "Gear": ("id long, above long, label string", [(1, 0, "hull"), (2, 1, "mast"), (3, 2, "boom"), (4, 1, "keel"), (5, 3, "reef")]),
    "Lanes": ("src long, dst long", [(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)]),
    "Locks": ("id long, after long", [(10, 20), (20, 30), (30, 40), (40, 50)]),
    "Crates": ("id long, dry long, red long, tag string", [(1, 1, 0, "dry"), (1, 0, 1, "red"), (2, 1, 1, "both, of two"), (1, 0, 0, "plain")]),
}


def session(spark, **options) -> Session:
    return Session(spark, tables={name: spark.createDataFrame(rows, schema) for name, (schema, rows) in HARBOUR.items()}, **options)


def rows(engine: Session, sql: str) -> list[tuple]:
    """The rows in their order, single columns unwrapped."""
    result = engine.execute(sql)
    if not result.success:
        raise EngineError(result.message)
    return [r[0] if len(r) == 1 else r for r in result.rows]


def bag(engine: Session, sql: str) -> list:
    return sorted(rows(engine, sql), key=repr)
