"""The relational operators as functions of DataFrames; Catalyst picks their physical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import algebra

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def join(left: DataFrame, right: DataFrame, kind: str, on: Column | None = None) -> DataFrame:
    """Inner, left, right and full joins on a condition, or a cross join. Equalities must be null-safe."""
    return left.crossJoin(right) if kind == "cross" else left.join(right, on, JOINS[kind])


def semi_join(left: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of `left` that have a match in `keys`, NULL matching NULL."""
    return left.join(keys, null_safe(left, keys, pairs), "left_semi")


def anti_join(left: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return left.join(keys, null_safe(left, keys, pairs), "left_anti")


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True))


def aggregate(function: str, column: Column | None, kind: str = "") -> Column:
    """COUNT, SUM, AVG, MIN or MAX; column None is COUNT(*)."""
    if function == "COUNT":
        return F.count(F.lit(1) if column is None else column)
    if function in ("SUM", "AVG") and kind not in ("INT", "DOUBLE"):
        raise EngineError("SUM/AVG require numeric arguments")
    if function == "SUM":
        return F.sum(column.cast("double" if kind == "DOUBLE" else "long"))
    return {"AVG": F.avg, "MIN": F.min, "MAX": F.max}[function](column)


def grouped(df: DataFrame, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """Grouped or, without keys, global aggregation; keys alone are a distinct."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates)


def set_operation(left: DataFrame, kind: str, every: bool, right: DataFrame) -> DataFrame:
    """UNION, INTERSECT or EXCEPT of two DataFrames by position; `every` keeps multiplicities."""
    if len(left.columns) != len(right.columns):
        raise EngineError("set operation requires equal column counts")
    if kind == "union":
        both = left.unionAll(right)
        return both if every else both.distinct()
    if kind == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    return left.exceptAll(right) if every else left.subtract(right)


def top(df: DataFrame, column: str | None, descending: bool, limit: int | None) -> DataFrame:
    """Order (NULL lowest) and cut; together they become one top-k operator."""
    if column is not None:
        df = df.orderBy(F.col(column).desc() if descending else F.col(column).asc())
    return df if limit is None else df.limit(limit)


def index_lookup(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows whose columns equal the given values: a filter that Parquet statistics prune."""
    operands = ((algebra.Operand(df[c], algebra.kind_of(df.schema[c].dataType)), algebra.literal(v)) for c, v in values.items())
    return df.where(reduce(lambda a, b: a & b, [algebra.compare(c, "=", v) for c, v in operands]))
