"""The comparison algebra of the dialect as Spark columns.

NULL equals NULL and is below everything else, and values of different kinds are never equal but ordered
by kind (INT, DOUBLE, STRING). The dialect has no NOT, so a NULL that comes out of a condition is as good
as false; where that makes a shorter form, it is used. Every form stays a plain column expression, so
filters reach the Parquet scan and equalities stay join keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import EngineError

ORDER = {"INT": 1, "DOUBLE": 2, "STRING": 3}
FLIPPED = {"=": "=", "<": ">", ">": "<"}
SPARK_TYPES = {"INT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


def kind_of(data_type: T.DataType) -> str:
    """INT, DOUBLE or STRING; other Spark types keep their own name and compare as Spark does."""
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "INT"
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return "DOUBLE"
    return "STRING" if isinstance(data_type, T.StringType) else data_type.simpleString()


@dataclass(frozen=True)
class Operand:
    column: Column
    kind: str  # "" for a literal NULL
    nullable: bool = True


def literal(value) -> Operand:
    if value is None:
        return Operand(F.lit(None), "")
    kind = "INT" if isinstance(value, int) else "DOUBLE" if isinstance(value, float) else "STRING"
    return Operand(F.lit(value), kind, False)


def compare(left: Operand, op: str, right: Operand) -> Column:
    """left op right; NULL, if at all, only where it means false."""
    a, b = left.column, right.column
    if not left.kind or not right.kind:
        return against_null(left, op, right)
    if left.kind != right.kind and left.kind in ORDER and right.kind in ORDER:
        below = ORDER[left.kind] < ORDER[right.kind]
        if op == "=":
            return F.lit(False) if not (left.nullable and right.nullable) else a.isNull() & b.isNull()
        by_kind = F.lit(below if op == "<" else not below)
        return ordered(left, op, right, by_kind)
    if op == "=":
        return a.eqNullSafe(b) if left.nullable and right.nullable else a == b
    return ordered(left, op, right, a < b if op == "<" else a > b)


def ordered(left: Operand, op: str, right: Operand, both: Column) -> Column:
    """`both` where neither is NULL; NULL is below all else."""
    low, high = (left, right) if op == "<" else (right, left)
    found = both if not low.nullable else low.column.isNull() | both
    return found if not high.nullable else high.column.isNotNull() & found


def against_null(left: Operand, op: str, right: Operand) -> Column:
    other = left if not right.kind else right
    if not other.kind:
        return F.lit(op == "=")
    if op == "=":
        return other.column.isNull()
    other_is_above = (op == ">") == (other is left)
    return other.column.isNotNull() if other_is_above else F.lit(False)


def within(column: Operand, values: tuple) -> Column:
    """IN a list: values of another kind never match, NULL matches NULL."""
    same = [v for v in values if v is not None and literal(v).kind == column.kind]
    found = column.column.isin(same) if same else F.lit(False)
    return found | column.column.isNull() if None in values else found


def like(column: Operand, pattern: str) -> Column:
    """`%` and `_` without an escape character; NULL and other kinds never match."""
    if column.kind != "STRING":
        return F.lit(False)
    return column.column.like(pattern.replace("\\", "\\\\"))


def matches(column: Operand, pattern: str) -> Column:
    """An unanchored regular-expression search, in Java's syntax."""
    if column.kind != "STRING":
        return F.lit(False)
    return column.column.rlike(pattern)


def check_pattern(spark, pattern: str) -> None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise EngineError("invalid regex pattern") from e


def shifted(column: Operand, negate: bool, offset, minus: bool) -> Operand:
    """-column, column + offset or column - offset. INT stays INT unless the offset is a DOUBLE."""
    if column.kind not in ("INT", "DOUBLE"):
        raise EngineError("arithmetic needs a numeric column")
    if negate:
        return Operand(-column.column, column.kind, column.nullable)
    if offset is None:
        return column
    kind = "DOUBLE" if "DOUBLE" in (column.kind, literal(offset).kind) else "INT"
    base = column.column.cast("double" if kind == "DOUBLE" else "long")
    return Operand(base - F.lit(offset) if minus else base + F.lit(offset), kind, column.nullable)


def trigrams(column: Column) -> Column:
    """The distinct three-character pieces of a text; shorter texts are one piece."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(column) - 2), lambda i: F.substring(column, i, F.lit(3)))
    return F.when(F.length(column) < 3, F.array(column)).otherwise(F.array_distinct(pieces))
