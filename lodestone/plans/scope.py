"""Frames (a DataFrame whose columns have unique inner names) and the resolution of column names."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import algebra

_numbers = itertools.count(1)


@dataclass(frozen=True)
class Col:
    name: str  # as its source calls it, possibly with a qualifier
    table: str  # the physical or CTE name
    scope: str  # alias or table, folded
    inner: str
    kind: str
    nullable: bool
    level: int = 0

    @property
    def short(self) -> str:
        return self.name.rpartition(".")[2]

    @property
    def qualified(self) -> str:
        return self.name if "." in self.name else f"{self.table}.{self.name}"

    def operand(self) -> algebra.Operand:
        return algebra.Operand(F.col(self.inner), self.kind, self.nullable)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    cols: tuple[Col, ...]
    carried: tuple[Col, ...] = ()  # columns of the domain of outer rows
    joined: bool = False

    def named(self, col: Col) -> str:
        return col.qualified if self.joined else col.name


def fresh(name: str) -> str:
    return f"{name.replace('.', '_')}__{next(_numbers)}"


def frame_of(df: DataFrame, table: str, scope: str, level: int, names: list[str] | None = None) -> Frame:
    """A source as a frame; `names` are what its columns are called if not as in the DataFrame."""
    inner = [fresh(c) for c in df.columns]
    cols = tuple(Col(n, table, scope.lower(), i, algebra.kind_of(f.dataType), f.nullable and not f.metadata.get("required"), level) for n, i, f in zip(names or df.columns, inner, df.schema.fields, strict=True))
    return Frame(df.toDF(*inner), cols)


def resolve(name: str, cols: tuple[Col, ...] | list[Col]) -> Col | None:
    """The column a name means: exact, qualified by scope or table, or a unique short name. Ambiguity is an error."""
    qualifier, _, short = name.rpartition(".")
    if qualifier:
        found = [c for c in cols if c.short == short and c.scope == qualifier.lower()]
        found = found or [c for c in cols if c.name == name] or [c for c in cols if c.short == short and c.table.lower() == qualifier.lower() and "." not in c.name]
    else:
        found = [c for c in cols if c.name == name] or [c for c in cols if c.short == name]
    if len(found) > 1:
        raise EngineError(f"ambiguous column reference {name}")
    return found[0] if found else None


@dataclass
class Binding:
    """What a CTE name means: a DataFrame and the names of its columns."""

    name: str
    df: DataFrame
    names: list[str]
    carried: tuple[Col, ...] = ()


@dataclass(frozen=True)
class Environment:
    """Where names of tables are looked up, and the frames of the queries around."""

    tables: object  # name -> DataFrame
    bindings: dict = field(default_factory=dict)
    outer: tuple[Col, ...] = ()
    level: int = 0
    limits: object = None
    notes: list = field(default_factory=list)
    #: Names and types are all that is wanted: nothing is written, and recursion does not run beyond its anchor.
    planning: bool = False

    def bind(self, binding: Binding) -> Environment:
        return replace(self, bindings={**self.bindings, binding.name.lower(): binding})
