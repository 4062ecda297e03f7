"""Recursive queries: a driver loop over DataFrames.

A round whose rows are few keeps them as a local relation, and tells new ones from seen ones on the driver,
so it is one query without a shuffle of its own. From the first round that is larger on, rows are told
apart by joins and checkpointed. Either way each round's plan starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.errors import EngineError
from lodestone.operators import relational
from lodestone.sources.files import checkpointed


#: Rows that a member may hold on the driver between rounds.
LOCAL_ROWS = 20_000


@dataclass(frozen=True)
class Limits:
    iterations: int = 1000
    rows: int = 100_000


@dataclass(frozen=True)
class Member:
    """A recursive CTE: its anchor, its arm given what the group's names are bound to, and its rules."""

    name: str
    anchor: DataFrame
    arm: Callable[[dict[str, DataFrame]], DataFrame]
    keep_all: bool
    accumulator: bool


def new_rows(step: DataFrame, seen: DataFrame, keep_all: bool) -> DataFrame:
    """What a step adds: all of it, or its distinct rows that have not been seen."""
    if keep_all:
        return step
    return relational.anti_join(step.distinct(), seen, [(c, c) for c in step.columns]) if step.columns else step


def keys(table: pa.Table) -> list[tuple]:
    """The rows as values that are equal where Spark's are: NULL to NULL, and NaN to NaN."""
    columns = [["NaN" if x != x else x for x in column.to_pylist()] for column in table.columns]
    return list(zip(*columns, strict=True)) if columns else [()] * table.num_rows


def plain_zeros(table: pa.Table) -> pa.Table:
    """-0.0 as 0.0, which it is when Spark tells rows apart."""
    for i, f in enumerate(table.schema):
        if pa.types.is_floating(f.type):
            table = table.set_column(i, f, pc.add(table.column(i), pa.scalar(0.0, f.type)))
    return table


@dataclass(frozen=True)
class Held:
    """Rows cut from their lineage: local if few, else in the checkpoint folder."""

    df: DataFrame
    size: int
    local: pa.Table | None

    @staticmethod
    def of(df: DataFrame, distinct: bool) -> Held:
        """The rows of `df`, or its distinct ones."""
        return Held.beyond(df, None, distinct)

    @staticmethod
    def beyond(step: DataFrame, seen: Held | None, distinct: bool, large: bool = False) -> Held:
        """What `step` adds to `seen`. `large` tells that it will hardly be local, so that it is computed once."""
        if not large and (seen is None or not distinct or seen.local is not None):
            table = step.limit(LOCAL_ROWS + 1).toArrow()
            if table.num_rows <= LOCAL_ROWS:
                if distinct:
                    table = plain_zeros(table)
                    known, fresh = set(keys(seen.local)) if seen else set(), []
                    for i, key in enumerate(keys(table)):
                        if key not in known:
                            known.add(key)
                            fresh.append(i)
                    table = table.take(pa.array(fresh, pa.int64()))
                return Held.at(step, table)
        rows = step.distinct() if seen is None and distinct else step if seen is None else new_rows(step, seen.df, not distinct)
        kept = checkpointed(rows)
        return Held(kept, kept.count(), None)

    @staticmethod
    def at(df: DataFrame, table: pa.Table) -> Held:
        return Held(df.sparkSession.createDataFrame(table, df.schema), table.num_rows, table)

    def plus(self, other: Held) -> Held:
        if not other.size:
            return self
        if self.local is not None and other.local is not None and self.size + other.size <= LOCAL_ROWS:
            return Held.at(self.df, pa.concat_tables([self.local, other.local.cast(self.local.schema)]))
        kept = checkpointed(self.df.unionAll(other.df))
        return Held(kept, self.size + other.size, None)


def run(members: list[Member], limits: Limits) -> dict[str, DataFrame]:
    """Evaluates a group in lockstep until no member has new rows. Each name means the rows of the last
    round, or all rows so far for an accumulator. The caps are checked before rows are added."""
    total = {m.name: Held.of(m.anchor, not m.keep_all) for m in members}
    delta, rounds = dict(total), 0
    while any(d.size for d in delta.values()):
        if rounds >= limits.iterations:
            raise EngineError("WITH RECURSIVE exceeded maximum iteration count")
        rounds += 1
        bound = {m.name: (total if m.accumulator else delta)[m.name].df for m in members}
        delta = {m.name: Held.beyond(m.arm(bound), total[m.name], not m.keep_all, large=delta[m.name].local is None) for m in members}
        if sum(d.size for d in (*total.values(), *delta.values())) > limits.rows:
            raise EngineError("WITH RECURSIVE exceeded maximum row count")
        total = {name: held.plus(delta[name]) for name, held in total.items()}
    return {name: held.df for name, held in total.items()}
