"""INSERT, UPDATE and DELETE as new versions of tables, with every constraint checked before one is made."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog.schema import ROW_ID, Database, Table
from lodestone.catalog.store import FILE, Access, Store
from lodestone.errors import ConstraintError, EngineError
from lodestone.functions import algebra, rows
from lodestone.plans.compiler import row_condition
from lodestone.sources.files import checkpointed
from lodestone.sql import ast
from lodestone.sql.parser import type_of

MAX_ACTION_DEPTH = 64
#: Hit rows up to which their ids are broadcast to the segments that hold them.
BROADCAST_HITS = 200_000


class Writer:
    """The DML of one statement on a database state; `db` is the state that results."""

    def __init__(self, store: Store, db: Database, access: Access, images: bool) -> None:
        self.store, self.db, self.access, self.images = store, db, access, images

    def note(self, table: str, df: DataFrame) -> None:
        if self.images:
            self.access.writes.setdefault(table, []).append(df.drop(FILE))

    def picked(self, table: Table, where) -> DataFrame:
        tables = lambda name: self.store.rows(self.db.table(name)).drop(ROW_ID)
        self.access.reads.append((table.name, where))
        return row_condition(where, self.store.located(table), table.name, tables)

    # -- INSERT

    def insert(self, command: ast.Insert) -> int:
        table = self.db.table(command.table)
        batch = [self.checked_row(table, values) for values in command.rows]
        names = table.names
        for key in table.keys:
            values = [tuple(row[names.index(c)] for c in key) for row in batch]
            whole = [v for v in values if None not in v]
            self.key_read(table.name, key, set(whole))
            if len(set(whole)) < len(whole) or self.among(table, key, set(whole)):
                raise ConstraintError(f"UNIQUE constraint violation on column {', '.join(key)}")
        for key in table.foreign_keys:
            own = {tuple(row[names.index(c)] for c in key.columns) for row in batch}
            wanted = {v for v in own if None not in v}
            self.key_read(key.parent, key.parent_columns, wanted)
            if key.parent == table.name:  # rows of the batch may refer to each other
                wanted -= {tuple(row[names.index(c)] for c in key.parent_columns) for row in batch}
            if wanted - self.present(self.db.table(key.parent), key.parent_columns, wanted):
                raise ConstraintError(f"FOREIGN KEY constraint violation on column {', '.join(key.columns)}")
        first = self.store.allocate(table, len(batch))
        df = self.store.spark.createDataFrame([(first + i, *row) for i, row in enumerate(batch)], table.struct).coalesce(1)
        self.db = self.db.with_table(self.store.append(self.db, table, df, len(batch), first + len(batch)))
        self.note(table.name, df)
        return len(batch)

    def key_read(self, table: str, columns: tuple, keys: set) -> None:
        """A check of keys is a read of them: a concurrent change of the same keys is a conflict."""
        if self.images and keys:
            parts = [ast.InList(ast.Ref(c), tuple(sorted({k[i] for k in keys}))) for i, c in enumerate(columns)]
            self.access.reads.append((table, parts[0] if len(parts) == 1 else ast.And(tuple(parts))))

    def checked_row(self, table: Table, values: tuple) -> tuple:
        if len(values) != len(table.columns):
            raise EngineError("column count does not match the table")
        for column, value in zip(table.columns, values, strict=True):
            self.check_value(column, value)
        row = dict(zip(table.names, values, strict=True))
        for text, predicate in zip(table.checks, table.predicates(), strict=True):
            if rows.check(predicate, row) is False:
                raise ConstraintError(f"CHECK constraint violation: {text}")
        return values

    @staticmethod
    def check_value(column: ast.Column, value) -> None:
        if value is None:
            if not column.nullable:
                raise ConstraintError(f"NOT NULL constraint violation on column {column.name}")
        elif type_of(value) != column.type:
            raise EngineError(f"type mismatch on column {column.name}")

    def present(self, table: Table, columns: tuple, keys: set) -> set:
        """Which of a batch's keys are among a table's rows; only those rows are read back."""
        if not keys or not table.segments:
            return set()
        found = self.store.rows(table).where(self.key_filter(columns, keys)).select(*columns).distinct()
        return {tuple(r) for r in found.collect()} & keys

    def among(self, table: Table, columns: tuple, keys: set) -> bool:
        return bool(self.present(table, columns, keys))

    @staticmethod
    def key_filter(columns: tuple, keys: set) -> Column:
        """A superset of the keys that Parquet statistics can prune by: each column among its own values."""
        return reduce(lambda a, b: a & b, [F.col(c).isin([k[i] for k in keys]) for i, c in enumerate(columns)])

    # -- UPDATE

    def update(self, command: ast.Update) -> int:
        table = self.db.table(command.table)
        column = table.column(command.column)
        if column is None:
            raise EngineError("unknown update column")
        hits = checkpointed(self.picked(table, command.where))
        count = hits.count()
        if not count:
            return 0
        self.check_value(column, command.value)
        self.note(table.name, hits)
        if column.unique and command.value is not None:
            self.key_read(table.name, (column.name,), {(command.value,)})
        parents = [(c, k) for c, k in self.db.children(table.name) if column.name in k.parent_columns]
        self.assign(table, hits, {column.name: command.value}, count)
        for child, key in parents:
            self.key_changed(child.name, key, column.name, hits, command.value)
        return count

    def assign(self, table: Table, hits: DataFrame, values: dict, count: int = BROADCAST_HITS + 1) -> None:
        """Set columns of the `count` hit rows to literals, and check the table that results."""
        literals = {c: F.lit(v).cast(algebra.SPARK_TYPES[table.column(c).type]) for c, v in values.items()}
        images = hits.withColumns(literals)
        for text, predicate in zip(table.checks, table.predicates(), strict=True):
            if not images.where(~F.coalesce(check_column(predicate, table), F.lit(True))).isEmpty():
                raise ConstraintError(f"CHECK constraint violation: {text}")
        flag = hits.select(ROW_ID, F.lit(True).alias("__hit"))
        flag = F.broadcast(flag) if count <= BROADCAST_HITS else flag

        def change(old: DataFrame) -> DataFrame:
            joined = old.join(flag, ROW_ID, "left")
            return joined.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in literals.items()})

        after = self.store.rewrite(self.db, table, hits, change)
        for key in table.keys:
            if any(c in values for c in key):
                self.check_unique(after, key, images)
        self.db = self.db.with_table(after)
        for key in table.foreign_keys:
            if any(c in values for c in key.columns):
                self.check_parents(key, images)
        self.note(table.name, images)

    def check_unique(self, after: Table, key: tuple, images: DataFrame) -> None:
        changed = images.select(*key).dropna().distinct()
        clash = self.store.rows(after).join(changed, list(key), "left_semi").groupBy(*key).count().where("count > 1")
        if not clash.isEmpty():
            raise ConstraintError(f"UNIQUE constraint violation on column {', '.join(key)}")

    def check_parents(self, key: ast.ForeignKey, images: DataFrame) -> None:
        parents = self.store.rows(self.db.table(key.parent))
        pairs = [F.col(c) == F.col(f"__{p}") for c, p in zip(key.columns, key.parent_columns, strict=True)]
        parents = parents.select(*(F.col(p).alias(f"__{p}") for p in key.parent_columns))
        orphans = images.dropna(subset=list(key.columns)).join(parents, reduce(lambda a, b: a & b, pairs), "left_anti")
        if not orphans.isEmpty():
            raise ConstraintError(f"FOREIGN KEY constraint violation on column {', '.join(key.columns)}")

    def key_changed(self, child_name: str, key: ast.ForeignKey, column: str, old: DataFrame, value) -> None:
        """What ON UPDATE asks for where rows of a parent had another key before."""
        child = self.db.table(child_name)
        still = self.store.rows(self.db.table(key.parent))
        gone = old.select(*key.parent_columns).dropna().join(still.select(*key.parent_columns), list(key.parent_columns), "left_anti")
        hits = checkpointed(matching_children(self.store.located(child), key, gone))
        if hits.isEmpty():
            return
        self.note(child_name, hits)
        if key.on_update == "NO ACTION":
            raise ConstraintError("FOREIGN KEY constraint violation: key is still referenced")
        own = key.columns[key.parent_columns.index(column)]
        changes = {own: value} if key.on_update == "CASCADE" else dict.fromkeys(key.columns)
        for name, new in changes.items():
            self.check_value(child.column(name), new)
        further = [(c, k) for c, k in self.db.children(child_name) if any(n in k.parent_columns for n in changes)]
        self.assign(child, hits, changes)
        for grandchild, other in further:
            for name, new in changes.items():
                if name in other.parent_columns:
                    self.key_changed(grandchild.name, other, name, hits, new)

    # -- DELETE

    def delete(self, command: ast.Delete) -> int:
        table = self.db.table(command.table)
        hits = checkpointed(self.picked(table, command.where))
        count = hits.count()
        if count:
            self.remove(table.name, hits, count)
        return count

    def remove(self, name: str, hits: DataFrame, count: int) -> None:
        """Delete `count` rows with all that follows from it: levels of children, until none are left.

        A row that one key would null and another deletes is deleted; NO ACTION refuses only if a child
        of the rows that go is left at the end.
        """
        doomed, counts = {name: hits.select(ROW_ID, FILE)}, {name: count}
        nulls: list[tuple[str, ast.ForeignKey, DataFrame]] = []
        checks: list[tuple[str, ast.ForeignKey, DataFrame]] = []
        frontier, depth = {name: hits}, 0
        while frontier:
            following: dict[str, DataFrame] = {}
            for parent, lost in frontier.items():
                for child, key in self.db.children(parent):
                    found = matching_children(self.store.located(child), key, lost.select(*key.parent_columns).dropna().distinct())
                    if key.on_delete == "SET NULL":
                        nulls.append((child.name, key, found))
                    elif key.on_delete == "NO ACTION":
                        checks.append((child.name, key, found))
                    else:
                        if child.name in doomed:
                            found = found.join(doomed[child.name], ROW_ID, "left_anti")
                        following[child.name] = following[child.name].unionByName(found).distinct() if child.name in following else found
            frontier = {}
            for child, found in following.items():
                found = checkpointed(found)
                if not found.isEmpty():
                    if depth >= MAX_ACTION_DEPTH:
                        raise ConstraintError("FOREIGN KEY CASCADE depth exceeded")
                    ids = found.select(ROW_ID, FILE)
                    doomed[child] = checkpointed(doomed[child].unionByName(ids)) if child in doomed else ids
                    counts[child] = counts.get(child, 0) + found.count()
                    frontier[child] = found
            depth += 1
        left = lambda child, df: df.join(doomed[child], ROW_ID, "left_anti") if child in doomed else df
        for child, _, found in checks:
            if not left(child, found).isEmpty():
                raise ConstraintError("FOREIGN KEY constraint violation: key is still referenced")
        nulls = [(child, key, checkpointed(left(child, found))) for child, key, found in nulls]
        for child, ids in doomed.items():
            table = self.db.table(child)
            self.note(child, hits if child == name and counts[child] == count else self.store.rows(table).join(ids, ROW_ID, "left_semi"))
            ids = F.broadcast(ids) if counts[child] <= BROADCAST_HITS else ids
            after = self.store.rewrite(self.db, table, ids, lambda old, ids=ids: old.join(ids.select(ROW_ID), ROW_ID, "left_anti"))
            self.db = self.db.with_table(replace(after, row_count=table.row_count - counts[child]))
        for child, key, found in nulls:
            if not found.isEmpty():
                self.note(child, found)
                self.assign(self.db.table(child), found, dict.fromkeys(key.columns))


def matching_children(children: DataFrame, key: ast.ForeignKey, parents: DataFrame) -> DataFrame:
    parents = parents.select(*(F.col(p).alias(f"__{p}") for p in key.parent_columns))
    pairs = [F.col(c) == F.col(f"__{p}") for c, p in zip(key.columns, key.parent_columns, strict=True)]
    return children.join(parents, reduce(lambda a, b: a & b, pairs), "left_semi")


def check_column(predicate, table) -> Column:
    """A CHECK predicate with SQL's three values: NULL where it is open."""
    if isinstance(predicate, ast.And | ast.Or):
        parts = [check_column(p, table) for p in predicate.parts]
        return reduce((lambda a, b: a & b) if isinstance(predicate, ast.And) else (lambda a, b: a | b), parts)
    left = F.col(predicate.left.name)
    refs = isinstance(predicate.right, ast.Ref)
    right = F.col(predicate.right.name) if refs else F.lit(predicate.right)
    kinds = [table.column(predicate.left.name).type, table.column(predicate.right.name).type if refs else type_of(predicate.right)]
    if kinds[0] != kinds[1] and (refs or predicate.right is not None):
        by_kind = algebra.ORDER[kinds[0]] < algebra.ORDER[kinds[1]]
        known = {"=": False, "<": by_kind, ">": not by_kind}[predicate.op]
        return F.when(left.isNotNull() & right.isNotNull(), F.lit(known))
    return {"=": left == right, "<": left < right, ">": left > right}[predicate.op]


def analyse(store: Store, table: Table, buckets: int = 32) -> Table:
    """Equi-height histograms and distinct counts of all columns, NULLs left out: two jobs a column at most."""
    df = store.rows(table)
    histograms = {}
    for column in table.columns:
        counts = df.where(F.col(column.name).isNotNull()).groupBy(F.col(column.name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        histograms[column.name] = histogram(counts, buckets)
    return replace(table, histograms=histograms)


def histogram(counts: DataFrame, buckets: int = 32) -> dict:
    """rows, distinct and buckets (low, high, rows, distinct) from a table of value and n.

    Ranks are summed over a range-partitioned sort, and a value belongs to the bucket of its first row,
    so equal values share one; only the buckets reach the driver.
    """
    total = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
    if not total["rows"]:
        return {"rows": 0, "distinct": 0, "buckets": []}
    ordered = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    ordered = checkpointed(ordered)
    parts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, running = [], 0
    for part in sorted(parts):
        starts += [F.lit(part), F.lit(running)]
        running += parts[part]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = before + F.element_at(F.create_map(*starts), F.col("part"))
    bucket = F.floor(rank * buckets / total["rows"])
    found = ordered.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).orderBy("bucket")
    return {"rows": total["rows"], "distinct": total["distinct"], "buckets": [[r["low"], r["high"], r["rows"], r["distinct"]] for r in found.collect()]}


def column_histogram(df: DataFrame, column: str, buckets: int = 32) -> dict:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return histogram(counts, buckets)
