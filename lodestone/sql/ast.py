"""Syntax trees of all statements."""

from __future__ import annotations

from dataclasses import dataclass

#: A literal is None, int, float, str or a Parameter.
Literal = object


@dataclass(frozen=True)
class Parameter:
    index: int


@dataclass(frozen=True)
class Ref:
    """A column, as written: `name` or `qualifier.name`."""

    name: str


@dataclass(frozen=True)
class Shift:
    """The arithmetic of predicates and indexes: sign * column + offset, or its trigrams."""

    column: str
    negate: bool = False
    offset: Literal = None
    minus: bool = False
    trigram: bool = False

    def __str__(self) -> str:
        if self.trigram:
            return f"trigram({self.column})"
        if self.negate:
            return f"-{self.column}"
        return self.column if self.offset is None else f"{self.column}{'-' if self.minus else '+'}{self.offset}"


@dataclass(frozen=True)
class Compare:
    left: Ref | Shift
    op: str
    right: object  # Ref or literal


@dataclass(frozen=True)
class InList:
    column: Ref
    values: tuple


@dataclass(frozen=True)
class InSelect:
    column: Ref
    select: Select


@dataclass(frozen=True)
class Exists:
    select: Select


@dataclass(frozen=True)
class Like:
    column: Ref
    pattern: str


@dataclass(frozen=True)
class Matches:
    column: Ref
    pattern: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Item:
    """A select item: a column, or an aggregate of one (`*` for COUNT(*))."""

    column: str
    function: str = ""

    def __str__(self) -> str:
        return f"{self.function}({self.column})" if self.function else self.column


@dataclass(frozen=True)
class Source:
    name: str
    alias: str = ""
    select: Select | None = None

    @property
    def scope(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full or cross
    source: Source
    left: str = ""
    op: str = ""
    right: str = ""


@dataclass(frozen=True)
class Cte:
    name: str
    select: Select
    materialized: bool = False
    recursive: bool = False
    accumulator: bool = False

    @property
    def arm(self) -> SetOp:
        return self.select.set_ops[0]


@dataclass(frozen=True)
class SetOp:
    kind: str  # union, intersect or except
    all: bool
    select: Select


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Source
    joins: tuple = ()
    where: object = None
    group_by: tuple = ()
    set_ops: tuple = ()
    order_by: tuple | None = None  # (column, descending)
    limit: int | None = None
    ctes: tuple = ()

    @property
    def aggregated(self) -> bool:
        return bool(self.group_by) or any(isinstance(x, Item) and x.function for x in self.items)


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # INT, DOUBLE or STRING
    nullable: bool = False
    unique: bool = False
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple
    parent: str
    parent_columns: tuple
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Unique:
    columns: tuple
    primary: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple
    checks: tuple = ()
    foreign_keys: tuple = ()
    uniques: tuple = ()


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class DropDatabase:
    name: str


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class RenameTable:
    table: str
    to: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: Column
    fill: Literal = None
    has_fill: bool = False


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str
    cascade: bool = False


@dataclass(frozen=True)
class RenameColumn:
    table: str
    column: str
    to: str


@dataclass(frozen=True)
class ListTables:
    pass


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple
    expression: Shift | None = None


@dataclass(frozen=True)
class DropIndex:
    name: str
    table: str


@dataclass(frozen=True)
class Analyze:
    table: str = ""


@dataclass(frozen=True)
class Explain:
    query: object
    analyze: bool = False


@dataclass(frozen=True)
class Prepare:
    name: str
    query: object


@dataclass(frozen=True)
class Execute:
    name: str
    values: tuple


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


@dataclass(frozen=True)
class SaveDatabase:
    pass


@dataclass(frozen=True)
class LoadDatabase:
    name: str = ""


@dataclass(frozen=True)
class Exit:
    pass


def children(node) -> list:
    """The direct dataclass children of a node, through tuples."""
    if isinstance(node, tuple):
        return list(node)
    if hasattr(node, "__dataclass_fields__"):
        return [getattr(node, name) for name in node.__dataclass_fields__]
    return []


def nodes(tree, kinds) -> list:
    """All nodes of the given kinds below `tree`, in the order they are written."""
    own = [tree] if isinstance(tree, kinds) else []
    return own + [x for child in children(tree) for x in nodes(child, kinds)]
