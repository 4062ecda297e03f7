"""Queries to DataFrames.

A subquery that refers to outer rows is compiled once, against its domain: the distinct values of the
outer columns it uses. The domain's columns travel through the subquery, join groups, windows and set
operations, and the outer query is semi-joined with what comes out. A subquery that is only FROM and
WHERE needs no domain: its correlated conditions are those of the semi-join itself. So correlation of any
depth becomes joins, never an evaluation for each row.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import algebra
from lodestone.operators import recursion, relational
from lodestone.plans.scope import Binding, Col, Environment, Frame, frame_of, fresh, resolve
from lodestone.sources.files import checkpointed
from lodestone.sql import ast

MAX_LEVELS = 8
SUBQUERIES = (ast.InSelect, ast.Exists)


class Output:
    """A compiled query: rows, the names of its columns, and the domain columns it carries."""

    def __init__(self, df: DataFrame, cols: list[Col], carried: tuple[Col, ...] = ()) -> None:
        self.df, self.cols, self.carried = df, cols, carried

    def result(self) -> DataFrame:
        return self.df.select(*(F.col(c.inner).alias(c.name) for c in self.cols))

    def binding(self, name: str) -> Binding:
        df = self.df.select(*(F.col(c.inner) for c in self.cols), *(F.col(c.inner) for c in self.carried))
        return Binding(name, df, [c.name for c in self.cols], self.carried)


def compile_select(select: ast.Select, env: Environment, domain: Frame | None = None) -> Output:
    env = with_ctes(select.ctes, env, domain)
    if not select.set_ops:
        return compile_core(select, env, domain)
    left = compile_core(replace(select, ctes=(), set_ops=(), order_by=None, limit=None), env, domain)
    for arm in select.set_ops:
        right = compile_core(replace(arm.select, ctes=()), env, domain)
        left = combine(left, arm, right, domain)
    order = resolve(select.order_by[0], left.cols) if select.order_by else None
    if select.order_by and not order:
        raise EngineError(f"unknown ORDER BY column {select.order_by[0]}")
    df = limited(left.df, order, bool(order and select.order_by[1]), select.limit, left.carried)
    return Output(df, left.cols, left.carried)


def combine(left: Output, arm: ast.SetOp, right: Output, domain: Frame | None) -> Output:
    if len(left.cols) != len(right.cols):
        raise EngineError("set operation requires equal column counts")
    for a, b in zip(left.cols, right.cols, strict=True):
        if a.kind != b.kind and a.kind in algebra.ORDER and b.kind in algebra.ORDER:
            raise EngineError(f"set operation columns differ in type: {a.name} and {b.name}")
    carried = domain.cols if domain and (left.carried or right.carried) else ()
    left, right = carrying(left, domain if carried else None), carrying(right, domain if carried else None)
    sides = [x.df.select(*(F.col(c.inner) for c in x.cols), *(F.col(c.inner) for c in carried)) for x in (left, right)]
    return Output(relational.set_operation(sides[0], arm.kind, arm.all, sides[1]), left.cols, carried)


def carrying(output: Output, domain: Frame | None) -> Output:
    """The same with the domain's columns; what does not depend on outer rows holds for each of them."""
    if domain is None or output.carried:
        return output
    return Output(output.df.crossJoin(domain.df), output.cols, domain.cols)


# -- WITH


def with_ctes(ctes: tuple, env: Environment, domain: Frame | None) -> Environment:
    done: set[str] = set()
    for cte in ctes:
        if cte.name.lower() in done:
            continue
        if cte.recursive:
            group = recursive_group(cte, ctes)
            for name, df in recursive(group, env, domain).items():
                env = env.bind(Binding(name, df, df.columns))
                env.notes.append(f"materialized recursive CTE {name}")
            done |= {c.name.lower() for c in group}
            continue
        output = compile_select(cte.select, env, domain_for(cte.select, env, domain))
        binding = output.binding(cte.name)
        if cte.materialized and not env.planning:
            binding.df = checkpointed(binding.df)
        env.notes.append(f"{'materialized' if cte.materialized else 'inlined'} CTE {cte.name}{' (set operation)' if cte.select.set_ops else ''}")
        env = env.bind(binding)
    return env


def domain_for(select: ast.Select, env: Environment, domain: Frame | None) -> Frame | None:
    """The domain, if the query uses any of it."""
    return domain if domain and free_names(select, env) else None


def recursive_group(cte: ast.Cte, ctes: tuple) -> list[ast.Cte]:
    """The CTE and those it is mutually recursive with, in the order they are written."""
    uses = {c.name.lower(): {s.name.lower() for s in ast.nodes(c.select, ast.Source)} for c in ctes if c.recursive}

    def reach(name: str) -> set[str]:
        found, todo = set(), [name]
        while todo:
            for n in uses.get(todo.pop(), set()) & set(uses) - found:
                found.add(n)
                todo.append(n)
        return found

    own = cte.name.lower()
    return [c for c in ctes if c.recursive and (c.name.lower() == own or (c.name.lower() in reach(own) and own in reach(c.name.lower())))]


def recursive(group: list[ast.Cte], env: Environment, domain: Frame | None) -> dict[str, DataFrame]:
    if domain and any(free_names(c.select, env, tuple(group)) for c in group):
        raise EngineError("a recursive CTE cannot refer to outer rows")
    anchors = {c.name: compile_core(replace(c.select, ctes=(), set_ops=()), env).result() for c in group}
    anchors = {n: df.toDF(*(x.rpartition(".")[2] for x in df.columns)) for n, df in anchors.items()}

    def step(cte: ast.Cte, bound: dict[str, DataFrame]) -> DataFrame:
        inner = env
        for name, df in bound.items():
            inner = inner.bind(Binding(name, df, df.columns))
        out = compile_core(replace(cte.arm.select, ctes=()), inner).result()
        names = anchors[cte.name].columns
        if len(out.columns) != len(names):
            raise EngineError("set operation requires equal column counts")
        types = [f.dataType for f in anchors[cte.name].schema.fields]
        return out.toDF(*names).select(*(F.col(n).cast(t) for n, t in zip(names, types, strict=True)))

    if env.planning:
        for cte in group:
            step(cte, anchors)
        return anchors
    members = [recursion.Member(c.name, anchors[c.name], lambda bound, c=c: step(c, bound), c.arm.all, c.accumulator) for c in group]
    return recursion.run(members, env.limits or recursion.Limits())


# -- names that a query takes from outside


def own_columns(select: ast.Select, env: Environment) -> list[Col]:
    """The columns of FROM and JOIN, by schema alone."""
    names = {c.name.lower(): c for c in select.ctes}
    cols = []
    for source in sources(select):
        inner = source.select or (names[source.name.lower()].select if source.name.lower() in names else None)
        if inner is None:
            cols += source_frame(source, env).cols
            continue
        for item in output_names(inner, env, select.ctes):
            cols.append(Col(item, source.name, source.scope.lower(), item, "", True))
    return cols


def output_names(select: ast.Select, env: Environment, ctes: tuple) -> list[str]:
    nested = replace(select, ctes=tuple(c for c in ctes if c.select is not select) + select.ctes)
    out = []
    for item in select.items:
        if isinstance(item, ast.Star):
            cols = own_columns(nested, env)
            out += [f"{c.table}.{c.name}" if select.joins and "." not in c.name else c.name for c in cols]
        else:
            out.append(str(item))
    return out


def sources(select: ast.Select) -> list[ast.Source]:
    return [select.source, *(j.source for j in select.joins)]


def free_names(select: ast.Select, env: Environment, ctes: tuple = ()) -> dict[str, int]:
    """Names that no scope of the query itself has, with how many queries down they are used."""
    select = replace(select, ctes=ctes + select.ctes)
    found: dict[str, int] = {}

    def add(name: str, depth: int) -> None:
        found[name] = max(depth, found.get(name, 0))

    for cte in select.ctes[len(ctes) :]:
        if not cte.recursive:
            for name, depth in free_names(cte.select, env, tuple(c for c in select.ctes if c is not cte)).items():
                add(name, depth)
    for source in sources(select):
        if source.select:
            for name, depth in free_names(source.select, env, select.ctes).items():
                add(name, depth)
    own = own_columns(select, env)
    names = [x for j in select.joins for x in (j.left, j.right) if x] + [x.column for x in select.items if isinstance(x, ast.Item) and x.column != "*"] + list(select.group_by)
    names += shallow_names(select.where)
    for name in names:
        if not any_match(name, own):
            add(name, 1)
    for inner in shallow_subqueries(select.where):
        for name, depth in free_names(inner.select, env, select.ctes).items():
            if not any_match(name, own):
                add(name, depth + 1)
    for arm in select.set_ops:
        for name, depth in free_names(arm.select, env, select.ctes).items():
            add(name, depth)
    return found


def any_match(name: str, cols: list[Col]) -> bool:
    try:
        return resolve(name, cols) is not None
    except EngineError:
        return True


def shallow_names(where) -> list[str]:
    """Columns of a predicate outside its subqueries."""
    if isinstance(where, ast.InSelect):
        return [where.column.name]
    if where is None or isinstance(where, ast.Exists):
        return []
    if isinstance(where, ast.And | ast.Or):
        return [x for p in where.parts for x in shallow_names(p)]
    return [x.name for x in ast.nodes(where, ast.Ref)] + [x.column for x in ast.nodes(where, ast.Shift)]


def shallow_subqueries(where) -> list:
    if isinstance(where, SUBQUERIES):
        return [where]
    return [x for p in where.parts for x in shallow_subqueries(p)] if isinstance(where, ast.And | ast.Or) else []


# -- one SELECT


def source_frame(source: ast.Source, env: Environment, domain: Frame | None = None) -> Frame:
    if source.select:
        output = compile_select(source.select, env, domain_for(source.select, env, domain))
        binding = output.binding(source.name)
    else:
        binding = env.bindings.get(source.name.lower())
        if binding is None:
            return frame_of(env.tables(source.name), source.name, source.scope, env.level)
    count = len(binding.names)
    frame = frame_of(binding.df, binding.name, source.scope, env.level, [*binding.names, *(c.inner for c in binding.carried)])
    return Frame(frame.df, frame.cols[:count], tuple(replace(c, inner=f.inner) for c, f in zip(binding.carried, frame.cols[count:], strict=True)))


def compile_core(select: ast.Select, env: Environment, domain: Frame | None = None) -> Output:
    """A SELECT by itself; its CTEs are bound in `env`."""
    frame = from_clause(select, env, domain)
    if select.where is not None:
        frame = filtered(frame, select.where, env)
    return aggregated(select, frame, domain) if select.aggregated else projected(select, frame)


def from_clause(select: ast.Select, env: Environment, domain: Frame | None) -> Frame:
    frame = source_frame(select.source, env, domain)
    if domain is not None:
        frame = with_domain(frame, domain)
    for join in select.joins:
        right = source_frame(join.source, env, domain)
        if join.kind == "cross":
            on = None
        else:
            on = join_condition(join, frame.cols, right.cols)
        if right.carried:
            same = reduce(lambda a, b: a & b, [F.col(a.inner).eqNullSafe(F.col(b.inner)) for a, b in zip(frame.carried, right.carried, strict=True)])
            on = same if on is None else on & same
        df = relational.join(frame.df, right.df, "inner" if join.kind == "cross" and on is not None else join.kind, on)
        loose = [replace(c, nullable=True) for c in (*frame.cols, *right.cols)] if join.kind in ("left", "right", "full") else [*frame.cols, *right.cols]
        frame = Frame(df, tuple(loose), frame.carried, True)
    return replace(frame, joined=bool(select.joins))


def with_domain(frame: Frame, domain: Frame) -> Frame:
    """The source for each row of the domain; one that depends on outer rows has their columns already."""
    if not frame.carried:
        return Frame(frame.df.crossJoin(domain.df), frame.cols, domain.cols)
    renamed = frame.df.withColumnsRenamed({c.inner: d.inner for c, d in zip(frame.carried, domain.cols, strict=True)})
    return Frame(renamed, frame.cols, domain.cols)


def join_condition(join: ast.Join, left: tuple[Col, ...], right: tuple[Col, ...]) -> Column:
    a, b = resolve(join.left, left), resolve(join.right, right)
    if a is None or b is None:
        a, b = resolve(join.right, left), resolve(join.left, right)
        if a is None or b is None:
            raise EngineError("unknown join column")
        return algebra.compare(a.operand(), algebra.FLIPPED[join.op], b.operand())
    return algebra.compare(a.operand(), join.op, b.operand())


def lookup(name: str, frame: Frame, env: Environment) -> Col:
    """Inner scope first, then the outer rows from the nearest out."""
    if col := resolve(name, frame.cols):
        return col
    for level in sorted({c.level for c in frame.carried}, reverse=True):
        if col := resolve(name, [c for c in frame.carried if c.level == level]):
            if env.level - level > MAX_LEVELS:
                raise EngineError("correlated reference exceeds maximum depth")
            return col
    raise EngineError(f"unknown column {name}")


def filtered(frame: Frame, where, env: Environment) -> Frame:
    """WHERE: conjuncts with a subquery become semi-joins; under OR they become markers."""
    parts = where.parts if isinstance(where, ast.And) else (where,)
    df, rest = frame.df, []
    for part in parts:
        if not shallow_subqueries(part):
            df = df.where(condition(part, frame, env, {}))
        else:
            rest.append(part)
    frame = replace(frame, df=df)
    for part in rest:
        if isinstance(part, ast.And):
            frame = filtered(frame, part, env)
        elif isinstance(part, SUBQUERIES):
            frame = replace(frame, df=semi(frame, part, env))
        else:
            frame = marked(frame, part, env)
    return frame


def condition(predicate, frame: Frame, env: Environment, markers: dict) -> Column:
    if isinstance(predicate, ast.And | ast.Or):
        found = [condition(p, frame, env, markers) for p in predicate.parts]
        return reduce(lambda a, b: a & b, found) if isinstance(predicate, ast.And) else reduce(lambda a, b: a | b, found)
    if isinstance(predicate, SUBQUERIES):
        return markers[id(predicate)]
    if isinstance(predicate, ast.Compare):
        return algebra.compare(operand(predicate.left, frame, env), predicate.op, operand(predicate.right, frame, env))
    column = operand(predicate.column, frame, env)
    if isinstance(predicate, ast.InList):
        return algebra.within(column, predicate.values)
    if isinstance(predicate, ast.Like):
        return algebra.like(column, predicate.pattern)
    algebra.check_pattern(frame.df.sparkSession, predicate.pattern)
    return algebra.matches(column, predicate.pattern)


def operand(node, frame: Frame, env: Environment) -> algebra.Operand:
    if isinstance(node, ast.Ref):
        return lookup(node.name, frame, env).operand()
    if isinstance(node, ast.Shift):
        return algebra.shifted(lookup(node.column, frame, env).operand(), node.negate, node.offset, node.minus)
    if isinstance(node, ast.Parameter):
        raise EngineError("statement parameters need EXECUTE")
    return algebra.literal(node)


def always(select: ast.Select) -> bool:
    """A global aggregate has a row whatever its input."""
    return select.aggregated and not select.group_by and not select.set_ops and select.limit != 0


def subquery(frame: Frame, node, env: Environment) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Distinct keys of a subquery, and which column of the frame each is compared with."""
    node = unlimited(node)
    inner_env = replace(env, level=env.level + 1)
    pairs, domain = [], None
    used = {}
    for name, depth in free_names(node.select, inner_env).items():
        col = lookup(name, frame, env)
        if env.level + depth - col.level > MAX_LEVELS:
            raise EngineError("correlated reference exceeds maximum depth")
        used[col.inner] = col
    if used:
        renamed = {c.inner: replace(c, inner=fresh(c.inner)) for c in used.values()}
        df = frame.df.select(*(F.col(a).alias(c.inner) for a, c in renamed.items())).distinct()
        domain = Frame(df, tuple(renamed.values()))
        pairs = [(a, c.inner) for a, c in renamed.items()]
    output = carrying(compile_select(node.select, inner_env, domain), domain)
    keys = [F.col(c.inner) for c in output.carried]
    if isinstance(node, ast.InSelect):
        if len(output.cols) != 1:
            raise EngineError("IN subquery must return one column")
        outer, inner = lookup(node.column.name, frame, env), output.cols[0]
        if outer.kind != inner.kind and outer.kind in algebra.ORDER and inner.kind in algebra.ORDER:
            # values of different kinds are never equal but for NULL
            output.df = output.df.where(F.col(inner.inner).isNull())
        value = fresh("value")
        keys.append(F.col(inner.inner).cast(frame.df.schema[outer.inner].dataType).alias(value))
        pairs.append((outer.inner, value))
    return (output.df.select(*keys).distinct() if keys else output.df.limit(1).select(F.lit(True).alias(fresh("any")))), pairs


def unlimited(node):
    """The same EXISTS without a LIMIT of a row or more, which changes nothing of whether there is one."""
    return replace(node, select=replace(node.select, limit=None)) if isinstance(node, ast.Exists) and node.select.limit else node


def semi(frame: Frame, node, env: Environment) -> DataFrame:
    if isinstance(node, ast.Exists) and always(node.select):
        return frame.df
    node = unlimited(node)
    if (found := direct_semi(frame, node, env)) is not None:
        return found
    keys, pairs = subquery(frame, node, env)
    return relational.semi_join(frame.df, keys, pairs)


def direct_semi(frame: Frame, node, env: Environment) -> DataFrame | None:
    """The semi-join with a subquery of FROM and WHERE alone, whose outer names stand in plain conditions."""
    select, inner_env = node.select, replace(env, level=env.level + 1)
    if select.set_ops or select.ctes or select.aggregated or select.limit is not None:
        return None
    free = free_names(select, inner_env)
    if any(depth > 1 for depth in free.values()) or any(s.select and free_names(s.select, inner_env) for s in sources(select)):
        return None
    parts = select.where.parts if isinstance(select.where, ast.And) else (select.where,) if select.where is not None else ()
    outer = [p for p in parts if free.keys() & set(shallow_names(p))]
    if any(shallow_subqueries(p) for p in outer):
        return None
    inner = from_clause(select, inner_env, None)
    if select.order_by and resolve(select.order_by[0], inner.cols) is None:
        raise EngineError(f"unknown ORDER BY column {select.order_by[0]}")
    if own := tuple(p for p in parts if p not in outer):
        inner = filtered(inner, ast.And(own), inner_env)
    both = Frame(frame.df, inner.cols, (*frame.cols, *frame.carried))
    on = [condition(p, both, inner_env, {}) for p in outer]
    if isinstance(node, ast.InSelect):
        cols = [c for item in select.items for c in (inner.cols if isinstance(item, ast.Star) else [needed(item.column, inner)])]
        if len(cols) != 1:
            raise EngineError("IN subquery must return one column")
        on.append(algebra.compare(lookup(node.column.name, frame, env).operand(), "=", cols[0].operand()))
    return frame.df.join(inner.df, reduce(lambda a, b: a & b, on), "left_semi") if on else None


def marked(frame: Frame, predicate, env: Environment) -> Frame:
    """A predicate with subqueries under OR: each adds a marker column by a left join on its distinct keys."""
    df, markers = frame.df, {}
    for node in shallow_subqueries(predicate):
        if isinstance(node, ast.Exists) and always(node.select):
            markers[id(node)] = F.lit(True)
            continue
        keys, pairs = subquery(replace(frame, df=df), node, env)
        flag = fresh("found")
        keys = keys.withColumn(flag, F.lit(True))
        df = df.join(keys, relational.null_safe(df, keys, pairs), "left")
        markers[id(node)] = F.col(flag).isNotNull()
    kept = df.where(condition(predicate, frame, env, markers))
    return replace(frame, df=kept.select(*frame.df.columns))


def limited(df: DataFrame, order: Col | None, descending: bool, limit: int | None, carried: tuple[Col, ...]) -> DataFrame:
    """ORDER BY and LIMIT; with a domain the limit holds for each of its rows."""
    if not carried or limit is None:
        return relational.top(df, order.inner if order else None, descending, limit)
    by = F.lit(0) if order is None else F.col(order.inner).desc() if descending else F.col(order.inner).asc()
    number = fresh("number")
    window = Window.partitionBy(*(c.inner for c in carried)).orderBy(by)
    return df.withColumn(number, F.row_number().over(window)).where(F.col(number) <= limit).drop(number)


def projected(select: ast.Select, frame: Frame) -> Output:
    cols = []
    for item in select.items:
        found = frame.cols if isinstance(item, ast.Star) else [needed(item.column, frame)]
        cols += [replace(c, name=frame.named(c)) for c in found]
    order = None
    if select.order_by:
        order = needed(select.order_by[0], frame)
    df = limited(frame.df, order, bool(order and select.order_by[1]), select.limit, frame.carried)
    inner = [replace(c, inner=fresh(c.short)) for c in cols]
    df = df.select(*(F.col(c.inner).alias(i.inner) for c, i in zip(cols, inner, strict=True)), *(F.col(c.inner) for c in frame.carried))
    return Output(df, inner, frame.carried)


def needed(name: str, frame: Frame) -> Col:
    col = resolve(name, frame.cols) or resolve(name, frame.carried)
    if col is None:
        raise EngineError(f"unknown column {name}")
    return col


def aggregated(select: ast.Select, frame: Frame, domain: Frame | None) -> Output:
    if any(isinstance(x, ast.Star) for x in select.items):
        raise EngineError("SELECT * is not allowed with aggregates or GROUP BY")
    keys = []
    for name in select.group_by:
        col = resolve(name, frame.cols)
        if col is None:
            raise EngineError("unknown GROUP BY column")
        keys.append(col)
    cols, measures = [], []
    for item in select.items:
        if not item.function:
            col = resolve(item.column, frame.cols)
            if col is None or col not in keys:
                raise EngineError("selected column must appear in GROUP BY or an aggregate")
            cols.append(replace(col, name=frame.named(col)))
            continue
        col = None if item.column == "*" else resolve(item.column, frame.cols)
        if item.column != "*" and col is None:
            raise EngineError("unknown aggregate column")
        kind = {"COUNT": "INT", "AVG": "DOUBLE"}.get(item.function, col.kind if col else "")
        out = Col(str(item), "", "", fresh(item.function.lower()), kind, item.function != "COUNT")
        measures.append(relational.aggregate(item.function, F.col(col.inner) if col else None, col.kind if col else "").alias(out.inner))
        cols.append(out)
    df = relational.grouped(frame.df, [F.col(c.inner) for c in (*keys, *frame.carried)], measures)
    if frame.carried and not keys and domain is not None:
        # a global aggregate has a row for each outer row, also where nothing matched
        other = domain.df.toDF(*(fresh("d") for _ in domain.cols))
        pairs = [(a, c.inner) for a, c in zip(other.columns, frame.carried, strict=True)]
        df = other.join(df, relational.null_safe(other, df, pairs), "left").drop(*(c.inner for c in frame.carried))
        df = df.withColumnsRenamed({a: c for a, c in pairs}).fillna(0, subset=[c.inner for c in cols if c.name.startswith("COUNT(")] or None)
    order = resolve(select.order_by[0], cols) if select.order_by else None
    if select.order_by and order is None:
        raise EngineError(f"unknown ORDER BY column {select.order_by[0]}")
    df = limited(df, order, bool(order and select.order_by[1]), select.limit, frame.carried)
    inner = [replace(c, inner=fresh("out")) for c in cols]
    df = df.select(*(F.col(c.inner).alias(i.inner) for c, i in zip(cols, inner, strict=True)), *(F.col(c.inner) for c in frame.carried))
    return Output(df, inner, frame.carried)


def row_condition(predicate, df: DataFrame, table: str, tables) -> DataFrame:
    """Rows of a table that a WHERE of UPDATE or DELETE picks, with all of its columns, under their names."""
    if predicate is None:
        return df
    env = Environment(tables)
    frame = frame_of(df, table, table, 0)
    kept = filtered(frame, predicate, env)
    return kept.df.select(*(F.col(c.inner).alias(n) for c, n in zip(frame.cols, df.columns, strict=True)))
