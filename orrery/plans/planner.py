"""SELECT trees to DataFrames: from, joins, where, grouping, projection, order, limit.

Every input column gets an internal name of its own, so equal names never clash; a name without a qualifier means the first match in written order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.aggregates import lower_aggregate
from orrery.functions.scalar import Typed, comparable, lower, predicate
from orrery.operators.relational import join, limited, ordered
from orrery.plans import nodes as N
from orrery.status import StatusCode, SqlError, invalid, unsupported


@dataclass(frozen=True)
class Source:
    """A table as the planner sees it: its rows and, by column, name and SQL type."""

    df: DataFrame
    columns: list[tuple[str, str]]


Catalog = Callable[[str], Source]  # raises SqlError(NOT_FOUND)


@dataclass
class Scope:
    """Columns in written order: (relation label, column name, internal name, SQL type)."""

    columns: list[tuple[str, str, str, str]] = field(default_factory=list)

    def find(self, name: N.Name) -> tuple[str, str] | None:
        """Internal name and type of the first match."""
        return next(((i, t) for label, c, i, t in self.columns if c == name.column and name.table in (None, label)), None)

    def resolve(self, name: N.Name) -> Typed:
        found = self.find(name)
        if found is None:
            raise invalid(f"unknown column {name.table + '.' if name.table else ''}{name.column}")
        return Typed(F.col(found[0]), found[1])

    def add(self, label: str, source: Source, number: int) -> DataFrame:
        internal = [f"r{number}_{k}" for k in range(len(source.columns))]
        self.columns += [(label, c, i, t) for (c, t), i in zip(source.columns, internal, strict=True)]
        return source.df.toDF(*internal)


@dataclass
class Planned:
    df: DataFrame  # columns named c0, c1, ... so that equal names can repeat
    names: list[str]
    types: list[str]

    def named(self) -> DataFrame:
        return self.df.toDF(*self.names)


def plan_select(select: N.Select, catalog: Catalog) -> Planned:
    scope = Scope()
    labels = [select.relation.label, *(j.relation.label for j in select.joins)]
    if len(set(labels)) < len(labels):
        raise invalid("two relations of a query need different aliases")
    df = scope.add(select.relation.label, catalog(select.relation.table), 0)
    for k, j in enumerate(select.joins, 1):
        right = scope.add(j.relation.label, catalog(j.relation.table), k)
        condition = None if j.condition is None else predicate(j.condition, scope.resolve)
        df = join(df, right, j.kind, condition, *_equalities(df, right, j, select.where, scope))
    if select.where is not None:
        df = df.where(predicate(select.where, scope.resolve))
    grouped = bool(select.group_by) or any(isinstance(i.expression, N.Aggregate) for i in select.items or ())
    return _grouped(df, scope, select) if grouped else _plain(df, scope, select)


def _conjuncts(node: object) -> Iterator[object]:
    if isinstance(node, N.Binary) and node.op == "AND":
        yield from _conjuncts(node.left)
        yield from _conjuncts(node.right)
    elif node is not None:
        yield node


def _names(node: object) -> Iterator[N.Name]:
    if isinstance(node, N.Name):
        yield node
    for inner in (getattr(node, f, None) for f in ("left", "right", "operand")):
        if inner is not None:
            yield from _names(inner)


def _equalities(left: DataFrame, right: DataFrame, j: N.Join, where: object | None, scope: Scope) -> tuple[list[tuple[Column, Column]], Column | None]:
    """What a join's condition, and where no side of it is kept whole also the WHERE, says of equal expressions of its two sides, and the rest of
    the condition."""

    def side(node: object) -> int | None:
        found = [scope.find(n) for n in _names(node)]
        held = {None if f is None else 0 if f[0] in left_names else 1 for f in found}
        return held.pop() if len(held) == 1 else None

    left_names, keys, rest = set(left.columns), [], []
    own = list(_conjuncts(j.condition))
    for k, c in enumerate([*own, *(_conjuncts(where) if j.kind in ("INNER", "CROSS") else ())]):
        sides = (side(c.left), side(c.right)) if isinstance(c, N.Binary) and c.op == "=" else ()
        if sides in ((0, 1), (1, 0)):
            a, b = comparable(lower(c.left, scope.resolve), lower(c.right, scope.resolve))
            keys.append((a, b) if sides == (0, 1) else (b, a))
        elif k < len(own):
            rest.append(predicate(c, scope.resolve))
    return keys, reduce(Column.__and__, rest) if rest else None


def _item_name(item: N.Item) -> str:
    e = item.expression
    if item.alias:
        return item.alias
    if isinstance(e, N.Aggregate):
        inner = "*" if e.argument is None else e.argument.column if isinstance(e.argument, N.Name) else "expr"
        return f"{e.function.lower()}({inner})"
    return e.column if isinstance(e, N.Name) else "expr"


def _plain(df: DataFrame, scope: Scope, select: N.Select) -> Planned:
    if select.items is None:
        out = [(c, Typed(F.col(i), t)) for _, c, i, t in scope.columns]
    else:
        out = [(_item_name(i), lower(i.expression, scope.resolve)) for i in select.items]
    extended = df.select("*", *(_concrete(x).alias(f"c{k}") for k, (_, x) in enumerate(out)))
    return _finished(extended, out, select, scope.resolve)


def _grouped(df: DataFrame, scope: Scope, select: N.Select) -> Planned:
    if select.items is None:
        raise unsupported("* cannot be combined with grouping")
    keys = [scope.resolve(n) for n in select.group_by]
    places = {str(k.column): n for n, k in enumerate(keys)}
    ansi = str(df.sparkSession.conf.get("spark.sql.ansi.enabled")).lower() == "true"
    aggregates, out = [], []
    for k, item in enumerate(select.items):
        e = item.expression
        if isinstance(e, N.Aggregate):
            if e.argument is not None and not isinstance(e.argument, N.Name):
                raise unsupported(f"the argument of {e.function} must be a column")
            found = lower_aggregate(e.function, None if e.argument is None else scope.resolve(e.argument), ansi)
            aggregates.append(found.column.alias(f"a{k}"))
            out.append((_item_name(item), Typed(F.col(f"a{k}"), found.sql_type)))
        elif isinstance(e, N.Name):
            found = scope.resolve(e)
            if str(found.column) not in places:
                raise invalid(f"column {e.column} must be grouped or aggregated")
            out.append((_item_name(item), Typed(F.col(f"g{places[str(found.column)]}"), found.sql_type)))
        else:
            raise unsupported("an expression cannot stand beside aggregates; group by columns")
    by = [k.column.alias(f"g{n}") for n, k in enumerate(keys)]
    result = df.groupBy(*by).agg(*aggregates) if aggregates else df.select(*by).distinct()
    extended = result.select("*", *(x.column.alias(f"c{k}") for k, (_, x) in enumerate(out)))

    def resolve(name: N.Name) -> Typed:
        found = scope.resolve(name)
        if str(found.column) not in places:
            raise invalid(f"cannot order by {name.column}: it is neither selected nor grouped")
        return Typed(F.col(f"g{places[str(found.column)]}"), found.sql_type)

    return _finished(extended, out, select, resolve)


def _concrete(x: Typed):
    """Bare NULLs still need a type to be stored or collected."""
    return x.column.cast("string") if x.sql_type == "NULL" else x.column


def _finished(extended: DataFrame, out: list[tuple[str, Typed]], select: N.Select, hidden: Callable[[N.Name], Typed]) -> Planned:
    """Order by output columns first, else by what else is in scope; then limit; then drop what is hidden."""

    def key(name: N.Name):
        if name.table is None:
            for k, (column, _) in enumerate(out):
                if column == name.column:
                    return F.col(f"c{k}")
        return hidden(name).column

    df = extended
    if select.order_by:
        df = ordered(df, [(key(o.name), o.descending) for o in select.order_by])
    df = limited(df, select.limit, select.offset) if select.limit is not None or select.offset else df
    return Planned(df.select(*(f"c{k}" for k in range(len(out)))), [n for n, _ in out], [x.sql_type for _, x in out])


def not_found(table: str) -> SqlError:
    return SqlError(StatusCode.NOT_FOUND, f"no table {table}")
