"""Relational operators over DataFrames: scans by key, joins, sorting, limits. Catalyst picks the physical strategy of each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.status import unsupported

#: Pairs of rows with equal keys that a task compares, or nearly so; from SPREAD_FROM pairs on, a join is dealt out by them.
PAIRS_A_CELL = 4_000_000
SPREAD_FROM = 4 * PAIRS_A_CELL
#: Keys are counted where one side is estimated below COUNTED_BYTES; where each is there FEW_REPEATS times or less, work follows the other side's rows.
COUNTED_BYTES = 64 << 20
FEW_REPEATS = 64
#: More tasks than these are not made.
MOST_TASKS = 20_000


def point_lookup(df: DataFrame, column: str, key: object) -> DataFrame:
    """Rows with this key: a filter that reaches the scan, where row groups are skipped by their statistics."""
    return df.where(F.col(column) == F.lit(key))


def range_scan(df: DataFrame, column: str, low: object | None, high: object | None) -> DataFrame:
    """Rows with low <= key <= high; None leaves a side open."""
    for bound, op in ((low, ">="), (high, "<=")):
        if bound is not None:
            df = df.where(F.col(column) >= F.lit(bound) if op == ">=" else F.col(column) <= F.lit(bound))
    return df


def key_order(df: DataFrame, column: str) -> DataFrame:
    """All rows with a key, in its order."""
    return df.where(F.col(column).isNotNull()).orderBy(F.asc(column))


def join(left: DataFrame, right: DataFrame, kind: str, condition: Column | None, keys: Sequence[tuple[Column, Column]] = (), rest: Column | None = None) -> DataFrame:
    """INNER, LEFT, RIGHT on any condition, or CROSS without one. Equal keys anywhere in the condition make it a hash or sort-merge join.

    keys are equalities that must hold, each of a left and a right expression, and rest what else the condition says: where keys repeat so often on
    both sides that their pairs outgrow the rows, Spark's tasks, made by bytes or by keys, would be few and long, and the pairs are dealt out instead."""
    dealt = _cells(left, right, kind, keys) if keys else None
    if dealt is not None:
        return _by_cells(left, right, kind, keys, rest, *dealt)
    if kind == "CROSS":
        return left.crossJoin(right)
    return left.join(right, condition, kind.lower())


def _cells(left: DataFrame, right: DataFrame, kind: str, keys: Sequence[tuple[Column, Column]]) -> tuple[DataFrame, int] | None:
    """The keys with too many pairs for one task, with the number of parts (p0, p1) of their left and right rows, and a number of tasks; None where
    pairs are few. Rows of an outer join's kept side are never copied, so the other side stays whole."""
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right)]
    if min(sizes) > COUNTED_BYTES:
        return None
    names = [f"k{m}" for m in range(len(keys))]
    counted = []
    for n, df in enumerate((left, right)):
        there = df.select(*(pair[n].alias(k) for pair, k in zip(keys, names, strict=True))).where(reduce(Column.__and__, (F.col(k).isNotNull() for k in names)))
        counted.append(there.groupBy(*names).agg(F.count("*").cast("double").alias(f"n{n}")))
    small = sizes.index(min(sizes))
    if (counted[small].agg(F.max(f"n{small}")).first()[0] or 0) <= FEW_REPEATS:
        return None
    n0, n1, cell = F.col("n0"), F.col("n1"), float(PAIRS_A_CELL)
    parts = {"LEFT": (n0 * n1 / cell, F.lit(1.0)), "RIGHT": (F.lit(1.0), n0 * n1 / cell)}.get(kind) or tuple(a / F.greatest(F.lit(math.sqrt(cell)), cell / b) for a, b in ((n0, n1), (n1, n0)))
    hot = F.struct(*names, *(F.ceil(p).cast("int").alias(f"p{n}") for n, p in enumerate(parts)))
    pairs, found = counted[0].join(counted[1], names).agg(F.sum(n0 * n1), F.collect_list(F.when(n0 * n1 > cell, hot))).first()
    if (pairs or 0) <= SPREAD_FROM:
        return None
    schema = T.StructType([*(counted[0].schema[k] for k in names), *(T.StructField(p, T.IntegerType()) for p in ("p0", "p1"))])
    rows = pa.Table.from_pylist([r.asDict() for r in found], to_arrow_schema(schema))
    return left.sparkSession.createDataFrame(rows, schema), min(MOST_TASKS, math.ceil(pairs / cell) + 1)


def _by_cells(left: DataFrame, right: DataFrame, kind: str, keys: Sequence[tuple[Column, Column]], rest: Column | None, hot: DataFrame, tasks: int) -> DataFrame:
    """The join with the pairs of a hot key as a grid of cells: a row falls by its hash into one part of its side and is copied to all of the other's,
    so each pair meets in just one cell. Rows that are alike in every column share a part."""
    sides, columns = [], [*left.columns, *right.columns]
    for n, df in enumerate((left, right)):
        names = [f"_k{n}_{m}" for m in range(len(keys))]
        hashed = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        keyed = df.select("*", *(pair[n].alias(k) for pair, k in zip(keys, names, strict=True)))
        here = hot.toDF(*names, "_p0", "_p1").withColumnsRenamed({k: f"_h{k}" for k in names})
        met = keyed.join(F.broadcast(here), reduce(Column.__and__, (F.col(k) == F.col(f"_h{k}") for k in names)), "left")
        own = F.pmod(F.xxhash64(*hashed), F.coalesce(f"_p{n}", F.lit(1))).cast("int").alias(f"_own{n}")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(f"_p{1 - n}", F.lit(1)) - 1)).alias(f"_other{n}")
        cell = [f"_own{n}", f"_other{n}"] if n == 0 else [f"_other{n}", f"_own{n}"]
        sides.append((met.select(*df.columns, *names, own, others).repartition(tasks, *names, *cell), [*names, *cell]))
    (a, of_a), (b, of_b) = sides
    same = reduce(Column.__and__, (F.col(x) == F.col(y) for x, y in zip(of_a, of_b, strict=True)))
    # Sorted, as copies would not fit the size that a broadcast is chosen by.
    found = a.join(b.hint("merge"), same if rest is None else same & rest, "inner" if kind == "CROSS" else kind.lower())
    return found.select(*columns)


def ordered(df: DataFrame, keys: Sequence[tuple[Column, bool]]) -> DataFrame:
    """Sorted by (column, descending) keys; nulls come first ascending and last descending."""
    return df.orderBy(*(c.desc_nulls_last() if descending else c.asc_nulls_first() for c, descending in keys))


def limited(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Spark counts both in 32 bits. Beyond that the rows are counted first: a limit that they do not reach is none, an offset behind them all
    leaves nothing, and what cannot be expressed is an error, never a wrong result."""
    most = 2**31 - 1
    if offset > most or (limit or 0) > most:
        rows = df.count()
        if offset >= rows:
            offset, limit = 0, 0
        elif offset > most:
            raise unsupported(f"an OFFSET beyond {most}")
        elif limit is not None and limit > most:
            if limit < rows - offset:
                raise unsupported(f"a LIMIT beyond {most}")
            limit = None
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
