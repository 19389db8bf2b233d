"""Approximate nearest neighbours by cosine with collision-counting hashing (query-aware windows over single projections).

Rows are held in blocks of at most BLOCK_BYTES, scaled to length one. A block's index is PROJECTIONS arrays: its vectors' values under one
random direction each, sorted. All blocks' arrays are built once and written; queries come in lots, and every lot is searched in every block.
A query lays a window of the same width around its own value in every array; vectors inside are that array's
collisions, and virtual rehashing widens all windows step by step, which only adds entries at their ends. A vector whose collisions reach the
threshold becomes a candidate and is verified by its exact cosine. Windows start at a part of the k-th best distance
known from other blocks or a few vectors of this one. A query is done in a block when its windows are so wide that a vector nearer
than its k-th best so far, in this block or those that its task has searched before, would, but for a small chance, have collided often enough.

Widths: for unit vectors at distance s, projections differ by s * |normal|, so the chance to collide in a window of half-width w is
erf(w / (s * sqrt 2)), and the collision count is binomial. THRESHOLD is where a vector at distance s misses it with chance under MISS.

Defined cases: vectors null, empty, zero, or with a null or non-finite component take no part; vectors meet only others of their dimension; a
null id takes no part; rows that share a query's id are not its candidates; a query id on several rows is searched once, with the vector
smallest in array order; other repeated rows are candidates each; ties go to smaller ids; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import materialized, rows, scratch_dir

#: Bytes of a block's vectors and index.
BLOCK_BYTES = 32 * 2**20
#: Bytes of query vectors that one pass over the blocks carries to every task.
QUERY_BYTES = 32 * 2**20
PROJECTIONS = 192
MISS = 0.15
_TIE = 1e-9
#: Queries whose windows are looked up together.
_TOGETHER = 128

#: Half-width of a window in distances, the factor by which a step widens it, and the first distance as a part of the k-th best known.
_REACH = 1.15
_STEP = 1.08
_START = 0.75


def _least_count(p: float) -> int:
    """Largest count that Binomial(PROJECTIONS, p) falls below with chance at most MISS."""
    below, count = 0.0, 0
    while (below := below + math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)) <= MISS:
        count += 1
    return count


THRESHOLD = _least_count(math.erf(_REACH / math.sqrt(2)))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part, v as doubles."""
    v = F.col(vector_column).cast("array<double>")
    out = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return out.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def exact_cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row of v in double precision; the same for equal rows wherever they stand."""
    q, v = q / np.abs(q).max(), v / np.abs(v).max(axis=1, keepdims=True)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * math.sqrt(float((q * q).sum())))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(PROJECTIONS, dim))


def block_rows(dim: int, block_bytes: int) -> int:
    """Rows of a block: a row has its vector, its unit vector in work, its id, and a value and a 16-bit place in each array."""
    return max(1, min(2**16, block_bytes // (16 * dim + 8 + 6 * PROJECTIONS)))


class BlockIndex:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None, values: np.ndarray | None = None):
        self.ids, self.vectors, self.units = ids, vectors, _unit(vectors)
        if order is None or values is None:
            found = (directions(vectors.shape[1]) @ self.units.T).astype(np.float32)
            order = np.argsort(found, axis=1, kind="stable")
            values = np.take_along_axis(found, order, axis=1)
        self.order, self.values = order.astype(np.uint16), values

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, known: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k nearest found, ties to smaller ids, for each query; known has the scores of its best in other blocks."""
        units = _unit(queries)
        for at in range(0, len(queries), _TOGETHER):
            part = slice(at, at + _TOGETHER)
            for q, places in enumerate(self.candidates(units[part], own_ids[part], k, known[part]), at):
                places = places[self.ids[places] != own_ids[q]]
                rough = self.units[places] @ units[q]
                if len(rough) > k:
                    places = places[rough >= np.partition(rough, -k)[-k] - _TIE]
                score = exact_cosine(queries[q], self.vectors[places])
                best = np.lexsort((self.ids[places], -score))[:k]
                yield self.ids[places][best], score[best]

    def candidates(self, units: np.ndarray, own_ids: np.ndarray, k: int, known: list[np.ndarray]) -> list[np.ndarray]:
        """For each query the places of the vectors whose collisions reached the threshold before its k-th best lay within the windows' distance."""
        n, m = len(self.ids), len(units)
        centre = (directions(units.shape[1]) @ units.T).astype(np.float32)  # projection, query
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre, strict=True)])
        high = low.copy()
        counts, verified = [np.zeros(n, np.int64) for _ in range(m)], [np.zeros(n, bool) for _ in range(m)]
        # A few vectors, verified at once, tell where windows can start: narrower ones would hardly find k vectors.
        few = n // 64 + 1
        rough = np.where(self.ids[:few, None] == own_ids, -np.inf, self.units[:few] @ units.T)
        near, distance = [], np.full(m, 2.0)
        for q in range(m):
            verified[q][:few] = True
            found = np.concatenate([known[q], rough[:, q][np.isfinite(rough[:, q])]])
            near.append(np.partition(found, -k)[-k:] if len(found) > k else found)
            if len(near[q]) == k:
                distance[q] = _START * math.sqrt(max(2 - 2 * near[q].min(), 0.01))
        open_ = list(range(m))
        while open_:
            reach = (_REACH * distance[open_]).astype(np.float32)
            a = np.array([np.searchsorted(v, c - reach) for v, c in zip(self.values, centre[:, open_], strict=True)])
            b = np.array([np.searchsorted(v, c + reach) for v, c in zip(self.values, centre[:, open_], strict=True)])
            left = []
            for j, q in enumerate(open_):
                spans = zip(self.order, a[:, j].tolist(), low[:, q].tolist(), high[:, q].tolist(), b[:, j].tolist(), strict=True)
                grown = np.concatenate([x for row, a0, a1, b0, b1 in spans for x in (row[a0:a1], row[b0:b1])])
                low[:, q], high[:, q] = np.minimum(a[:, j], low[:, q]), np.maximum(b[:, j], high[:, q])
                if len(grown):
                    counts[q] += np.bincount(grown, minlength=n)
                fresh = np.flatnonzero((counts[q] >= THRESHOLD) & ~verified[q])
                verified[q][fresh] = True
                near[q] = np.concatenate([near[q], (self.units[fresh] @ units[q])[self.ids[fresh] != own_ids[q]]])
                if len(near[q]) > k:
                    near[q] = np.partition(near[q], -k)[-k:]
                if len(near[q]) == k and near[q].min() >= 1 - distance[q] ** 2 / 2:
                    continue
                if distance[q] >= 2:  # no two unit vectors are further apart
                    verified[q][:] = True
                    continue
                distance[q] = min(2.0, distance[q] * _STEP)
                left.append(q)
            open_ = left
        return [np.flatnonzero(v) for v in verified]


_INDEX = "dim int, ids binary, vectors binary, places binary, projected binary"


def written_index(base: DataFrame) -> DataFrame:
    """A row a block: its vectors and sorted projections. Few small partitions become one, so that blocks are not tiny; no row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def built(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            now = block_rows(dim, limit)
            if len(ids) > now:
                held[dim] = [(ids[now:], vectors[now:])]
            block = BlockIndex(ids[:now], vectors[:now])
            cells = [x.tobytes() for x in (block.ids, block.vectors, block.order, block.values)]
            return pa.record_batch([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=names)

        for batch in rows(batches, 4096):
            dims, ids = batch["dim"].to_numpy(), batch["vec_id"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                flat = batch["v"].take(pa.array(own)).flatten().to_numpy()
                held.setdefault(dim, []).append((ids[own], flat.reshape(-1, dim).copy()))
                while dim in held and sum(len(p[0]) for p in held[dim]) >= block_rows(dim, limit):
                    yield built(dim)
            while sum(p[1].nbytes for parts in held.values() for p in parts) > limit:  # many dimensions, none of which fills a block
                yield built(max(held, key=lambda dim: sum(p[1].nbytes for p in held[dim])))
        while held:
            yield built(next(iter(held)))

    names, limit = [x.split()[0] for x in _INDEX.split(", ")], BLOCK_BYTES
    spark = base.sparkSession
    size = base.agg(F.sum(F.col("dim") * 16 + 6 * PROJECTIONS)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // limit))
    return materialized(base.coalesce(parts).mapInArrow(run, _INDEX), "nearest-index")


def _search_pass(index: DataFrame, queries: dict[int, tuple[bytes, bytes]], k: int) -> DataFrame:
    """(query_id, vec_id, score): for each task, each query's k nearest found in the task's blocks. queries has ids and vectors by dimension."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {dim: (np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, dim)) for dim, (ids, v) in shared.value.items()}
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [(np.empty(0, np.int64), np.empty(0))] * len(ids) for dim, (ids, _) in wanted.items()}
        for batch in rows(batches, 1):
            dim = batch["dim"][0].as_py()
            if dim not in wanted:
                continue
            ids, vectors, order, values = (np.frombuffer(batch[c][0].as_buffer(), kind) for c, kind in (("ids", np.int64), ("vectors", np.float64), ("places", np.uint16), ("projected", np.float32)))
            block = BlockIndex(ids, vectors.reshape(-1, dim), order.reshape(PROJECTIONS, -1), values.reshape(PROJECTIONS, -1))
            query_ids, asked = wanted[dim]
            for q, found in enumerate(block.search(asked, query_ids, k, [s for _, s in best[dim]])):
                found = tuple(np.concatenate(x) for x in zip(best[dim][q], found, strict=True))
                top = np.lexsort((found[0], -found[1]))[:k]
                best[dim][q] = found[0][top], found[1][top]
        for dim, (query_ids, _) in wanted.items():
            found = best[dim]
            of = np.repeat(query_ids, [len(ids) for ids, _ in found])
            if len(of):
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([ids for ids, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k nearest found among all other rows.

    The base table is indexed once; the index is read once for every QUERY_BYTES of query vectors. A pass sends that bounded lot to all tasks,
    and writes each task's k best a query. The passes' results are then merged by query, with a limit to k a query before the shuffle."""
    spark = vectors.sparkSession
    asked = usable(vectors.where(is_query), id_column, vector_column).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialized(asked.withColumn("bytes", F.size("v") * 8), "queries")
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    passes = max(1, -(-total // QUERY_BYTES))
    index = written_index(usable(vectors, id_column, vector_column))
    out = scratch_dir(spark, "nearest")
    lot = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    for number in range(passes):
        queries: dict[int, list[tuple[int, list[float]]]] = {}
        for r in asked.where(lot == number).select("vec_id", "v").collect():
            queries.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        packed = {dim: (np.array([i for i, _ in own], np.int64).tobytes(), np.array([v for _, v in own]).tobytes()) for dim, own in queries.items()}
        _search_pass(index, packed, k).write.mode("append").parquet(out)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
