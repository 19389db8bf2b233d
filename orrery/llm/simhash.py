"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into narrow segments; the vector of their bit counts is a point on a grid. Two fingerprints at Hamming
distance d lie at Manhattan distance at most d, so a range join on the grid loses no pair. The grid is searched by cells: the segments are
dealt to g groups, and points within Manhattan distance r agree exactly on at least g - r groups, so they share the cell made of some
g - r groups' counts. g follows the number of distinct fingerprints, so that chance sharing of cells stays rare at any size. Within a
cell only pairs within Manhattan distance r go on to the exact Hamming distance.

Copies with one fingerprint are one point. A cell yields a spanning forest of its links, never all its pairs; components of the forest are
those of all links. A cell of more than CELL_POINTS points is not compared by the task that meets it: its points are dealt to blocks, and
every pair of blocks is a task's work of its own.

Defined cases: null or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle is one shingle;
rows of equal or null doc_id each get a row, and a component's id is its smallest non-null doc_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialized, maybe_broadcast, parts_for, rows
from orrery.llm.components import connected_components

SEGMENT_BITS = 2
#: Chance that two independent even bits' segment counts agree (0, 1, 2 with weights 1/4, 1/2, 1/4).
_SEGMENT_MATCH = 0.375
CELL_POINTS = 8192


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of A-Z-lowered word shingles hashed with XXH64 seed 42, repeats counted; a bit is set if set in over half of them."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    return majority(np.array([xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes (uint64)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, rid, fp) a row: rid is a hash of the text, fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch["doc_id"], batch["rid"], pa.array(fps)], names=["doc_id", "rid", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    return keyed.mapInArrow(run, "doc_id long, rid long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Per-segment bit counts, one row a fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // SEGMENT_BITS, SEGMENT_BITS).sum(axis=2, dtype=np.uint8)


def group_count(points: int, radius: int) -> int:
    """Fewest segment groups for which a point expects at most one chance partner, over all of its cells."""
    segments = 64 // SEGMENT_BITS
    for g in range(radius + 1, segments // 2 + 1):
        shared = segments * (g - radius) / g
        if points * math.comb(g, radius) * _SEGMENT_MATCH**shared <= 1:
            return g
    return segments // 2


def cells(points: DataFrame, groups: int, radius: int) -> DataFrame:
    """(cell, fp) for every choice of groups - radius groups: the cell hashes the choice and its groups' counts."""
    choices = [np.array([s for g in keep for s in range(g, 64 // SEGMENT_BITS, groups)]) for keep in combinations(range(groups), groups - radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(64).integers(1, 2**63, (64 // SEGMENT_BITS, len(choices)), np.uint64) | np.uint64(1)
        salt = np.random.default_rng(65).integers(1, 2**63, len(choices), np.uint64)
        for batch in rows(batches, 4096):
            fps = batch["fp"].to_numpy()
            v = popcounts(fps.view(np.uint64)).astype(np.uint64)
            keys = np.empty((len(fps), len(choices)), np.uint64)
            for k, chosen in enumerate(choices):
                x = (v[:, chosen] * weights[chosen, k]).sum(axis=1, dtype=np.uint64) + salt[k]
                x ^= x >> np.uint64(31)
                keys[:, k] = x * np.uint64(0x9E3779B97F4A7C15)
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(choices)))], names=["cell", "fp"])

    return points.mapInArrow(run, "cell long, fp long")


def unary(fps: np.ndarray) -> np.ndarray:
    """Segment bit counts in unary (none, one, two of a segment's bits set: 00, 01, 11), so that bits that differ count the Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    a, b = fps & low, fps >> np.uint64(1) & low
    return (a | b) | (a & b) << np.uint64(1)


def forest(fps: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64), comparing block with block: first the Manhattan distance
    of their grid points, then, for pairs within the radius, the Hamming distance."""
    n = len(fps)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    counts = popcounts(fps).astype(np.int16).sum(axis=1)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order]
    points = unary(fps)
    for i in range(0, n, block):
        for j in range(i, n, block):
            if counts[j] - counts[min(i + block, n) - 1] > radius:
                break  # total counts alone are further apart than the radius, here and beyond
            near = np.bitwise_count(points[i : i + block, None] ^ points[None, j : j + block]) <= radius
            rows_near, columns_near = np.nonzero(np.triu(near, 1) if i == j else near)
            linked = np.bitwise_count(fps[i + rows_near] ^ fps[j + columns_near]) <= radius
            for a, b in zip(rows_near[linked].tolist(), columns_near[linked].tolist(), strict=True):
                x, y = find(i + a), find(j + b)
                if x != y:
                    root[y] = x
                    left.append(fps[i + a])
                    right.append(fps[j + b])
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _cell_forests(dealt: DataFrame, key: list[str], radius: int, most: int | None) -> DataFrame:
    """(a, b, cell): of rows (key..., fp) sorted by key, the links of each key's points; of keys with more than most points, all points as
    (fp, null, cell) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, size = None, [], 0  # one key's points, 8 bytes each, until it is known to be large

        def out(a: np.ndarray, b: pa.Array, cell: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), b, cell], names=["a", "b", "cell"])

        def passed(parts: list[np.ndarray], cell: int) -> pa.RecordBatch:
            a = np.concatenate(parts)
            return out(a, pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), cell)))

        def linked(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = forest(np.unique(np.concatenate(parts)).view(np.uint64), radius)
            if len(a):
                yield out(a.view(np.int64), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = [batch[k].to_numpy() for k in key], batch["fp"].to_numpy()
            edges = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(fps)]])
            sizes = ends - starts
            # Keys of one point have no pair; only the batch's first and last keys can go on elsewhere.
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                own = tuple(int(x[starts[k]]) for x in keys)
                if own != held_key:
                    if size > 1 and held:
                        yield from linked(held)
                    held_key, held, size = own, [], 0
                held.append(fps[starts[k] : ends[k]].copy())
                size += len(held[-1])
                if most is not None and size > most:
                    yield passed(held, held_key[0])
                    held = []
        if size > 1 and held:
            yield from linked(held)

    return dealt.mapInArrow(run, "a long, b long, cell long")


def links(points: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): for distinct fingerprints fp, edges whose components are those of all links at radius or fewer differing bits."""
    count = points.count()  # points are a written table: its count is in the files' footers
    dealt = cells(points, group_count(count, radius), radius).repartition("cell").sortWithinPartitions("cell")
    found = materialized(_cell_forests(dealt, ["cell"], radius, CELL_POINTS), "cell-links", 4 * parts_for(count))
    edges = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL").select("cell", F.col("a").alias("fp"))
    if not large.isEmpty():
        blocks = materialized(large.groupBy("cell").agg(F.ceil(F.count("*") / CELL_POINTS).cast("int").alias("blocks")), "large-cells", 1)
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = large.join(maybe_broadcast(blocks, 16), "cell").select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        edges = edges.union(_cell_forests(dealt, ["cell", "i", "j"], radius, None).select("a", "b"))
    return edges.distinct()


def components(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component): for every distinct fingerprint, the smallest fingerprint reachable."""
    parts = parts_for(marked.count())
    points = materialized(marked.select("fp").distinct(), "fingerprint-points", parts)
    joined = connected_components(links(points, radius), parts)
    return materialized(points.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component")), "fingerprint-components", parts)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) a row of docs. Shuffles carry ids and fingerprints only, never texts."""
    marked = materialized(fingerprints(docs, shingle_words), "fingerprints")
    owners = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(components(marked, radius), "fp")
    least = owners.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = owners.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
