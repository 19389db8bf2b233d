import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import simhash as S
from orrery.llm.components import connected_components

from .conftest import prose


def brute(rows, radius=3):
    fps = [S.fingerprint(t) for _, t in rows]
    points = sorted(set(fps))
    owner = {p: {p} for p in points}
    for a in points:
        for b in points:
            if bin(a ^ b).count("1") <= radius and owner[a] is not owner[b]:
                owner[a] |= owner[b]
                for x in owner[b]:
                    owner[x] = owner[a]
    out = []
    for (doc_id, _), fp in zip(rows, fps, strict=True):
        group = [i for (i, _), f in zip(rows, fps, strict=True) if f in owner[fp] and i is not None]
        out.append((doc_id, f"{fp:016x}", min(group, default=None)))
    return out


def plain_fingerprint(text):
    """Straight from the definition."""
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \x0b\x0c ", "One", "one two", "ÀB c d", "a a a a a a", prose(3, 500), "x\x85y z\xa0w q"])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_hash_is_sparks(prepared):
    import xxhash

    assert prepared.range(1).select(F.xxhash64(F.lit("the river ünder"))).first()[0] & 2**64 - 1 == xxhash.xxh64_intdigest("the river ünder".encode(), 42)


def test_near_duplicates(prepared, edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(map(str, (tuple(r) for r in S.near_duplicates(edge_docs).collect()))) == sorted(map(str, brute(rows)))
    assert S.near_duplicates(empty_docs).collect() == []


def test_chains_of_near_copies(prepared):
    rows = []
    for family in range(6):
        words = prose(family, 150).split()
        for k in range(12):
            rows.append((family * 100 + k, " ".join(words)))
            words[(k * 11) % 150] = f"w{family}{k}"
    df = prepared.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.near_duplicates(df).collect())) == sorted(brute(rows))


@pytest.mark.parametrize("points", [10, 10**4, 10**7, 10**10])
def test_cells_lose_no_pair(prepared, points):
    """Every pair within the radius shares a cell, at the group count for any number of points."""
    groups = S.group_count(points, 3)
    draw = np.random.default_rng(groups)
    base = draw.integers(0, 2**63, 40, np.uint64)
    flipped = base.copy()
    for k in range(40):
        for bit in draw.choice(64, 3, replace=False):
            flipped[k] ^= np.uint64(1) << np.uint64(bit)
    df = prepared.createDataFrame([(int(x),) for x in np.concatenate([base, flipped]).view(np.int64)], "fp long")
    cells = {}
    for r in S.cells(df, groups, 3).collect():
        cells.setdefault(r.fp, set()).add(r.cell)
    assert all(cells[int(a)] & cells[int(b)] for a, b in zip(base.view(np.int64), flipped.view(np.int64), strict=True))


def test_manhattan_bounds_hamming():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 2**63, 500, np.uint64), draw.integers(0, 2**63, 500, np.uint64)
    distance = np.abs(S.popcounts(a).astype(int) - S.popcounts(b).astype(int)).sum(axis=1)
    assert (distance <= np.bitwise_count(a ^ b)).all()


def test_forest_over_blocks():
    draw = np.random.default_rng(4)
    centre = draw.integers(0, 2**63, 3, np.uint64)
    points = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            points.add(int(c) ^ (1 << int(draw.integers(64))) ^ (1 << int(draw.integers(64))))
    fps = np.array(sorted(points), np.uint64)
    for block in (7, 1024):
        a, b = S.forest(fps, 3, block)
        assert len(a) == len(fps) - 3 and (np.bitwise_count(a ^ b) <= 3).all()


def test_large_cells_are_split(prepared, monkeypatch):
    """Cells beyond CELL_POINTS go through pairs of blocks and lose no link."""
    draw = np.random.default_rng(11)
    points = {0}
    while len(points) < 150:
        points.add(list(points)[int(draw.integers(len(points)))] ^ (1 << int(draw.integers(40))))
    df = prepared.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in points], "fp long")
    whole = {(r.node, r.component) for r in connected_components(S.links(df)).collect()}
    monkeypatch.setattr(S, "CELL_POINTS", 16)
    assert {(r.node, r.component) for r in connected_components(S.links(df)).collect()} == whole and {c for _, c in whole} == {min(p for p, _ in whole)}


def test_unary_counts_manhattan():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 2**64, 500, np.uint64), draw.integers(0, 2**64, 500, np.uint64)
    distance = np.abs(S.popcounts(a).astype(int) - S.popcounts(b).astype(int)).sum(axis=1)
    assert (np.bitwise_count(S.unary(a) ^ S.unary(b)) == distance).all()


def test_components(prepared):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 100), (300, None)]
    df = prepared.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 100}
    assert connected_components(df.limit(0)).collect() == []
