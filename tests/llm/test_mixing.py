import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing as M

from .conftest import prose


def plain_targets(sizes):
    """Sources by code point, null last, weigh 1, 2, 3; each in turn stops at 3 times its size where its share is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    fixed = {s: 0.0 for s in order if not sizes[s]}
    while True:
        left, free = sum(sizes.values()) - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 500}, {"a": 0, "b": 10}, {"a": 10**6, "b": 1, "c": 1, None: 1}, {f"h{k}": k * k % 97 for k in range(120)} | {None: 3}, {"a": 0, None: 0}, {}])
def test_targets(prepared, sizes):
    rows = [(s, part) for s, n in sizes.items() for part in ([n] if n < 2 else [n // 2, n - n // 2])]
    found = M.source_targets(prepared.createDataFrame(rows, "source string, size long").withColumn("n", F.lit(1))).collect()
    assert {r.source: r.source_size for r in found} == sizes
    assert {r.source: r.target for r in found} == pytest.approx(plain_targets(sizes))


def test_ranks_over_ranges(prepared):
    names = [f"s{k:03d}" for k in range(200)] + ["é", "Z", "😀", None]
    found = M.ranked(prepared.createDataFrame([(n,) for n in names], "source string"), 7).collect()
    assert [r.source for r in sorted(found, key=lambda r: r.place)] == sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert sorted(r.place for r in found) == list(range(len(names)))


def test_pivot_keeps_words_and_chances():
    draw = np.random.default_rng(0)
    size = draw.integers(1, 100, 60).astype(float)
    p = draw.random(60)
    total = np.zeros(60)
    for k in range(3000):
        out = M.pivot(size, p, np.random.default_rng(k).random(61))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - p).max() < 0.06


def check(rows, out):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = defaultdict(int)
    for source, text in rows:
        sizes[source] += len(words.findall(text or ""))
    targets = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6


def test_mix(prepared):
    rows = [(k, prose(k, 5 + 7 * (k % 11)), ["a", "b", None, "é", "z"][0 if k % 3 == 0 else k % 5]) for k in range(400)]
    df = prepared.createDataFrame(rows, "doc_id long, text string, source string")
    first = M.mix(df, block_rows=16, fan_in=3).collect()
    check([(s, t) for _, t, s in rows], first)
    again = M.mix(df.repartition(7), block_rows=16, fan_in=3).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_edges(edge_docs, empty_docs):
    rows = edge_docs.collect()
    out = M.mix(edge_docs).collect()
    assert len(out) == len(rows) and {r.taken for r in out if r["size"] == 0} == {0}
    check([(r.source, r.text) for r in rows], out)
    assert M.mix(empty_docs).collect() == []
    mixed = M.mixed(edge_docs).collect()
    assert sum(len((r.text or "").split(" ")) for r in mixed) > 0 and M.mixed(empty_docs).collect() == []
    assert M.mixed(edge_docs).columns == edge_docs.columns
    copies = sum(r.copies for r in M.mix(edge_docs).collect())
    assert len(mixed) == copies


def test_hot_groups_of_copies(prepared, monkeypatch):
    """A null id with one text holds most rows: its copies are one entry, and its rows come out in pieces."""
    monkeypatch.setattr(M, "PIECE_ROWS", 16)
    rows = [(None, "the same seven words in each row", "a")] * 300 + [(k, prose(k, 9), "ab"[k % 2]) for k in range(100)]
    df = prepared.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = M.mix(df, block_rows=16, fan_in=3).collect()
    check([(s, t) for _, t, s in rows], out)
    assert len(out) == 400 and sum(r.doc_id is None for r in out) == 300
    counted = defaultdict(int)
    for r in out:
        counted[r.doc_id] += r.copies
    mixed = defaultdict(int)
    for r in M.mixed(df, block_rows=16, fan_in=3).collect():
        mixed[r.doc_id] += 1
    assert mixed == {k: n for k, n in counted.items() if n}
