"""One document of each group of near duplicates, by five-word shingles alike by 0.8 or more: the SimHash operator at a similarity.

At that similarity two 64-bit fingerprints differ in about ten bits. Cells of the segment-popcount grid that lose no pair within so wide a radius
would hold nearly all documents (README has the figures), so the grid's components at RADIUS bits are one source of candidates, and bands of
MinHash values the other: BANDS x ROWS are tuned for recall, a pair at the threshold shares a band with chance 1 - (1 - 0.8 ** 3) ** 10 =
0.9992. Every candidate pair is verified by its exact sets, and links form components. Words are compared as by SimHash fingerprints: A-Z lowered,
cut at ASCII white space. Copies alike in all words are one point.

Defined cases: texts without a word are copies of each other; a text of fewer words than a shingle is one shingle; rows alike in id and text come
down to one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.common import materialized, maybe_broadcast, parts_for, rows
from orrery.llm.components import connected_components
from orrery.llm.paragraphs import band_members, verified_links
from orrery.llm.words import Words, mix

SHINGLE_WORDS = 5
BANDS, ROWS = 10, 3
RADIUS = 3

_ODD = np.random.default_rng(8).integers(0, 2**63, SHINGLE_WORDS + BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes (uint64) of its SHINGLE_WORDS-word runs, repeats included."""
    words = Words([(t or "").encode("utf-8").lower() for t in texts])
    found = []
    for a, b in zip(words.first_word[:-1].tolist(), words.first_word[1:].tolist(), strict=True):
        size = min(SHINGLE_WORDS, b - a)
        out = np.full(b - a - size + 1 if size else 0, size, np.uint64)
        for k in range(size):
            out += words.hash[a + k : a + k + len(out)] * _ODD[k]
        found.append(mix(out))
    return found


def bands(distinct: np.ndarray) -> np.ndarray:
    """BANDS band hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(distinct), 4096):  # multiples of well mixed hashes by odd numbers are orders of their own
        least = np.minimum(least, (distinct[at : at + 4096] * _ODD[SHINGLE_WORDS:, None]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * _ODD[0] + least[r::ROWS])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, h, fp, bands) a row: rid is a hash of the text, h of its shingle set, fp its SimHash; a text without a word has h 0, no fp
    and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            hashes, fps, found = [], [], []
            for every in shingles(batch["text"].to_pylist()):
                distinct = np.unique(every)
                hashes.append(xxhash.xxh64_intdigest(distinct.tobytes()) if len(every) else 0)
                fps.append(simhash.majority(every))
                found.append(bands(distinct).view(np.int64) if len(every) else None)
            h, fp = pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64), mask=np.array([x is None for x in found], bool))
            yield pa.record_batch([batch["doc_id"], batch["rid"], h, fp, pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "rid", "h", "fp", "bands"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    return keyed.mapInArrow(run, "doc_id long, rid long, h long, fp long, bands array<long>")


def _same() -> F.Column:
    return F.xxhash64("text").eqNullSafe(F.col("own_rid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("own_id"))


def links(docs: DataFrame, marked: DataFrame, parts: int) -> DataFrame:
    """(a, b): hashes of different shingle sets with similarity SIMILARITY or more that share a band or a component of the SimHash grid."""
    points = materialized(marked.where("fp IS NOT NULL").select("h", "fp").distinct(), "near-copy-points", parts)
    grid = points.join(maybe_broadcast(simhash.components(points, RADIUS), 24), "fp").select("h", F.xxhash64("component", F.lit("grid")).alias("band"))
    members = band_members(marked.select("h", F.explode("bands").alias("band")).distinct().union(grid), parts)
    wanted = materialized(members.select("h").distinct(), "compared", parts)
    places = marked.join(maybe_broadcast(wanted, 16), "h").groupBy("h").agg(F.min(F.struct("doc_id", "rid")).alias("p"))
    places = materialized(places.select(F.col("p.doc_id").alias("own_id"), F.col("p.rid").alias("own_rid"), "h"), "compared-places", parts)
    texts = docs.join(maybe_broadcast(places, 40), _same()).select("h", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            yield pa.record_batch([batch["h"], pa.array([np.unique(x).tobytes() for x in shingles(batch["text"].to_pylist())], pa.binary())], names=["h", "shingles"])

    # Rows alike in id and text each give the set: one of them is enough.
    shingled = texts.mapInArrow(sets, "h long, shingles binary").groupBy("h").agg(F.first("shingles").alias("shingles"))
    return verified_links(members, materialized(shingled, "shingle-sets"))  # wide rows: as many files as partitions


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest non-null doc_id, then text hash.

    Shuffles carry ids and hashes, and the shingle sets of documents that share a band; texts of kept rows are never moved."""
    marked = materialized(signatures(docs), "near-copy-signatures")
    parts = parts_for(marked.count())
    joined = materialized(connected_components(links(docs, marked, parts), parts), "near-copy-components", parts)
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")).alias("place")
    owners = marked.groupBy("h").agg(place).join(maybe_broadcast(joined, 24), F.col("h") == F.col("node"), "left")
    firsts = owners.groupBy(F.coalesce("component", "h").alias("component")).agg(F.min("place").alias("place"))
    kept = materialized(firsts.select(F.col("place.doc_id").alias("own_id"), F.col("place.rid").alias("own_rid")), "kept", parts)
    found = docs.join(maybe_broadcast(kept, 24), _same(), "left_semi")
    alike = marked.groupBy("doc_id", "rid").count().where("count > 1")
    alike = materialized(alike.select(F.col("doc_id").alias("own_id"), F.col("rid").alias("own_rid")), "alike", parts)
    if alike.isEmpty():
        return found
    side = maybe_broadcast(alike, 24)
    once = found.join(side, _same(), "left_semi")
    once = once.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return found.join(side, _same(), "left_anti").union(once)
