"""Repeated passages: paragraph MinHash banding, exact verification, removals clustered by components.

A paragraph is a line of at least SHINGLE_WORDS words; shorter lines have no shingle. Paragraphs whose MinHash signatures share a band are compared by the exact Jaccard
similarity of their five-word shingles; links at SIMILARITY or more form components. BANDS x ROWS are tuned for recall: a pair at the
threshold shares a band with chance 1 - (1 - 0.8 ** 2) ** 5 = 0.994. Exact copies are one node of that graph. Of a component, or of the copies
of a paragraph without links, the first (smallest doc_id, then place) stays, the others go whole, at any length.

What is left may still repeat passages inside longer paragraphs. It is cut into all its overlapping blocks of MIN_RUN_WORDS words, and a block is
signed by one MinHash value over its windows of WINDOW_WORDS words (neighbouring blocks mostly have the same, which is kept once). So any repeat of
MIN_RUN_WORDS words or more collides with the first occurrence of a window of it, whatever its marks. Each collision is verified word by
word, from the window to either side: an unlike word is passed over only if four like ones make up for it, so that a changed word does not end a
passage, and of every extension 0.8 or more is alike. What comes first is kept. A document loses runs of repeated words where they add up to
MIN_RUN_WORDS words; fewer than MIN_GAP_WORDS words between them, within a line or whole lines, belong to the run.
Words are compared lower-cased and without marks at their edges.

Shuffles carry hashes (also of the words around repeated windows) and places. Texts are read three times more: for paragraphs that share a band with a
different one, for the words around windows, and for removals; what is joined to them is broadcast where its counted size is small, otherwise the
texts are shuffled.

Defined cases: null text stays null and has no paragraph; rows that agree in doc_id and text count as one document, each row keeps its copy; rows of
equal doc_id and different texts are different documents; null ids come first; a repeat within one document counts like any other; texts
without line breaks are one paragraph, whatever their length; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import delete_tree, materialized, maybe_broadcast, parts_for, rows
from orrery.llm.components import connected_components
from orrery.llm.words import Words, folded, mix

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 5, 2
MIN_RUN_WORDS = 25
MIN_GAP_WORDS = 4
#: Windows of so many words; a block of MIN_RUN_WORDS words has WINDOW_SPAN of them.
WINDOW_WORDS = 8
WINDOW_SPAN = MIN_RUN_WORDS - WINDOW_WORDS + 1
#: A repeated window is extended word by word, at most so far to either side: from the outermost windows that reaches the passage's ends, also
#: where a changed word leaves fewer than MIN_RUN_WORDS words beyond it.
REACH_WORDS = WINDOW_SPAN + MIN_RUN_WORDS - 3
#: Members of a band are compared in blocks of so many; a task holds two blocks.
BLOCK_MEMBERS = 256

_EDGE = b".,;:!?\"'()[]{}|*#%&$<>-"
_ODD = np.random.default_rng(5).integers(0, 2**63, 2 * 16 + SHINGLE_WORDS, np.uint64) | np.uint64(1)
_WINDOW_ODD = np.random.default_rng(6).integers(0, 2**63, WINDOW_WORDS, np.uint64) | np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _sliding(f: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """The least (or largest) of every span neighbours, in about log2(span) steps."""
    width = 1
    while 2 * width <= span:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: width - span], x[span - width :]) if width < span else x


class Cut:
    """The words and lines of a batch of texts, as arrays over all of them."""

    def __init__(self, texts: list[str | None]):
        self.words = Words([folded(t or "") for t in texts], _EDGE)
        self.word, self.word_doc, self.first_word = self.words.hash, self.words.doc, self.words.first_word
        edges = np.flatnonzero(np.diff(self.words.line)) + 1
        self.line_starts = np.concatenate([[0], edges]) if len(self.word) else np.empty(0, np.int64)
        self.line_ends = np.append(edges, len(self.word)) if len(self.word) else np.empty(0, np.int64)
        self.line_doc = self.word_doc[self.line_starts]

    def sequence_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Order-sensitive hashes of word runs that cover all words."""
        if not len(starts):
            return np.empty(0, np.uint64)
        n = ends - starts
        powers = np.multiply.accumulate(np.full(int(n.max()) + 1, _PLACE))
        place = np.arange(len(self.word)) - np.repeat(starts, n)
        return mix(np.add.reduceat(mix(self.word) * powers[place], starts) + n.astype(np.uint64))

    def shingles(self) -> np.ndarray:
        """Hash of the SHINGLE_WORDS words from each word on (meaningless for the last words)."""
        mixed = mix(self.word)
        out = np.zeros(len(mixed), np.uint64)
        for k in range(SHINGLE_WORDS):
            out[: len(mixed) - k] += mixed[k:] * _ODD[k]
        return mix(out)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows that sign some block of MIN_RUN_WORDS words: those of the least hash in it."""
        n = len(self.word) - MIN_RUN_WORDS + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        mixed = mix(self.word)
        m = len(mixed) - WINDOW_WORDS + 1
        hashes = np.zeros(m, np.uint64)
        for k in range(WINDOW_WORDS):
            hashes += mixed[k : k + m] * _WINDOW_ODD[k]
        hashes = mix(hashes)
        least = _sliding(np.minimum, hashes, WINDOW_SPAN)
        least[self.word_doc[:n] != self.word_doc[MIN_RUN_WORDS - 1 :]] = 0  # not within one document
        edge = np.zeros(WINDOW_SPAN - 1, np.uint64)
        kept = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), WINDOW_SPAN) == hashes)
        return kept, hashes[kept]

    def bands(self, lines: np.ndarray) -> np.ndarray:
        """(lines, BANDS) band hashes of the lines with these numbers, each of SHINGLE_WORDS words or more."""
        if not len(lines):
            return np.empty((0, BANDS), np.uint64)
        starts, stops = self.line_starts[lines], self.line_ends[lines] - SHINGLE_WORDS + 1
        n = stops - starts
        offsets = np.cumsum(n) - n
        own = self.shingles()[np.arange(int(n.sum())) + np.repeat(starts - offsets, n)]
        # Shingle hashes are well mixed, so that multiples of them by odd numbers already are orders of their own.
        least = [np.minimum.reduceat(own * _ODD[SHINGLE_WORDS + k], offsets) for k in range(BANDS * ROWS)]
        out = np.empty((len(lines), BANDS), np.uint64)
        for b in range(BANDS):
            total = np.full(len(lines), b, np.uint64)
            for r in range(ROWS):
                total = mix(total * _PLACE + least[b * ROWS + r])
            out[:, b] = total
        return out


_LINES = "doc_id long, rid long, first int, stop int, h long, bands array<long>, at array<int>, seeds array<long>"


def lines(docs: DataFrame) -> DataFrame:
    """A row a line: words first to stop - 1 of document (doc_id, rid); its hash and bands (null for lines under SHINGLE_WORDS words); the
    windows kept that start in it, as places and hashes. Short lines without a window have no row."""

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            cut = Cut(batch["text"].to_pylist())
            at, seeds = cut.windows()
            counts = np.bincount(np.searchsorted(cut.line_starts, at, "right") - 1, minlength=len(cut.line_starts)) if len(at) else np.zeros(len(cut.line_starts), np.int64)
            long = cut.line_ends - cut.line_starts >= SHINGLE_WORDS
            own = np.flatnonzero(long | (counts > 0))
            base, of = cut.first_word[cut.line_doc[own]], pa.array(cut.line_doc[own])
            hashes = pa.array(cut.sequence_hashes(cut.line_starts, cut.line_ends)[own].view(np.int64), mask=~long[own])
            bands = cut.bands(np.flatnonzero(long)).ravel().view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long[own] * BANDS)]).astype(np.int32), mask=np.append(~long[own], False)), pa.array(bands))
            places = [pa.array((x[own] - base).astype(np.int32)) for x in (cut.line_starts, cut.line_ends)]
            windows = [lists((at - cut.first_word[cut.word_doc[at]]).astype(np.int32), counts[own]), lists(seeds.view(np.int64), counts[own])]
            yield pa.record_batch([batch["doc_id"].take(of), batch["rid"].take(of), *places, hashes, bands, *windows], names=names)

    names = [x.split()[0] for x in _LINES.split(", ")]
    return docs.select("doc_id", "rid", "text").where("text IS NOT NULL").mapInArrow(run, _LINES)


def band_members(banded: DataFrame, parts: int) -> DataFrame:
    """Distinct (h, band) of the bands that different h share, one of those with the same h, written."""
    shared = banded.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("band")
    shared = materialized(shared, "shared-bands", parts)
    members = materialized(banded.join(maybe_broadcast(shared, 16), "band").distinct(), "band-members", parts)
    # Near copies mostly share several bands, with the same members: one of those is enough. Sets are told apart by size and two sums of hashes.
    held = members.groupBy("band").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
    needed = materialized(held.groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band"), "needed-bands", parts)
    return materialized(members.join(maybe_broadcast(needed, 16), "band", "left_semi"), "needed-members", parts)


def _paragraph_links(docs: DataFrame, paragraphs: DataFrame, firsts: DataFrame, parts: int) -> DataFrame:
    """(a, b): hashes of different paragraphs with similarity SIMILARITY or more that share a band. firsts: a place of each hash."""
    members = band_members(paragraphs.select("h", F.explode("bands").alias("band")), parts)
    wanted = materialized(members.select("h").distinct(), "compared", parts)
    if wanted.isEmpty():
        return members.select(F.col("h").alias("a"), F.col("band").alias("b"))
    places = firsts.join(maybe_broadcast(wanted, 16), "h").groupBy("doc_id", "rid").agg(F.collect_list(F.struct("h", "first", "stop")).alias("wanted"))
    places = materialized(places.withColumnRenamed("doc_id", "own_id").withColumnRenamed("rid", "own_rid"), "compared-places", parts)
    # Rows alike in id and text would each give the paragraph: one of them is enough.
    texts = docs.join(maybe_broadcast(places, 40 + 24 * F.size("wanted")), _here()).select("text", "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            cut, lists = Cut(batch["text"].to_pylist()), batch["wanted"]
            wanted = lists.flatten()
            base = np.repeat(cut.first_word[:-1], lists.value_lengths().to_numpy())
            starts, stops = (base + wanted.field(c).to_numpy() for c in ("first", "stop"))
            shingles = cut.shingles()
            found = [np.unique(shingles[a : b - SHINGLE_WORDS + 1]).tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.record_batch([wanted.field("h"), pa.array(found, pa.binary())], names=["h", "shingles"])

    shingled = materialized(texts.mapInArrow(sets, "h long, shingles binary").groupBy("h").agg(F.first("shingles").alias("shingles")), "shingle-sets")  # wide rows: as many files as partitions
    return verified_links(members, shingled)


def verified_links(members: DataFrame, shingled: DataFrame) -> DataFrame:
    """(a, b): links among the members (h, band) of each band, by the exact similarity of their sets (h, shingles as sorted uint64)."""
    # Only bands of more than one block are looked up, so a hot band is not gathered in one task by this join.
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")).where("blocks > 1")
    sizes = materialized(sizes, "large-bands", 1)
    dealt = members.join(maybe_broadcast(sizes, 16), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    dealt = dealt.select("h", "band", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("h", "band", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = zip(batch["band"].to_pylist(), batch["i"].to_pylist(), batch["j"].to_pylist(), strict=True)
            for k, h, own, s in zip(keys, batch["h"].to_pylist(), batch["own"].to_pylist(), batch["shingles"], strict=True):
                if k != key:
                    yield from _edges(held, key)
                    key, held = k, []
                held.append((h, own, _member(s.as_buffer())))
        yield from _edges(held, key)

    ordered = dealt.join(shingled, "h").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "h")
    return ordered.mapInArrow(verify, "a long, b long").distinct()


def similarity(a: np.ndarray | frozenset, b: np.ndarray | frozenset) -> float:
    """Exact Jaccard of two sets, as frozensets or sorted arrays."""
    shared = len(a & b) if isinstance(a, frozenset) and isinstance(b, frozenset) else len(np.intersect1d(_sorted(a), _sorted(b), assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _sorted(x: np.ndarray | frozenset) -> np.ndarray:
    return x if isinstance(x, np.ndarray) else np.array(sorted(x), np.uint64)


def _member(shingles: pa.Buffer) -> np.ndarray | frozenset:
    """Small sets meet faster as frozensets; longer ones stay arrays of 8 bytes an entry, an eighth of the memory."""
    found = np.frombuffer(shingles, np.uint64)
    return frozenset(found.tolist()) if len(found) <= 128 else found


def _edges(held: list[tuple[int, int, np.ndarray | frozenset]], key: tuple | None) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links among one block pair's members. A member is compared with each component until a first link."""
    if len(held) < 2:
        return
    left, right, groups = [], [], []
    for h, own, s in held:
        linked = []
        for group in groups:
            for other, other_own, t in group:
                if (key[1] == key[2] or own != other_own) and min(len(s), len(t)) >= SIMILARITY * max(len(s), len(t)) and similarity(s, t) >= SIMILARITY:
                    left.append(h)
                    right.append(other)
                    linked.append(group)
                    break
        merged = [(h, own, s)]
        for group in linked:
            merged += group
            groups.remove(group)
        groups.append(merged)
    if left:
        yield pa.record_batch([pa.array(left), pa.array(right)], names=["a", "b"])


def _here() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("rid") == F.col("own_rid"))


def _firsts(occurrences: DataFrame, key: str) -> DataFrame:
    """(key, own_id, own_rid, own_first): the first occurrence of each key."""
    kept = occurrences.groupBy(key).agg(F.min(F.struct("doc_id", "rid", "first")).alias("kept"))
    return kept.select(key, F.col("kept.doc_id").alias("own_id"), F.col("kept.rid").alias("own_rid"), F.col("kept.first").alias("own_first"))


def _repeated_paragraphs(docs: DataFrame, paragraphs: DataFrame, parts: int) -> DataFrame:
    """(h, own_id, own_rid, own_first): the hashes of paragraphs that have copies or near copies, with the first place of their component."""
    place = F.min(F.struct("doc_id", "rid", "first", "stop")).alias("place")
    firsts = materialized(paragraphs.groupBy("h").agg(place, F.count("*").alias("n")).select("h", "place.*", "n"), "paragraph-firsts", parts)
    linked = materialized(connected_components(_paragraph_links(docs, paragraphs, firsts, parts), parts).withColumnRenamed("node", "h"), "paragraph-links", parts)
    found = firsts.join(maybe_broadcast(linked, 24), "h", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "h"))
    found = materialized(found, "paragraph-clusters", parts)
    kept = materialized(_firsts(found, "component"), "paragraph-kept", parts)
    return materialized(found.select("h", "component").join(maybe_broadcast(kept, 40), "component").drop("component"), "repeated-paragraphs", parts)


def _contexts(docs: DataFrame, firsts: DataFrame, parts: int) -> DataFrame:
    """(h, own_id, own_rid, own_first, around): the first occurrences of windows with the words around them."""
    wanted = firsts.groupBy("own_id", "own_rid").agg(F.collect_list(F.struct("h", "own_first")).alias("wanted"))
    wanted = materialized(wanted, "context-places", parts)
    texts = docs.join(maybe_broadcast(wanted, 40 + 16 * F.size("wanted")), _here()).select("own_id", "own_rid", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            cut = Cut(batch["text"].to_pylist())
            lists = batch["wanted"]
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            first, owner = lists.flatten().field("own_first"), pa.array(of)
            around = neighbours(cut, of, first.to_numpy())
            yield pa.record_batch([lists.flatten().field("h"), batch["own_id"].take(owner), batch["own_rid"].take(owner), first, binary_rows(around)], names=names)

    fields = "h long, own_id long, own_rid long, own_first int, around binary"
    names = [x.split()[0] for x in fields.split(", ")]
    # Rows alike in id and text each give the words: one of them is enough.
    found = texts.mapInArrow(run, fields)
    return found.groupBy("h").agg(*(F.first(n).alias(n) for n in names[1:]))


def neighbours(cut: Cut, doc: np.ndarray, first: np.ndarray, none: int = 0) -> np.ndarray:
    """For windows (text number, first word in it) the REACH_WORDS words after and before them, each from the window outwards, as odd 16-bit
    hashes; none where the text has no more."""
    words = (cut.word >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    low, high = cut.first_word[doc, None], cut.first_word[doc + 1, None]
    at, step = (cut.first_word[doc] + first)[:, None], np.arange(REACH_WORDS)
    places = np.hstack([at + WINDOW_WORDS + step, at - 1 - step])
    inside = (places >= low) & (places < high)
    return np.where(inside, words[np.where(inside, places, 0)] if len(words) else np.uint16(0), np.uint16(none))


def binary_rows(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """The inverse of binary_rows, for 16-bit values."""
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, width)


def extended(cut: Cut, doc: np.ndarray, first: np.ndarray, own_first: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word ranges (starts, stops) of repeated windows with the words around them that agree with those at the first occurrence: from the
    window outwards an unlike word counts -4, a like one 1, and the range ends where the sum is largest. own_first is that occurrence's place if
    it is in the same text, whose words stay, else -1."""
    like = neighbours(cut, doc, first, none=2) == around
    score = np.cumsum(np.where(like, 1, -4).reshape(-1, 2, REACH_WORDS), axis=2)
    reach = np.where(score.max(axis=2) > 0, score.argmax(axis=2) + 1, 0)
    starts, stops = first - reach[:, 1], first + WINDOW_WORDS + reach[:, 0]
    return np.where(own_first < 0, starts, np.maximum(starts, own_first + WINDOW_WORDS)), stops


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, spans, marks): word ranges of docs (doc_id, rid, text) that repeat an earlier paragraph, and windows of the other
    paragraphs that repeat an earlier one, with the words around that."""
    found = materialized(lines(docs), "lines")
    parts = parts_for(found.count())
    paragraphs = found.where("h IS NOT NULL")
    known = _repeated_paragraphs(docs, paragraphs, parts)
    side, same = maybe_broadcast(known, 40), _here() & (F.col("first") == F.col("own_first"))
    gone = materialized(paragraphs.drop("bands", "at", "seeds").join(side, "h").where(~same).select("doc_id", "rid", "first", "stop"), "gone-paragraphs", parts)

    kept = paragraphs.where("size(at) > 0").join(side, "h", "left").where(F.col("own_first").isNull() | same).select("doc_id", "rid", "at", "seeds")
    kept = kept.union(found.where("h IS NULL").select("doc_id", "rid", "at", "seeds"))
    windows = kept.select("doc_id", "rid", F.explode(F.arrays_zip("at", "seeds")).alias("w")).select(F.col("w.seeds").alias("h"), "doc_id", "rid", F.col("w.at").alias("first"))
    twice = materialized(windows.groupBy("h").count().where("count > 1").select("h"), "repeated-windows", parts)
    windows = materialized(windows.join(maybe_broadcast(twice, 16), "h"), "window-places", parts)
    delete_tree(docs.sparkSession, found.inputFiles()[0].rpartition("/")[0])  # all that is left comes from the tables made of it
    firsts = materialized(_firsts(windows, "h"), "first-windows", parts)
    contexts = materialized(_contexts(docs, firsts, parts), "window-contexts", parts)
    mark = F.struct("first", F.when(_here(), F.col("own_first")).otherwise(-1).alias("own_first"), "around").alias("mark")
    marks = windows.join(maybe_broadcast(contexts, 240), "h").where(~same).select("doc_id", "rid", mark)

    span = F.struct("first", "stop").alias("span")
    both = gone.select("doc_id", "rid", span).unionByName(marks, allowMissingColumns=True)
    return both.groupBy("doc_id", "rid").agg(F.collect_list("span").alias("spans"), F.collect_list("mark").alias("marks"))


def removed_runs(line: np.ndarray, paragraphs: list[tuple[int, int]], passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The word ranges to remove of those that repeat, given the line of each word: runs of MIN_RUN_WORDS words or more, and of shorter runs
    the whole paragraphs."""
    n, edge = len(line), np.flatnonzero(np.diff(line)) + 1
    begins, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[0], begins[n], begins[edge] = True, True, True
    closes[n - 1], closes[edge - 1] = True, True
    repeated, whole = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
    for first, stop in paragraphs:
        repeated[first + 1 : stop + 1] = whole[first + 1 : stop + 1] = True
    for first, stop in passages:
        repeated[first + 1 : stop + 1] = True

    def stretches(flags: np.ndarray) -> list[list[int]]:
        return np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2).tolist()

    def bridged(a: int, b: int) -> bool:
        return b - a < MIN_GAP_WORDS and (not begins[a : b + 1].any() or bool(begins[a] and begins[b]))

    runs: list[list[int]] = []
    for a, b in stretches(repeated):
        if runs and bridged(runs[-1][1], a):
            runs[-1][1] = b
        else:
            runs.append([a, b])
    cuts, lines_gone = [], stretches(whole)
    for a, b in runs:
        if b - a < MIN_RUN_WORDS:
            cuts += [x for x in lines_gone if a <= x[0] < b]
            continue
        # A run across lines leaves a first or last line of which it has fewer than MIN_GAP_WORDS words, and not the whole.
        for k in range(1, MIN_GAP_WORDS):
            if not closes[b - 1] and begins[b - k]:
                b -= k
                break
        for k in range(1, MIN_GAP_WORDS):
            if not begins[a] and closes[a + k - 1]:
                a += k
                break
        cuts.append([a, b])
    return [(a, b) for a, b in cuts if a < b]


def character_ranges(text: str, cut: Cut, doc: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points of a text to remove for word ranges: up to the next word, but a line that keeps its beginning keeps its break."""
    own = slice(cut.first_word[doc], cut.first_word[doc + 1])
    starts, stops, line = cut.words.start[own], cut.words.stop[own], cut.words.line[own]
    n, places = len(line), []
    for a, b in runs:
        closed = b == n or (line[b - 1] != line[b] and a > 0 and line[a - 1] == line[a])
        places += [starts[a], stops[b - 1] if closed else starts[b]]
    if not text.isascii():
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        places = before[places]
    places = [int(x) for x in places]
    return list(zip(places[::2], places[1::2], strict=True))


def _by_text(texts: int, of: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    for d, a, b in zip(of.tolist(), starts.tolist(), stops.tolist(), strict=True):
        out[d].append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with repeated passages cut out of text, and columns removed (array of start, end in the old
    text's code points) and removed_words appended; columns of those names, or named rid, spans and marks, are replaced."""
    kept = docs.drop("removed", "removed_words", "rid", "spans", "marks")
    keyed = kept.withColumn("rid", F.xxhash64(F.col("text")))
    places = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "text")
    found = materialized(repeats(places), "repeats").withColumnRenamed("doc_id", "own_id").withColumnRenamed("rid", "own_rid")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("own_id")) & (F.col("rid") == F.col("own_rid"))
    size = 60 + 8 * F.size("spans") + 200 * F.size("marks")
    joined = keyed.join(maybe_broadcast(found, size), same, "left").drop("own_id", "own_rid", "rid")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            texts = batch["text"].to_pylist()
            removed, words = [[] for _ in texts], [0] * len(texts)
            touched = np.flatnonzero(batch["spans"].is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                spans, marks = (batch[c].take(pa.array(touched)) for c in ("spans", "marks"))
                cut = Cut([texts[k] for k in touched])
                of = np.repeat(np.arange(len(touched)), marks.value_lengths().to_numpy())
                mark = marks.flatten()
                around = matrix(mark.field("around"), 2 * REACH_WORDS)
                starts, stops = extended(cut, of, *(mark.field(c).to_numpy() for c in ("first", "own_first")), around)
                span = spans.flatten()
                whole = np.repeat(np.arange(len(touched)), spans.value_lengths().to_numpy()), span.field("first").to_numpy(), span.field("stop").to_numpy()
                whole, passages = (_by_text(len(touched), *x) for x in (whole, (of, starts, stops)))
                for d, k in enumerate(touched.tolist()):
                    text, line = texts[k], cut.words.line[cut.first_word[d] : cut.first_word[d + 1]]
                    runs = removed_runs(line, whole[d], passages[d])
                    if runs:
                        ranges = character_ranges(text, cut, d, runs)
                        edges = [0, *(x for r in ranges for x in r), len(text)]
                        texts[k] = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                        removed[k], words[k] = [{"start": a, "end": b} for a, b in ranges], sum(b - a for a, b in runs)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch[n] for n in names]
            yield pa.record_batch([*columns, pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(words, pa.int32())], names=[*names, "removed", "removed_words"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "removed array<struct<start:int,end:int>>, removed_words int"])
    return joined.mapInArrow(run, fields)
