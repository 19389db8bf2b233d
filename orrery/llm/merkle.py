"""Document fingerprints: a Merkle tree over a text's paragraphs and sections, by DataFrame functions alone.

A paragraph node hashes a piece of the text: up to the marks . ! ? or line breaks that end it, and at most PIECE_CHARS code points before
them; the pieces together are the whole text. A section node hashes a run of paragraph nodes that ends with the first node of a last digit in
SECTION_ENDS (every eighth, on average): where a section ends depends on its pieces alone, so an inserted piece changes one section, not all later
ones. The root hashes the section nodes. Nodes are MD5 hashes cut to NODE_DIGITS hexadecimal digits (64 bits) below the root, which has 32 digits
and hashes uncut section hashes. The fingerprint reads `root:sections:paragraphs`, so equal texts have equal roots, and where roots differ, differing
sections and in them differing paragraphs locate the edit. The likeness of two fingerprints is 1 if their roots are equal, else the distinct
paragraph nodes they share over all their distinct paragraph nodes.

Defined cases: null text is empty; an empty text has a root and no nodes, and is unlike any other; documents follow each other by doc_id, then
text, nulls first, and the first follows the last; a single document follows itself; rows repeated whole follow each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE_CHARS = 128
NODE_DIGITS = 16
SECTION_ENDS = "01"
#: Code points of a text's beginning, and how many beginnings a range are sampled, to tell ranges of one id apart.
BEGIN_CHARS = 64
SAMPLE_A_RANGE = 50
PIECE = r"[^.!?\n]{0,%d}[.!?\n]+|[^.!?\n]{1,%d}" % (PIECE_CHARS, PIECE_CHARS)


def _hash(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def paragraph_nodes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda piece: F.substring(_hash(piece), 1, NODE_DIGITS))


def section_runs(paragraphs: Column) -> Column:
    """The paragraph nodes of each section, joined."""
    ends = lambda node: F.substring(node, NODE_DIGITS, 1).isin(*SECTION_ENDS)
    marked = F.array_join(F.transform(paragraphs, lambda node: F.when(ends(node), F.concat(node, F.lit(" "))).otherwise(node)), "")
    return F.filter(F.split(marked, " "), lambda run: run != "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the columns name (the fingerprint), name_nodes (its paragraph nodes) and name_runs (those of each section, joined)."""
    nodes, runs, hashes = f"{name}_nodes", f"{name}_runs", f"{name}_hashes"
    df = df.withColumn(nodes, paragraph_nodes(F.col(text)))
    df = df.withColumn(runs, section_runs(F.col(nodes)))
    df = df.withColumn(hashes, F.transform(runs, _hash))
    sections = F.array_join(F.transform(hashes, lambda h: F.substring(h, 1, NODE_DIGITS)), "")
    return df.withColumn(name, F.concat_ws(":", _hash(F.array_join(hashes, "")), sections, F.array_join(nodes, ""))).drop(hashes)


def likeness(left: str, right: str) -> Column:
    """Of two fingerprints made by with_fingerprint, by their column names."""
    a, b = F.col(f"{left}_nodes"), F.col(f"{right}_nodes")
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(F.substring(left, 1, 32) == F.substring(right, 1, 32), F.lit(1.0)).otherwise(shared)


def differing_nodes(left: str, right: str) -> Column:
    """Positions (from 0) of the paragraph nodes of left where it was edited: found by descending into the sections of left that right lacks,
    and in them to the nodes that the sections of right that left lacks do not hold."""
    a, b = F.col(f"{left}_runs"), F.col(f"{right}_runs")
    nodes = lambda run: F.regexp_extract_all(run, F.lit("." * NODE_DIGITS), F.lit(0))
    others = F.flatten(F.transform(F.array_except(b, a), nodes))
    sizes = F.transform(a, lambda run: (F.length(run) / NODE_DIGITS).cast("int"))
    first = F.transform(a, lambda run, k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda total, n: total + n))
    places = lambda run, k: F.transform(nodes(run), lambda node, j: F.when(~F.array_contains(others, node), F.element_at(first, k + 1) + j))
    apart = F.transform(a, lambda run, k: F.when(~F.array_contains(b, run), places(run, k)).otherwise(F.array().cast("array<int>")))
    return F.filter(F.flatten(apart), lambda k: k.isNotNull())


def _cuts_below(value: Column, cuts: list, sql_type: str = "bigint") -> Column:
    """How many of the sorted cuts lie below a value, searched in two levels of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[at : at + step] for at in range(0, len(cuts), step)]
    literal = lambda values: F.array(*map(F.lit, values)).cast(f"array<{sql_type}>")
    started = F.size(F.filter(literal([c[0] for c in chunks]), lambda cut: value > cut))
    own = F.element_at(F.array(*map(literal, chunks)), F.greatest(started, F.lit(1)))
    return F.when(started > 0, (started - 1) * step + F.size(F.filter(own, lambda cut: value > cut))).otherwise(0)


def _hot_ids(plain: DataFrame, ranges: int) -> dict[int | None, list[str]]:
    """Ids (or null) of more than twice the rows that a range should have, with cuts between the beginnings of their texts: at most ranges / 2
    ids, and cuts from a sample of SAMPLE_A_RANGE beginnings a range."""
    total = plain.count()
    most = 2 * total / ranges
    counts = {r["doc_id"]: r["count"] for r in plain.groupBy("doc_id").count().where(F.col("count") > most).collect()} if ranges > 1 else {}
    if not counts:
        return {}
    rate = min(1.0, SAMPLE_A_RANGE * ranges / total)
    held = F.col("doc_id").isNull() if None in counts else F.lit(False)
    held = held | F.col("doc_id").isin([i for i in counts if i is not None])
    chosen = plain.where(held & (F.pmod(F.xxhash64("text"), F.lit(2**20)) <= int(rate * 2**20)))
    begins: dict[int | None, list[str]] = {i: [] for i in counts}
    for r in chosen.select("doc_id", F.substring("text", 1, BEGIN_CHARS).alias("begin")).distinct().collect():
        begins[r["doc_id"]].append(r["begin"])
    out = {}
    for i, found in begins.items():
        found.sort()
        pieces = math.ceil(counts[i] * ranges / total)
        out[i] = sorted({found[k * len(found) // pieces] for k in range(1, pieces)}) if found else []
    return out


def in_ranges(docs: DataFrame, ranges: int) -> tuple[DataFrame, list[Column]]:
    """Rows dealt to ranges of ids for a window over `part`, and the order in it. Every range ends with a copy (halo) of the rows that follow it.

    The bounds are one id a range; they reach the driver from a scan of ids alone. An id (or null) of very many rows is ranges of its own, by the
    beginnings of its texts; rows alike in both stay together. Texts are shuffled once, by the window."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = plain.select("doc_id")
    hot = _hot_ids(plain, ranges)
    cuts = set(ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []) if ranges > 1 else set()
    cuts |= {x for i in hot if i is not None for x in (i - 1, i) if x >= -(2**63)}
    begin, sub = F.lit(""), F.lit(0)
    for i, own in hot.items():
        here = F.col("doc_id").eqNullSafe(F.lit(i).cast("long"))
        begin = F.when(here, F.substring("text", 1, BEGIN_CHARS)).otherwise(begin)
        sub = F.when(here, _cuts_below(F.substring("text", 1, BEGIN_CHARS), own, "string")).otherwise(sub)
    home = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + _cuts_below(F.col("doc_id"), sorted(cuts)))
    home = home * (1 + max(map(len, hot.values()), default=0)) + sub
    placed = (plain if hot else ids).select("doc_id", begin.alias("begin"), home.alias("home"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "begin")).alias("first")
    found = sorted(placed.groupBy("home").agg(first).collect(), key=lambda r: r["home"])
    heads = [(r["first"]["doc_id"], r["first"]["begin"], found[k - 1]["home"]) for k, r in enumerate(found)]
    head_rows = F.broadcast(spark.createDataFrame(heads, "head_id long, head_begin string, before int"))  # one row a range
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (begin == F.col("head_begin"))
    joined = plain.withColumn("home", home).join(head_rows, same, "left")
    parts = F.when(F.col("before").isNull(), F.array("home")).otherwise(F.array("home", "before"))
    dealt = joined.select("doc_id", "text", F.posexplode(parts).alias("halo", "part"))
    return dealt, [F.col("halo"), F.col("doc_id").asc_nulls_first(), F.col("text")]


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """For every document its fingerprint, that of its text with the last quarter replaced by the next document's beginning, and likenesses."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, order = in_ranges(docs, ranges)
    following = W.partitionBy("part").orderBy(*order)
    df = dealt.withColumn("next_text", F.lead("text").over(following))
    n, replaced = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    df = df.withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - replaced), F.substring("next_text", F.lit(1), replaced)))
    df = with_fingerprint(df, "text", "fingerprint")
    df = df.withColumn("next", F.lead(F.struct("fingerprint", "fingerprint_nodes")).over(following)).where("halo = 0").drop("fingerprint_runs")
    df = df.select("*", F.col("next.fingerprint").alias("next_fingerprint"), F.col("next.fingerprint_nodes").alias("next_fingerprint_nodes"))
    df = with_fingerprint(df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_fingerprint")
    near = [likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next")]
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
