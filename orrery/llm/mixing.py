"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents each have the same expected number of copies, target / source size. Its whole part is certain; the fractional part is
rounded by pivotal steps: two documents with fractional probabilities exchange mass, measured in words, in a random direction until one
becomes 0 or 1, so each step keeps the source's expected words exactly and each document's expected copies. Blocks of a source are rounded
apart; each leaves at most one document still fractional, and these residuals are combined by a reduction tree with a fixed fan-in until one
document a source remains, which a draw decides. A source's taken words thus miss its target by less than that document's size; large
documents go first in each block, so it tends to be small.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at 3 times its source's size, and
the excess is shared again by weight.

Defined cases: null or blank texts have size 0 and take 0 words; a null source is a source; rows alike in id, text and source are separate
documents, rounded as one group (which of them is taken is arbitrary, the rows out are the same); null ids sort first in a block; an empty
table gives no rows. Randomness hashes the seed, the ids and the tree level, so reruns agree however rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import materialized, maybe_broadcast, parts_for

MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: known tells a null doc_id (kept as 0) apart: pandas would turn a column of longs with nulls into doubles.
_STATE = "source string, doc_id long, known boolean, rid long, size long, p double, level int, block long, n long"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, source, size): rid is a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked(sources: DataFrame, parts: int) -> DataFrame:
    """sources with place: the number (from 0) of each by code point, null last. Only counts of ranges are added up in one place."""
    last = F.col("source").isNull()
    ordered = sources.repartitionByRange(parts, last, "source").sortWithinPartitions(last, "source")
    ordered = materialized(ordered.withColumn("place", F.monotonically_increasing_id()), "ranked-sources")
    part = F.shiftright("place", 33)
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranges = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    joined = ordered.join(F.broadcast(ranges), part == F.col("part"))  # one row a range
    return joined.withColumn("place", F.col("before") + F.col("place") - F.shiftleft(F.col("part"), 33)).drop("part", "before")


def source_targets(sizes: DataFrame, parts: int = 1) -> DataFrame:
    """(source, source_size, n_docs, target) for entries (source, size, n rows alike), a written table: sources may be as many as hosts. Sources whose share of what is left by weight
    exceeds MAX_REPEATS times their size stop there, until none does; the driver gets two sums a round."""
    found = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    found = materialized(found, "sources", parts)
    found = materialized(ranked(found, parts).withColumn("weight", 1 + F.col("place") % 3), "weighed-sources", parts)
    most, price = MAX_REPEATS * F.col("source_size"), F.lit(0.0)  # words a unit of weight; a source is full where its cap is below its share
    total, full = found.agg(F.sum("source_size")).first()[0] or 0, -1
    while True:
        over = (F.col("source_size") == 0) | (most < price * F.col("weight"))
        r = found.agg(F.count_if(over).alias("full"), F.sum(F.when(over, most).otherwise(0)).alias("taken"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free")).first()
        if r["full"] == full or not r["free"]:
            break
        full, price = r["full"], F.lit((total - r["taken"]) / r["free"])
    target = F.least(most.cast("double"), price * F.col("weight"))
    return materialized(found.select("source", "source_size", "n_docs", target.alias("target")), "source-targets", parts)


def _draws(seed: int, level: int, key: str, n: int) -> np.ndarray:
    digest = hashlib.blake2b(f"{seed}/{level}/{key}".encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little")).random(n)


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray, last: float | None = None) -> np.ndarray:
    """Round p to 0 or 1 but for one entry at most; last, a draw, rounds that one too."""
    p = p.astype(float).copy()
    held = -1
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        a, b = held, k
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that can move from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if draws[k] * (up + down) < down:
            moved, full, empty = up, (1 - p[a]) * size[a] <= p[b] * size[b], p[b] * size[b] <= (1 - p[a]) * size[a]
            p[a], p[b] = (1.0 if full else p[a] + moved / size[a]), (0.0 if empty else p[b] - moved / size[b])
        else:
            moved, empty, full = down, p[a] * size[a] <= (1 - p[b]) * size[b], (1 - p[b]) * size[b] <= p[a] * size[a]
            p[a], p[b] = (0.0 if empty else p[a] - moved / size[a]), (1.0 if full else p[b] + moved / size[b])
        held = next((x for x in (a, b) if 0 < p[x] < 1), -1)
    if last is not None and held >= 0:
        p[held] = float(last < p[held])
    return p


def rounded(fractions: DataFrame, levels: int, fan_in: int, seed: int, parts: int | None = None) -> DataFrame:
    """(source, doc_id, rid, size, n, p): p of every row rounded to 0 or 1. fractions has _STATE's columns, blocks numbered from 0 in each source."""

    def combine(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["known", "doc_id", "size", "rid"], kind="stable").reset_index(drop=True)
            source = pdf["source"].iloc[0]
            key = f"{'' if source is None else 's' + source}/{pdf['block'].iloc[0]}"
            draws = _draws(seed, level, key, len(pdf) + 1)
            # Large documents first: what is left fractional at the end is then a small one.
            order = np.lexsort((_draws(seed, -1 - level, key, len(pdf)), -pdf["size"].to_numpy()))
            pdf = pdf.iloc[order].reset_index(drop=True)
            pdf["p"] = pivot(pdf["size"].to_numpy(), pdf["p"].to_numpy(), draws, draws[-1] if level == levels else None)
            pdf["level"] = level
            pdf["block"] //= fan_in
            return pdf

        return run

    pieces, current = [], fractions
    for level in range(levels + 1):
        current = materialized(current.groupBy("source", "block").applyInPandas(combine(level), _STATE), f"pivot-{level}", parts)
        pieces.append(current.where("p = 0 OR p = 1"))
        current = current.where("p > 0 AND p < 1")
    out = pieces[0]
    for part in pieces[1:]:
        out = out.union(part)
    return out.select("source", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "rid", "size", "n", "p")


#: A group of copies that makes more rows than this is dealt out in pieces of so many.
PIECE_ROWS = 4096


def repeated(df: DataFrame, times: str, number: str, many: bool) -> DataFrame:
    """Each row as often as its column times says, numbered from 0. Where rows have many copies (many), those are dealt out in pieces, so that
    no task makes them all."""
    plain = df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    if not many:
        return plain
    few, many_rows = plain.where(F.col(times) <= PIECE_ROWS), df.where(F.col(times) > PIECE_ROWS)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(PIECE_ROWS).cast("long"))).alias("_from")
    dealt = many_rows.select("*", piece).withColumn("_deal", F.xxhash64("_from", *(c for c in ("doc_id", "rid") if c in df.columns))).repartition("_deal").drop("_deal")
    last = F.least(F.col("_from") + PIECE_ROWS, F.col(times)) - 1
    dealt = dealt.withColumn(number, F.explode(F.sequence("_from", last))).drop("_from")
    return few.union(dealt)


def _any_many(df: DataFrame, times: str) -> bool:
    return not df.where(F.col(times) > PIECE_ROWS).limit(1).isEmpty()


def groups(docs: DataFrame, seed: int, block_rows: int, fan_in: int) -> DataFrame:
    """(doc_id, rid, source, size, n, source_size, target, base, extra): n rows alike in id, text and source, of which each is taken base times
    and extra of them once more.

    Rows alike are one entry: pivotal steps among them end with the whole part of n times the fraction taken, and one fractional row, which
    alone goes on. Shuffles carry ids and sizes only. A hot source is many blocks of about block_rows, by a hash of ids and texts."""
    sizes = materialized(sized(docs).groupBy("doc_id", "rid", "source", "size").agg(F.count("*").alias("n")), "sizes")
    count = sizes.count()
    parts = 4 * parts_for(count)
    targets = source_targets(sizes, parts_for(count))
    side = maybe_broadcast(targets, 80)
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEATS)))).otherwise(0.0)
    joined = sizes.withColumnRenamed("source", "own").join(side, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("rate", rate)
    due = F.col("n") * (F.col("rate") - F.floor("rate"))
    most = targets.agg(F.max("n_docs")).first()[0] or 1
    levels = math.ceil(math.log(max(1, math.ceil(most / block_rows)), fan_in) - 1e-9)
    blocks = F.greatest(F.ceil(F.col("n_docs") / block_rows).cast("long"), F.lit(1))
    block = F.pmod(F.xxhash64("doc_id", "rid", "size"), blocks).alias("block")
    open_ = due > F.floor(due)
    state = joined.where(open_).select("source", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "rid", "size", (due - F.floor(due)).alias("p"), F.lit(0).alias("level"), block, "n")
    drawn = rounded(state, levels, fan_in, seed, parts)
    whole = joined.where(~open_).select("source", "doc_id", "rid", "size", "n", F.lit(0.0).alias("p"))
    result = drawn.select(*whole.columns).union(whole).withColumnRenamed("source", "own").join(side, F.col("own").eqNullSafe(F.col("source"))).withColumn("rate", rate)
    return result.select("doc_id", "rid", "source", "size", "n", "source_size", "target", F.floor("rate").cast("long").alias("base"), (F.floor(due) + F.col("p")).cast("long").alias("extra"))


def mix(docs: DataFrame, seed: int = 7, block_rows: int = 2_000, fan_in: int = 64) -> DataFrame:
    """(doc_id, rid, source, size, source_size, target, copies, taken) a row of docs: taken is the words that the mix takes, repeats counted."""
    found = materialized(groups(docs, seed, block_rows, fan_in), "mix-groups")
    every = repeated(found, "n", "_number", _any_many(found, "n"))
    copies = F.col("base") + (F.col("_number") < F.col("extra")).cast("long")
    return every.select("doc_id", "rid", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7, block_rows: int = 2_000, fan_in: int = 64) -> DataFrame:
    """The mix itself: docs' rows, each as often as mix() takes it. Documents without words are left out. Of rows alike in id, text and source,
    one (any) stands for all, also in the other columns."""
    plan = groups(docs, seed, block_rows, fan_in).withColumn("_copies", F.col("n") * F.col("base") + F.col("extra")).where("_copies > 0")
    plan = materialized(plan.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "rid", "source")), "_copies", (F.col("n") > 1).alias("_alike")), "mix-copies")
    same = F.xxhash64("text").eqNullSafe(F.col("_rid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    found = docs.join(maybe_broadcast(plan, 64), same)
    if not plan.where("_alike").limit(1).isEmpty():
        found = found.where("NOT _alike").union(found.where("_alike").dropDuplicates(["_doc_id", "_rid", "_source"]))
    return repeated(found, "_copies", "_copy", _any_many(plan, "_copies")).select(*docs.columns)
