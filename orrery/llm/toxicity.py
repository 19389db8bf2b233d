"""Toxicity by a convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling, thresholds by language.

A word is the sum of rows of two hashed tables, one by the whole word and one by its first letters, so that inflected forms share one part and
one collision alone does not make a word look like another. Filters of WIDTHS words slide
over the whole text; each filter's largest response goes to a logistic layer. The embeddings' first channel starts from the smoothed
log-odds of each bucket, the rest small and random; all weights are then trained by Adam on a bounded sample of labelled rows
(SAMPLE_PER_CLASS, SAMPLE_WORDS_PER_CLASS). The threshold is calibrated for each predicted language on sampled rows kept from training; scores are shifted on the
logistic scale so that each language's threshold lies at CUT. The language comes from the text alone (language_id), never from columns.

Defined cases: null, empty or wordless text scores as all-zero features do; a null or unknown label is no label; a null id counts as empty
text in the split; without labels of both classes every score is 0; rows repeated whole score alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import language_id
from orrery.llm.common import materialized, maybe_broadcast, rows, worker_state

#: At most so many labelled rows of each class are used for fitting and calibration, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 2000
#: Of those, in the same order, rows are taken, whole and of any length, until they have so many words (8 bytes each on the driver).
SAMPLE_WORDS_PER_CLASS = 4_000_000
#: Of those, at most so many a language fit the language model.
SAMPLE_PER_LANGUAGE = 200
BUCKETS = 2**18
CHANNELS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 4
CUT = 0.3

_EDGE = ".,;:!?\"'()[]{}|*#%&$<>-"


class WordHashes(dict):
    """word -> both bucket numbers, packed; bounded."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE).lower()
        found = (zlib.crc32(core.encode("utf-8")) % BUCKETS) << 32 | zlib.crc32(core[:STEM].encode("utf-8"), 0x5EED) % BUCKETS if core else -1
        if len(self) < self.limit:
            self[word] = found
        return found


def word_ids(text: str | None, hashes: WordHashes) -> np.ndarray:
    """(2, n) bucket numbers of a whole text's words; words of marks alone are left out."""
    words = (text or "").split()
    packed = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    packed = packed[packed >= 0]
    return np.stack([packed >> 32, packed & 0xFFFFFFFF]).astype(np.int32)


@dataclass
class ToxicityModel:
    tables: np.ndarray  # 2, BUCKETS, CHANNELS
    filters: list[np.ndarray]  # a width: width * CHANNELS, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: dict[str, float]
    languages: language_id.LanguageModel

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter responses and the places of the maxima; blocks bound the memory for long texts."""
        most = np.full(len(self.bias), -np.inf, np.float32)
        where = np.full(len(self.bias), -1)
        n, longest, block = ids.shape[1], max(WIDTHS), 16384
        for at in range(0, n, block):
            own = ids[:, at : at + block + longest - 1]
            x = self.tables[0][own[0]] + self.tables[1][own[1]]
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                if len(x) < w:
                    continue
                y = x[: len(x) - w + 1] @ f[:CHANNELS]
                for j in range(1, w):
                    y += x[j : len(x) - w + 1 + j] @ f[j * CHANNELS : (j + 1) * CHANNELS]
                best = y.argmax(axis=0)
                value, part = y[best, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > most[part]
                most[part] = np.where(better, value, most[part])
                where[part] = np.where(better, best + at, where[part])
        return np.where(np.isfinite(most), most, 0.0), where

    def logit(self, ids: np.ndarray) -> float:
        pooled = np.maximum(self.responses(ids)[0] + self.bias, 0)
        return float(pooled @ self.out + self.out_bias)

    def scores(self, texts: list[str | None], hashes: WordHashes) -> np.ndarray:
        logits = np.array([self.logit(word_ids(t, hashes)) for t in texts])
        langs, _ = language_id.predict_texts(self.languages, texts)
        moved = logits + np.array([self.shift.get(lang, self.shift[""]) for lang in langs])
        return 1 / (1 + np.exp(-np.clip(moved, -40, 40)))


def _start(docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    tables = rng.normal(0, 0.02, (2, BUCKETS, CHANNELS)).astype(np.float32)
    positives, negatives = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    for t in range(2):
        counts = np.zeros((2, BUCKETS))
        for ids, y in zip(docs, labels, strict=True):
            counts[int(y), np.unique(ids[t])] += 1
        odds = np.log((counts[1] + 0.5) / positives) - np.log((counts[0] + 0.5) / negatives)
        seen = counts.sum(axis=0)
        tables[t, :, 0] = np.clip(odds, -3, 3) * seen / (seen + 8)
        tables[t, seen == 0, 0] = 0
    filters = [rng.normal(0, 0.1, (w * CHANNELS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters, strict=True):
        f[::CHANNELS] += 1 / w
    size = len(WIDTHS) * FILTERS
    return ToxicityModel(tables, filters, np.full(size, -0.5, np.float32), np.full(size, 0.2, np.float32), -3.0, {"": 0.0}, language_id.LanguageModel())


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.step = rate, {}, 0

    def move(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient**2 - v)
        value -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 9) -> ToxicityModel:
    """Log-loss, classes weighed evenly; gradients reach the filters and embeddings at the pooled places only."""
    rng = np.random.default_rng(seed)
    model, adam = _start(docs, labels, rng), _Adam(0.01)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            g_filters, g_bias, g_out, g_out_bias = [np.zeros_like(f) for f in model.filters], np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            moved: list[tuple[np.ndarray, np.ndarray]] = []
            picked = order[at : at + batch]
            for d in picked:
                ids = docs[d]
                most, where = model.responses(ids)
                pooled = np.maximum(most + model.bias, 0)
                error = (1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -40, 40))) - labels[d]) * weight[d] / len(picked)
                g_out += error * pooled
                g_out_bias += error
                back = error * model.out * (pooled > 0) * (where >= 0)
                g_bias += back
                for k, w in enumerate(WIDTHS):
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    live = np.flatnonzero(back[part])
                    if not len(live):
                        continue
                    places = where[part][live, None] + np.arange(w)  # live, w
                    x = (model.tables[0][ids[0][places]] + model.tables[1][ids[1][places]]).reshape(len(live), -1)
                    g_filters[k][:, live] += x.T * back[part][live]
                    gx = (model.filters[k][:, live].T * back[part][live, None]).reshape(-1, CHANNELS)
                    moved.append((ids[:, places.ravel()], gx))
            adam.step += 1
            for k, g in enumerate(g_filters):
                adam.move(f"f{k}", model.filters[k], g)
            adam.move("bias", model.bias, g_bias)
            adam.move("out", model.out, g_out)
            model.out_bias -= 0.05 * g_out_bias
            for ids, gx in moved:  # embeddings: plain steps, as few rows are touched
                for t in range(2):
                    np.add.at(model.tables[t], ids[t], (-0.2 * gx).astype(np.float32))
    return model


def calibrate(logits: np.ndarray, labels: np.ndarray, langs: list[str], weights: np.ndarray) -> dict[str, float]:
    """Shifts that put each language's best threshold (by weighted F1 over all splits between logits) at CUT; "" serves languages with few rows."""
    at_cut = np.log(CUT / (1 - CUT))

    def best(own: np.ndarray) -> float:
        order = np.argsort(-logits[own])
        x, y, w = logits[own][order], labels[own][order], weights[own][order]
        hit, said = np.cumsum(y * w), np.cumsum(w)
        f1 = 2 * hit / (said + (y * w).sum())
        k = int(np.flatnonzero(f1 >= f1.max() - 1e-9)[-1])
        below = x[k + 1] if k + 1 < len(x) else x[k] - 2
        return at_cut - (x[k] + max(below, x[k] - 4)) / 2

    named = np.array(langs)
    found = {"": best(np.arange(len(labels))) if labels.any() else 0.0}
    for lang in set(langs):
        own = np.flatnonzero(named == lang)
        if labels[own].sum() >= 20 and (1 - labels[own]).sum() >= 20:
            found[lang] = best(own)
    return found


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = SAMPLE_PER_CLASS, words_per_class: int = SAMPLE_WORDS_PER_CLASS) -> ToxicityModel | None:
    """Fit on rows of docs joined with labels (doc_id, toxic) where train_rows holds. Executors turn whole texts into word buckets; the driver
    gets those of the sample (per_class, words_per_class), chosen by hash, and none of the texts. Documents of one id count as one, that of
    the least text hash."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(2**40))
    known = known.where(train_rows).select("doc_id", F.col("toxic").cast("int").alias("toxic"), place.alias("place"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    limit = F.lit(0.0)
    for y, n in counts.items():
        limit = F.when(F.col("toxic") == y, float(min(1.0, (1.2 * per_class + 50) / n) * 2**40)).otherwise(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("word hashes", WordHashes)
        for batch in rows(batches, 64):
            texts = batch["text"].to_pylist()
            ids, vectors = [word_ids(t, hashes) for t in texts], [language_id.features(t or "") for t in texts]
            at = [np.flatnonzero(x).astype(np.int16) for x in vectors]
            columns = [pa.array([x.shape[1] for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), batch["lang"], pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for x, a in zip(vectors, at, strict=True)], pa.binary())]
            yield pa.record_batch([batch["toxic"], batch["place"], *columns], names=["toxic", "place", "words", "ids", "lang", "at", "value"])

    chosen_ids = materialized(known.where(F.col("place") < limit), "toxicity-sample")
    joined = docs.select("doc_id", "text", "lang").join(maybe_broadcast(chosen_ids, 24), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("rid"), "text", "lang", "toxic", "place")).alias("one")).select("one.*")
    sample = materialized(one.select("text", "lang", "toxic", "place").mapInArrow(run, "toxic int, place long, words long, ids binary, lang string, at binary, value binary"), "toxicity-vectors")
    sizes = sorted(tuple(r) for r in sample.select("toxic", "place", "words").collect())
    last = {}
    for y in (0, 1):
        own = [(place, words) for toxic, place, words in sizes if toxic == y][:per_class]
        if not own:
            return None
        before = np.cumsum([0, *(words for _, words in own)])[:-1]
        last[y] = max(place for (place, _), words in zip(own, before.tolist(), strict=True) if words < words_per_class)
    got = sample.where((F.col("toxic") == 0) & (F.col("place") <= last[0]) | (F.col("toxic") == 1) & (F.col("place") <= last[1])).collect()
    return fit_rows(sorted(got, key=lambda r: (r["toxic"], r["place"], bytes(r["ids"]))), counts)


def fit_rows(chosen: list, counts: dict[int, int]) -> ToxicityModel:
    ids = [np.frombuffer(r["ids"], np.int32).reshape(2, -1) for r in chosen]
    y = np.array([r["toxic"] for r in chosen])

    def vectors(picked: list) -> np.ndarray:
        x = np.zeros((len(picked), language_id.DIMENSIONS), np.float32)
        for k, r in enumerate(picked):
            x[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float32)
        return x

    by_lang: dict[str, list] = {}
    for r in chosen:
        if r["lang"] is not None and len(r["at"]) and len(own := by_lang.setdefault(r["lang"], [])) < SAMPLE_PER_LANGUAGE:
            own.append(r)
    few = [r for own in by_lang.values() for r in own]
    languages = language_id.fit_vectors(vectors(few), [r["lang"] for r in few])
    held = np.arange(len(chosen)) % 4 == 3
    model = train([d for d, h in zip(ids, held, strict=True) if not h], y[~held])
    model.languages = languages
    logits = np.array([model.logit(d) for d, h in zip(ids, held, strict=True) if h])
    kept = [r for r, h in zip(chosen, held, strict=True) if h]
    langs = [lang for at in range(0, len(kept), 256) for lang in languages.predict(vectors(kept[at : at + 256]))[0]]
    weights = np.where(y[held] == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    model.shift = calibrate(logits, y[held], langs, weights)
    return model


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs with score and predicted appended (columns of those names are replaced); one pass, no shuffle."""
    kept = docs.drop("score", "predicted")
    if model is None:
        return kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("word hashes", WordHashes)
        for batch in rows(batches, 256):
            if len(hashes) >= hashes.limit:
                hashes.clear()
            found = shared.value.scores(batch["text"].to_pylist(), hashes)
            yield pa.record_batch([*batch.columns, pa.array(found), pa.array((found >= CUT).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "score double, predicted int"])
    return kept.mapInArrow(run, fields)
