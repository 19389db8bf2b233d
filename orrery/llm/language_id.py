"""Hierarchical language identification: first the family, then one-versus-one linear SVMs among that family's languages.

Features are hashed byte pairs and triples of the letters of the whole lower-cased text (other ASCII characters separate words), square-rooted
and scaled to length one. The family is chosen by one-versus-rest linear SVMs; within it, each pair of languages has its own linear SVM, and
the pairwise margins vote. The models are fitted by dual coordinate descent on a bounded sample of labelled rows (SAMPLE_PER_LANGUAGE).

Defined cases: null text, or text without any letter, is `und` with score 0; a language without a known family is its own family; a single
learned language is always predicted; with no labelled row everything is `und`; rows repeated whole are predicted alike; a null id counts as
empty text in the split; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm.common import rows

#: At most so many labelled rows of each language are used for fitting, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 600
DIMENSIONS = 2**12
UNDETERMINED = "und"

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la lmo oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "ckb fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "ceb fil id jv mg mi ms su tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """A letter is a code point of the Unicode categories L*: numerals and numbers of other kinds (No, Nl) are none."""
    return any(c.isalpha() for c in text or "")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def features(text: str) -> np.ndarray:
    """The DIMENSIONS feature values of a whole text, of length one (or zero where nothing is left)."""
    letters = b" " + b" ".join(text.lower().encode("utf-8").translate(_KEEP).split()) + b" "
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(letters), 2**20):  # bounded memory for very long texts
        b = np.frombuffer(letters[at : at + 2**20 + 2], np.uint8).astype(np.uint32)
        pair = b[:-1] << 8 | b[1:]
        triple = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        for grams, salt in ((pair[: 2**20], 1), (triple, 2)):
            x = (grams + np.uint32(salt << 28)) * np.uint32(2654435769)
            counts += np.bincount(x >> np.uint32(32 - 12), minlength=DIMENSIONS)
    np.sqrt(counts, out=counts)
    norm = np.linalg.norm(counts)
    return (counts / norm if norm else counts).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of an L2-loss linear SVM for labels -1 and 1, classes weighed evenly, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = share / c  # 1 / (2C) with C inverse to the class's share
    square = (x.astype(float) ** 2).sum(axis=1) + slack
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                largest = max(largest, abs(new - alpha[i]) * square[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of feature rows. Margins become chances by a logistic curve; a language's chance within its family is the mean of its pairwise chances, normed."""
        if not self.families:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        chance = 1 / (1 + np.exp(-4 * np.clip(x @ self.family_weights.T, -20, 20))) if len(self.families) > 1 else np.ones((len(x), 1))
        chance /= chance.sum(axis=1, keepdims=True)
        best, score, lang = chance.argmax(axis=1), chance.max(axis=1), [""] * len(x)
        for f, name in enumerate(self.families):
            own, at = self.members[name], np.flatnonzero(best == f)
            if not len(at):
                continue
            votes = np.ones((len(at), len(own)))
            if len(own) > 1:
                votes[:] = 0
                for i, j in combinations(range(len(own)), 2):
                    p = 1 / (1 + np.exp(-4 * np.clip(x[at] @ self.pair_weights[own[i], own[j]], -20, 20)))
                    votes[:, i] += p
                    votes[:, j] += 1 - p
                votes *= 2 / (len(own) * (len(own) - 1))
            for k, v in zip(at, votes, strict=True):
                lang[k] = own[int(v.argmax())]
                score[k] *= v.max()
        return lang, score


def fit_vectors(x: np.ndarray, langs: list[str]) -> LanguageModel:
    model = LanguageModel()
    if not langs:
        return model
    names, families = np.array(langs), np.array([family_of(v) for v in langs])
    model.families = sorted(set(families))
    model.members = {f: sorted(set(names[families == f])) for f in model.families}
    if len(model.families) > 1:
        model.family_weights = np.array([linear_svm(x, np.where(families == f, 1, -1)) for f in model.families])
    for own in model.members.values():
        for a, b in combinations(own, 2):
            at = (names == a) | (names == b)
            model.pair_weights[a, b] = linear_svm(x[at], np.where(names[at] == a, 1, -1))
    return model


def fit(docs: DataFrame, train: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on the rows where train holds, lang is known and text has a letter. Executors make the features; the driver gets per_language
    sparse vectors a language, chosen by hash, from a scan that first counts rows by language."""
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(2**40))
    counted = docs.where(train & F.col("lang").isNotNull()).groupBy("lang").count().collect()
    limits = F.lit(None).cast("double")
    for r in counted:
        # Twice the share that is needed, as rows without letters count here; the surplus is cut on the driver.
        limits = F.when(F.col("lang") == r["lang"], float(min(1.0, (2 * per_language + 50) / r["count"]) * 2**40)).otherwise(limits)
    sample = usable.where(order < limits).select("lang", "text", order.alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            batch = batch.filter(pa.array([has_letter(t) for t in batch["text"].to_pylist()], pa.bool_()))
            found = [features(t) for t in batch["text"].to_pylist()]
            at = [np.flatnonzero(x).astype(np.int16) for x in found]
            yield pa.record_batch([batch["lang"], batch["place"], pa.array([a.tobytes() for a in at]), pa.array([x[a].tobytes() for x, a in zip(found, at, strict=True)])], names=["lang", "place", "at", "value"])

    got = sample.mapInArrow(run, "lang string, place long, at binary, value binary").collect()
    by_lang: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["place"], bytes(r["at"]))):
        if len(own := by_lang.setdefault(r["lang"], [])) < per_language:
            own.append(r)
    chosen = [r for own in by_lang.values() for r in own]
    x = np.zeros((len(chosen), DIMENSIONS), np.float32)
    for k, r in enumerate(chosen):
        x[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float32)
    return fit_vectors(x, [r["lang"] for r in chosen])


def predict_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    known = [has_letter(t) for t in texts]
    x = np.array([features(t) for t, k in zip(texts, known, strict=True) if k]).reshape(-1, DIMENSIONS)
    langs, scores = model.predict(x.astype(np.float32))
    out_lang, out_score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for k, lang, score in zip(np.flatnonzero(known), langs, scores, strict=True):
        out_lang[k], out_score[k] = lang, score
    return out_lang, out_score


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score appended, in one pass without a shuffle. (Columns of those names in docs are replaced.)"""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            lang, score = predict_texts(shared.value, batch["text"].to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")  # a copy: add() changes its object
    return kept.mapInArrow(run, schema)
