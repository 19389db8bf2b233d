import numpy as np
from pyspark.sql import functions as F

from orrery.llm import language_id as L
from orrery.llm.common import id_bucket

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(prepared):
    docs = prepared.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, train=id_bucket("doc_id", 3) != 1)
    assert set(model.families) == {"germanic", "romance"} and model.members["romance"] == ["es", "fr"]
    held = L.identify(docs.where(id_bucket("doc_id", 3) == 1), model).where("lang IS NOT NULL")
    right, total = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / total > 0.98
    scores = [r.score for r in held.select("score").collect()]
    assert min(scores) >= 0 and max(scores) <= 1
    # only the text counts
    blind = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    a = sorted((r.text, r.lang_pred, r.score) for r in L.identify(docs, model).select("text", "lang_pred", "score").collect())
    assert a == sorted((r.text, r.lang_pred, r.score) for r in L.identify(blind, model).select("text", "lang_pred", "score").collect())


def test_edges(edge_docs, empty_docs):
    model = L.fit(edge_docs, train=F.lit(True))
    found = L.identify(edge_docs, model).collect()
    assert len(found) == edge_docs.count()
    for r in found:
        no_letter = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == no_letter and (r.score == 0) == no_letter
    assert L.identify(empty_docs, model).collect() == []
    nothing = L.fit(empty_docs, train=F.lit(True))
    assert {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}


def test_single_language_and_unknown_family():
    x = np.eye(4, L.DIMENSIONS, dtype=np.float32)
    assert L.fit_vectors(x, ["qq"] * 4).predict(x)[0] == ["qq"] * 4
    assert L.fit_vectors(x, ["qq", "en", "qq", "en"]).predict(x)[0] == ["qq", "en", "qq", "en"]


def test_long_texts_count_whole():
    assert np.allclose(L.features("ab " * 800_000), L.features("ab " * 1000), atol=1e-2)
    text = "the quick brown fox " * 100_000
    whole = L.features(text)
    assert abs(float((whole**2).sum()) - 1) < 1e-4


def test_svm_separates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 10)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1, -1)
    w = L.linear_svm(x, y)
    assert ((np.hstack([x, np.ones((200, 1))]) @ w > 0) == (y > 0)).mean() > 0.97


def test_letters(prepared):
    """Numerals and other numbers are no letters, in fitting and predicting alike."""
    rows = [(1, "²³ 12"), (2, "½ ① Ⅷ"), (3, "42 _ !"), (4, "ª"), (5, "日"), (6, "a"), (7, ""), (8, None)]
    docs = prepared.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    model = L.fit(docs, train=F.lit(True))
    assert {r.doc_id: r.lang_pred for r in L.identify(docs, model).collect()} == {i: "en" if i in (4, 5, 6) else "und" for i, _ in rows}
    assert L.fit(docs.where("doc_id < 4"), train=F.lit(True)).families == []
