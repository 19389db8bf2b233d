import numpy as np
from pyspark.sql import functions as F

from orrery.llm import toxicity as X
from orrery.llm.common import id_bucket

from .conftest import prose


def planted(spark, n=500):
    rows, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = prose(k, 60 + k % 40).split()
        if toxic:
            for place in range(3):
                words[(k * 7 + place * 13) % len(words)] = ["grumph", "snarlik", "vexhound", "grumphish"][(k + place) % 4]
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", "s"))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame([*labels, (9999, None), (9998, 7)], "doc_id long, toxic int")


def test_held_out(prepared):
    docs, labels = planted(prepared)
    model = X.fit(docs, labels, train_rows=id_bucket("doc_id", 4) != 2)
    found = X.score(docs, model).join(labels, "doc_id").where(id_bucket("doc_id", 4) == 2).collect()
    assert len(found) > 80
    right = [(r.predicted == 1) == (r.toxic == 1) for r in found]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in found)


def test_edges(prepared, edge_docs, empty_docs):
    docs, labels = planted(prepared, 200)
    model = X.fit(docs, labels, train_rows=F.lit(True))
    found = X.score(edge_docs, model).collect()
    assert len(found) == edge_docs.count() and all(0 <= r.score <= 1 for r in found)
    empties = {r.score for r in found if not (r.text or "").strip()}
    assert len(empties) == 1
    assert X.score(empty_docs, model).collect() == []
    assert X.fit(docs, labels.where("toxic = 1"), train_rows=F.lit(True)) is None
    assert {(r.score, r.predicted) for r in X.score(edge_docs, None).collect()} == {(0.0, 0)}


def test_long_texts_count_whole(prepared):
    docs, labels = planted(prepared, 200)
    model = X.fit(docs, labels, train_rows=F.lit(True))
    hashes = X.WordHashes()
    clean = prose(1, 40_000)
    a, b = model.scores([clean, clean + " grumph snarlik vexhound"], hashes)
    assert b > 0.3 > a or b > a + 0.2


def test_blocks_pool_alike():
    draw = np.random.default_rng(0)
    model = X._start([draw.integers(0, X.BUCKETS, (2, 50)).astype(np.int32)], np.array([1]), draw)
    ids = draw.integers(0, X.BUCKETS, (2, 40_000)).astype(np.int32)
    most, where = model.responses(ids)
    x = model.tables[0][ids[0]] + model.tables[1][ids[1]]
    for k, w in enumerate(X.WIDTHS):
        windows = np.hstack([x[j : len(x) - w + 1 + j] for j in range(w)]) @ model.filters[k]
        assert np.allclose(windows.max(axis=0), most[k * X.FILTERS : (k + 1) * X.FILTERS], atol=1e-4)
    assert (where < 40_000).all()


def test_long_labelled_rows_are_learned(prepared):
    """Labelled rows of over 4,096 words alone: held-out accuracy is that of short ones. A bound on words takes whole rows of any length."""
    docs, labels = planted(prepared, 160)
    longer = docs.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.lit(prose(5, 300) + " "), 15)))
    assert longer.select(F.min(F.size(F.split("text", r"\s+"))).alias("n")).first().n > 4096
    model = X.fit(longer, labels, train_rows=id_bucket("doc_id", 4) != 2)
    found = X.score(longer, model).join(labels, "doc_id").where(id_bucket("doc_id", 4) == 2).collect()
    assert np.mean([(r.predicted == 1) == (r.toxic == 1) for r in found]) > 0.9 and len({r.predicted for r in found}) == 2
    assert X.fit(longer, labels, train_rows=F.lit(True), words_per_class=1) is not None
