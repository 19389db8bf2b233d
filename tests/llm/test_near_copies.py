import corpus_pipeline as C
from orrery.llm import near_copies as N
from orrery.llm import simhash as S

from .conftest import prose


def jaccard(a, b):
    found = []
    for t in (a, b):
        words = t.lower().split()
        found.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    return len(found[0] & found[1]) / len(found[0] | found[1])


def test_stage_drops_near_copies_beyond_three_bits(prepared):
    """Copies at similarity 0.8 differ in more fingerprint bits than op8's three; all of them go, pairs under 0.8 stay."""
    rows = []
    for k in range(12):
        words = prose(700 + k, 200).split()
        near, other = list(words), list(words)
        for n in range(3):
            near[20 + 60 * n] = f"near{n}"
        for n in range(6):
            other[10 + 30 * n] = f"other{n}"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(other))]
        assert jaccard(rows[-3][1], rows[-2][1]) >= 0.8 > max(jaccard(rows[-3][1], rows[-1][1]), jaccard(rows[-2][1], rows[-1][1]))
    far = [bin(S.fingerprint(rows[k][1]) ^ S.fingerprint(rows[k + 1][1])).count("1") > 3 for k in range(0, 36, 3)]
    assert sum(far) > 6
    df = prepared.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in C.drop_near_duplicates(prepared, df, "").collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


def test_edges(edge_docs, empty_docs):
    kept = [(r.doc_id, r.text) for r in N.keep_one(edge_docs).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 2, 5, 5, 8, 9, 10, 11, 12]
    assert [t for i, t in kept if i is None] == [prose(4, 30)] and (2, None) in kept
    assert N.keep_one(empty_docs).collect() == []
