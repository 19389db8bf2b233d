import hashlib
import re

from pyspark.sql import functions as F

from orrery.llm import merkle as M

PIECE = re.compile(r"[^.!?\n]{0,128}[.!?\n]+|[^.!?\n]{1,128}")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def fingerprint(text):
    nodes = [md5(p)[:16] for p in PIECE.findall(text)]
    runs = [""]
    for n in nodes:
        runs[-1] += n
        if n[-1] in "01":
            runs.append("")
    hashes = [md5(r) for r in runs if r]
    return f"{md5(''.join(hashes))}:{''.join(h[:16] for h in hashes)}:{''.join(nodes)}", set(nodes)


def like(a, b):
    (fa, na), (fb, nb) = fingerprint(a), fingerprint(b)
    return 1.0 if fa[:32] == fb[:32] else len(na & nb) / max(1, len(na | nb))


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text)[0], fingerprint(edited)[0], like(text, edited), like(text, after)))
    return out


def test_edges(edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for ranges in (1, 2, 7):
        got = [tuple(r) for r in M.fingerprint_edits(edge_docs, ranges).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert M.fingerprint_edits(empty_docs).collect() == []


def test_single_document_follows_itself(prepared):
    df = prepared.createDataFrame([(5, "one. two. three.")], "doc_id long, text string")
    (r,) = M.fingerprint_edits(df).collect()
    assert r.near_next == 1.0 and r.near_edited < 1.0


def test_differing_nodes_locate_the_edit(prepared):
    df = prepared.createDataFrame([("a one. b two. c three.", "a one. b TWO. c three.")], "x string, y string")
    df = M.with_fingerprint(M.with_fingerprint(df, "x", "p"), "y", "q")
    assert df.select(M.differing_nodes("p", "q").alias("d")).first().d == [1]


def test_an_insertion_changes_one_section(prepared):
    """Section ends depend on content: a piece inserted in front leaves all sections but one alike, and the descent finds it."""
    pieces = [f"piece number {k}." for k in range(400)]
    rows = [("".join([*pieces[:at], " a new piece.", *pieces[at:]]), "".join(pieces), at) for at in (0, 57, 211, 400)]
    df = M.with_fingerprint(M.with_fingerprint(prepared.createDataFrame(rows, "x string, y string, at int"), "x", "p"), "y", "q")
    for r in df.select("at", M.differing_nodes("p", "q").alias("d"), F.size(F.array_except("p_runs", "q_runs")).alias("sections"), F.size("p_runs").alias("all")).collect():
        assert r.d == [r.at] and r.sections <= 2 < r.all / 10


def test_native_plan(edge_docs):
    plan = M.fingerprint_edits(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_more_ranges_than_documents(prepared):
    df = prepared.range(5).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert sorted(map(str, (tuple(r) for r in M.fingerprint_edits(df, 50).collect()))) == sorted(map(str, brute([(k, f"text {k}") for k in range(5)])))


def test_range_search(prepared):
    for cuts in ([], [4], [1, 3, 5], list(range(0, 500, 7))):
        df = prepared.range(-3, 520).select(F.col("id"), M._cuts_below(F.col("id"), cuts).alias("n"))
        assert all(r.n == sum(c < r.id for c in cuts) for r in df.collect())


def test_a_hot_id_is_many_ranges(prepared):
    """A null id and another one hold most rows: they are dealt to ranges by their texts, and every row still finds its successor."""
    rows = [(None, f"text {k * 7919 % 300} of none. more") for k in range(300)] + [(7, f"{k * 31 % 200} of seven.") for k in range(200)] + [(k, f"own {k}.") for k in range(-30, 60)]
    df = prepared.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt, _ = M.in_ranges(df, 12)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert max(sizes) < 200 and len(sizes) > 8
    assert sorted(map(str, (tuple(r) for r in M.fingerprint_edits(df, 12).collect()))) == sorted(map(str, brute(rows)))
