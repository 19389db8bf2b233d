import hashlib
import random

from orrery.llm import warc_bundles as B
from orrery.llm.common import scratch_dir


def test_bundles_round_trip(prepared):
    draw = random.Random(1)
    big = ["".join(draw.choices("ab <p>é", k=1200)) for _ in range(3)]
    rows = [(k, f"http://x/{k}", big[k % 3]) for k in range(30)] + [(40, None, None), (41, "u\r\nv", ""), (42, "s", "small"), (43, "s", "small"), (None, "n", big[0]), (29, "again", big[2]), (50, "long", "z" * 700_000)]
    pages = prepared.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, record_type string").repartition(3)
    out = scratch_dir(prepared, "warc")
    B.write_bundles(B.mark_revisits(pages, 1000), out, frame_bytes=4000, bundle_bytes=3000)
    found = B.read_bundles(prepared, out).collect()
    last = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            last[data] = max(last.get(data, -1), page_id)
    wanted = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        refers = last.get(data) if last.get(data) != page_id else None
        kind = "response" if refers is None else "revisit"
        wanted.append((page_id, url and url.replace("\r", "%0D").replace("\n", "%0A"), kind, refers, len(data), hashlib.sha1(data).hexdigest(), data if kind == "response" else None))
    got = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    (one,) = B.fetch(prepared, out, B.record_uri(50))
    assert one["payload"] == b"z" * 700_000
    bundles = {r.bundle for r in prepared.read.parquet(f"{out}/index").collect()}
    assert len(bundles) >= 3 and all(B.BundleReader(b).frames for b in bundles)


def test_empty(prepared):
    pages = prepared.createDataFrame([], "page_id long, url string, html string")
    out = scratch_dir(prepared, "warc")
    B.write_bundles(B.mark_revisits(pages, 1000), out)
    assert B.read_bundles(prepared, out).collect() == []


def test_frames_use_all_tasks(prepared):
    """Few bytes of index stand for many of payload: frames are dealt out by their number."""
    pages = prepared.range(200).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id, repeat('x', 1500)) AS html")
    out = scratch_dir(prepared, "warc")
    index = B.write_bundles(B.mark_revisits(pages, 1000), out, frame_bytes=4000)
    frames = index.select("bundle", "frame").distinct().count()
    found = B.read_bundles(prepared, out, with_payload=False)
    tasks = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    due = min(frames, prepared.sparkContext.defaultParallelism)
    assert sum(tasks) == 200 and sum(n > 0 for n in tasks) >= 0.7 * due and max(tasks) <= 3 * 200 / due


def test_groups_beyond_a_broadcast(prepared, monkeypatch):
    """Other columns may bear the names of results; small payloads stay out of the join and are responses."""
    from orrery.llm import common

    rows = [(k, f"u{k}", "z" * (1500 if k % 3 else 20), "clash", "clash") for k in range(12)]
    pages = prepared.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string, refers_to string")
    small = sorted(map(str, B.mark_revisits(pages, 1000).drop("payload").collect()))
    monkeypatch.setattr(common, "BROADCAST_LIMIT_BYTES", 0)
    assert sorted(map(str, B.mark_revisits(pages, 1000).drop("payload").collect())) == small
    assert sum("refers_to=11" in r for r in small) == 7
