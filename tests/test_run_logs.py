from orrery import analytics
from orrery.operators import relational as R
from orrery.sources import run_logs

LINES = [
    '{"seed":1,"schedule":"a","faults_injected":2,"crash_point":"p","outcome":"pass","invariants_failed":[],"ops":5,"redo_ops":1,"undo_ops":0,"recovery_ms":1.0}',
    '{"seed":2,"schedule":"b","outcome":"fail","invariants_failed":["y","x"],"ops":3,"recovery_ms":3.0}',
    "not json",
    '{"schedule":"no seed"}',
    '{"seed":3,"schedule":"a","faults_injected":1,"outcome":"error","invariants_failed":["x"]}',
]


def logs(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join(LINES[:3]))
    (tmp_path / "two.jsonl").write_text("\n".join(LINES[3:]))
    return run_logs.merge(spark, [f"{tmp_path}/one.jsonl", f"{tmp_path}/two.jsonl"])


def test_load_and_figures(spark, tmp_path):
    runs = logs(spark, tmp_path)
    assert [(r.seed, r.faults_injected, r.ops, r.crash_point, r.recovery_ms) for r in runs.orderBy("seed").collect()] == [(1, 2, 5, "p", 1.0), (2, 0, 3, "", 3.0), (3, 1, 0, "", None)]
    assert tuple(run_logs.outcome_counts(runs).first()) == (3, 1, 1, 1, 3, 1 / 3)
    assert tuple(round(x, 9) for x in run_logs.percentiles(runs).first()) == (2.0, 2.98, 3.0)
    assert sorted(map(tuple, run_logs.by_schedule(runs).collect())) == [("a", 1, 1), ("b", 0, 1)]
    assert [r.value for r in run_logs.first_seen(runs, "invariants_failed", "source_no", "seed").orderBy("first_place").collect()] in (["x", "y"], ["y", "x"])
    assert [r.value for r in run_logs.first_seen(runs, "schedule", "source_no", "seed").orderBy("first_place").collect()] == ["a", "b"]


def test_no_runs(spark):
    none = run_logs.merge(spark, [])
    assert tuple(run_logs.outcome_counts(none).first()) == (0, 0, 0, 0, 0, 0.0)
    assert tuple(run_logs.percentiles(none).first()) == (0.0, 0.0, 0.0)


def test_write_and_read_again(spark, tmp_path):
    runs = logs(spark, tmp_path).drop("source_no")
    run_logs.write(runs, f"{tmp_path}/out")
    assert sorted(map(str, run_logs.load(spark, f"{tmp_path}/out").collect())) == sorted(map(str, runs.collect()))
    run_logs.write(runs, f"{tmp_path}/plain", with_timing=False)
    assert run_logs.load(spark, f"{tmp_path}/plain").where("recovery_ms IS NOT NULL").count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(k, k % 2 if k else None) for k in range(10)], "id int, flag int")
    assert [tuple(r) for r in analytics.profile(df, ["id", "flag"]).collect()] == [("id", 10, 10, 0.0, "0", "9"), ("flag", 10, 2, 0.1, "0", "1")]


def test_scans(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "k int")
    assert [r.k for r in R.key_order(df, "k").collect()] == [1, 2, 3]
    assert [r.k for r in R.point_lookup(df, "k", 2).collect()] == [2]
    assert sorted(r.k for r in R.range_scan(df, "k", 2, None).collect()) == [2, 3]
