"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession  # noqa: E402

from orrery.catalog_queries import QUERIES  # noqa: E402
from orrery.database import Database  # noqa: E402

HEADLINE = "flagship point_lookup range_scan pushed_filter project_arith int_division join_inner join_left join_multiway join_residual_where agg_sum_int agg_avg_int group_multi group_null_key topk sort_multi stats_profile dml_update dml_delete".split()


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 4)


def write_rates(spark: SparkSession) -> dict[str, float]:
    """Batches of the published write and lookup figures: rows a second of bulk loads and of VALUES lists, seconds of one lookup."""
    out = {}
    with Database("file://" + tempfile.mkdtemp(prefix="bench-") + "/db", spark) as db:
        db.execute("CREATE TABLE bench (id INTEGER, value INTEGER)")
        values = ", ".join(f"({k}, {k})" for k in range(10_000))
        db.execute("INSERT INTO bench VALUES (0, 0)")
        out["insert_10k_values"] = timed(lambda: db.execute(f"INSERT INTO bench VALUES {values}"))
        out["load_1m_rows"] = timed(lambda: db.load("bench", spark.range(1_000_000).selectExpr("id", "id AS value")))
        db.compact("bench")
        db.execute("SELECT value FROM bench WHERE id = 5000")
        out["point_select_1m_rows"] = timed(lambda: db.execute("SELECT value FROM bench WHERE id = 777777"))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    QUERIES["flagship"](spark, sf_dir).collect()  # starts the engine
    for name in HEADLINE:
        seconds[name] = min(timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for _ in range(2))
    seconds |= write_rates(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
