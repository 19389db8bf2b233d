"""Run logs: one JSON object a line for each simulated crash run. Loading, merging, writing, and the figures reported over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The record's fields, in the order they are written.
FIELDS = "seed long, schedule string, faults_injected int, crash_point string, outcome string, invariants_failed array<string>, ops long, redo_ops long, undo_ops long, recovery_ms double"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Typed records of one file or folder. Malformed lines and lines without a seed are skipped; absent fields get their defaults, but an absent recovery_ms stays null."""
    raw = spark.read.schema(FIELDS).option("mode", "DROPMALFORMED").json(path).where(F.col("seed").isNotNull())
    text = {c: F.coalesce(c, F.lit("")) for c in ("schedule", "crash_point", "outcome")}
    numbers = {c: F.coalesce(c, F.lit(0)).cast(t) for c, t in (("faults_injected", "int"), ("ops", "long"), ("redo_ops", "long"), ("undo_ops", "long"))}
    return raw.withColumns(text | numbers | {"invariants_failed": F.coalesce("invariants_failed", F.array().cast("array<string>"))})


def merge(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of several files with their order: (source_no, and the records)."""
    parts = [load(spark, p).withColumn("source_no", F.lit(k)) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FIELDS + ", source_no int")


def write(runs: DataFrame, path: str, with_timing: bool = True) -> None:
    """One line a run; without timing, equal seeds give equal lines."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    runs.select(*(n for n in names if with_timing or n != "recovery_ms")).write.json(path)


def outcome_counts(runs: DataFrame, outcome: str = "outcome", faults: str = "faults_injected") -> DataFrame:
    """One row: total, passed, failed, errored, total_faults, pass_rate (0 without runs)."""

    def count(value: str) -> Column:
        return F.count_if(F.col(outcome) == value)

    found = runs.agg(F.count("*").alias("total"), count("pass").alias("passed"), count("fail").alias("failed"), count("error").alias("errored"), F.coalesce(F.sum(faults), F.lit(0)).cast("long").alias("total_faults"))
    return found.withColumn("pass_rate", F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def percentiles(runs: DataFrame, column: str = "recovery_ms") -> DataFrame:
    """One row: p50, p99, most; linear between ranks, over rows that have a value, 0 without any."""
    parts = [F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.99)).alias("p99"), F.max(column).cast("double").alias("most")]
    return runs.agg(*parts).na.fill(0.0)


def by_schedule(runs: DataFrame, schedule: str = "schedule", outcome: str = "outcome") -> DataFrame:
    """(schedule, passed, failed): runs that passed, and all others."""
    passed = F.count_if(F.col(outcome) == "pass")
    return runs.groupBy(F.col(schedule).alias("schedule")).agg(passed.alias("passed"), (F.count("*") - passed).alias("failed"))


def fault_totals(runs: DataFrame, kind: str, faults: str) -> DataFrame:
    return runs.groupBy(F.col(kind).alias("kind")).agg(F.sum(faults).cast("long").alias("total"))


def first_seen(runs: DataFrame, value: str, *order: str) -> DataFrame:
    """(value, first_place): distinct values in the order of their first row; arrays count by their elements."""
    column = F.explode(value) if runs.schema[value].dataType.typeName() == "array" else F.col(value)
    placed = runs.select(F.struct(*order).alias("place"), column.alias("value"))
    first = placed.groupBy("value").agg(F.min("place").alias("place"))
    return first.select("value", F.row_number().over(W.orderBy("place")).alias("first_place"))
