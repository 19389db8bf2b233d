"""Table contents as Parquet: batches of rows with a hidden identity, and batches of removed row versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.sources.manifest import Table

#: Identity of a row, which an update keeps; the batch that wrote this version of it; the version that a batch replaces.
RID, SEQUENCE, WAS = "_rid", "_seq", "_was"
ROWS_A_BATCH_FILE = 1_000_000
#: So many small batches of one level are merged into one of the next; a level is the last part of a batch's name.
MERGE_BATCHES = 16
#: Rows of both sides that a task of a join by identity sorts, about 80 bytes each.
ROWS_A_TASK = 1_500_000
#: So many removed versions (two longs each) are broadcast, whatever their files' size.
REMOVED_TO_BROADCAST = 500_000


def stored_schema(table: Table) -> T.StructType:
    hidden = [T.StructField(n, T.LongType()) for n in (RID, SEQUENCE, WAS)]
    return T.StructType(hidden + [T.StructField(f"c{k}", c.spark_type) for k, c in enumerate(table.columns)])


def dealt_out(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows by hash into as many tasks as n rows need, where Spark's own number may be smaller (it joins partitions down to one a core): what a task
    holds does not grow."""
    session = rows.sparkSession
    tasks, partitions = -(-n // ROWS_A_TASK), int(session.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, partitions), *by) if tasks > min(partitions, session.sparkContext.defaultParallelism) else rows


class Store:
    def __init__(self, spark: SparkSession, data_uri: str):
        self.spark, self.data_uri = spark, data_uri

    def new_name(self, table: Table, sequence: int) -> str:
        return f"{table.oid}-{sequence}-{uuid.uuid4().hex[:8]}"

    def read(self, table: Table) -> DataFrame:
        """Hidden columns and c0, c1, ... of every live row version. Removed versions go by an anti join, by broadcast while they are few, else in as
        many tasks as the versions need."""
        schema = stored_schema(table)
        if not table.files:
            return self.spark.createDataFrame([], schema).drop(WAS)
        # Pages carry checksums; a read that finds one wrong fails instead of returning damaged rows.
        reader = self.spark.read.option("parquet.page.verify-checksum.enabled", "true")
        rows = reader.schema(schema).parquet(*(f"{self.data_uri}/{f}" for f in table.files)).drop(WAS)
        if not table.removals:
            return rows
        removed = self.spark.read.schema(f"{RID} long, {WAS} long").parquet(*(f"{self.data_uri}/{f}" for f in table.removals))
        removed = removed.select(F.col(RID).alias("_gone"), WAS)
        if table.removed <= REMOVED_TO_BROADCAST:
            removed = F.broadcast(removed)
        else:
            n = table.rows + 2 * table.removed  # removed versions are among the rows read, too
            rows, removed = dealt_out(rows, n, RID, SEQUENCE), dealt_out(removed, n, "_gone", WAS)
        return rows.join(removed, (F.col(RID) == F.col("_gone")) & (F.col(SEQUENCE) == F.col(WAS)), "left_anti")

    def append(self, table: Table, rows: Sequence[Sequence[object]], first_rid: int, sequence: int) -> str:
        """Write literal rows as one batch."""
        name = f"{self.new_name(table, sequence)}-L0"
        schema = to_arrow_schema(stored_schema(table))
        columns = [range(first_rid, first_rid + len(rows)), [sequence] * len(rows), [None] * len(rows), *zip(*rows, strict=True)]
        data = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        parts = max(1, -(-len(rows) // ROWS_A_BATCH_FILE))
        self.spark.createDataFrame(data, stored_schema(table)).coalesce(parts).write.parquet(f"{self.data_uri}/{name}")
        return name

    @staticmethod
    def level(name: str) -> int | None:
        last = name.rpartition("-")[2]
        return int(last[1:]) if last.startswith("L") else None

    def merged(self, table: Table, names: Sequence[str], sequence: int, level: int) -> str:
        """The row versions of several batches of inserted rows as one, removed ones among them: removals name them by identity and batch."""
        name = f"{self.new_name(table, sequence)}-L{level}"
        found = self.spark.read.schema(stored_schema(table)).parquet(*(f"{self.data_uri}/{n}" for n in names))
        found.coalesce(1 if level < 3 else len(names)).write.parquet(f"{self.data_uri}/{name}")
        return name

    def append_frame(self, table: Table, rows: DataFrame, first_rid: int, sequence: int) -> tuple[str, int, int]:
        """Write a DataFrame's rows (columns by position) as one batch: (name, rids used, rows). Rids are distinct, not dense."""
        name = self.new_name(table, sequence)
        plain = rows.toDF(*(f"c{k}" for k in range(len(table.columns))))
        hidden = [(F.monotonically_increasing_id() + first_rid).alias(RID), F.lit(sequence).cast("long").alias(SEQUENCE), F.lit(None).cast("long").alias(WAS)]
        plain.select(*hidden, *(F.col(f"c{k}").cast(c.spark_type) for k, c in enumerate(table.columns))).write.parquet(f"{self.data_uri}/{name}")
        most, n = self.spark.read.schema(f"{RID} long").parquet(f"{self.data_uri}/{name}").agg(F.max(RID), F.count("*")).first()
        return name, 0 if most is None else most - first_rid + 1, n

    def rewrite(self, table: Table, matched: DataFrame, images: dict[int, Column], sequence: int) -> str:
        """New versions of the matched rows, right sides read from the old ones; the batch also names the versions it replaces."""
        name = self.new_name(table, sequence)
        values = [images.get(k, F.col(f"c{k}")).alias(f"c{k}") for k in range(len(table.columns))]
        matched.select(RID, F.lit(sequence).cast("long").alias(SEQUENCE), F.col(SEQUENCE).alias(WAS), *values).write.parquet(f"{self.data_uri}/{name}")
        return name

    def remove(self, table: Table, matched: DataFrame, sequence: int) -> str:
        name = self.new_name(table, sequence)
        matched.select(RID, F.col(SEQUENCE).alias(WAS)).write.parquet(f"{self.data_uri}/{name}")
        return name

    def compacted(self, table: Table, sequence: int, sort_by: int | None = None) -> str:
        """All live rows as one batch, sorted within files by a column so that row groups can be skipped by its statistics."""
        name = self.new_name(table, sequence)
        rows = self.read(table).select(RID, SEQUENCE, F.lit(None).cast("long").alias(WAS), *(f"c{k}" for k in range(len(table.columns))))
        if sort_by is not None:
            rows = rows.repartitionByRange(f"c{sort_by}").sortWithinPartitions(f"c{sort_by}")
        rows.write.parquet(f"{self.data_uri}/{name}")
        return name
