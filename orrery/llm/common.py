"""Shared plumbing: scratch folders all executors can see, file access by URI, size-checked broadcasts, language-neutral splits."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay under this many bytes in total.
BROADCAST_LIMIT_BYTES = 24 * 2**20

T = TypeVar("T")

#: Folders handed out: all of them, to delete at exit, and those of each thread, so that jobs side by side release their own only.
_every: list[tuple[SparkSession, str]] = []
_own = threading.local()


#: Bytes of an Arrow batch between Spark and Python workers: texts differ by a factor of thousands, so a count of rows bounds nothing.
ARROW_BATCH_BYTES = 4 * 2**20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors: a zip of its sources, sent once a session through Spark. Also bounds the session's Arrow batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    if getattr(sc, "_orrery_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="orrery-code-")) / "orrery.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(target))
    sc._orrery_shipped = True


def scratch_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one is set first if the
    master is local; a cluster has no folder that could be chosen for it, so there it raises. Folders go at release_scratch() (unless keep) or at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="orrery-")
        if not found.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    out = f"{base.rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"
    _every.append((spark, out))
    if not keep:
        _thread_folders().append(out)
    return out


def _thread_folders() -> list[str]:
    if not hasattr(_own, "folders"):
        _own.folders = []
    return _own.folders


def scratch_count() -> int:
    return len(_thread_folders())


def release_scratch(spark: SparkSession, since: int) -> None:
    """Delete the scratch folders that this thread was handed out without keep since scratch_count() was this. DataFrames that read them must
    have been written."""
    folders = _thread_folders()
    while len(folders) > since:
        with contextlib.suppress(Exception):
            delete_tree(spark, folders.pop())


def delete_tree(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    for spark, path in _every:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                delete_tree(spark, path)


#: Written tables get a file for about so many of the rows they come from.
ROWS_A_FILE = 200_000


def parts_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_FILE))


def materialized(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write a result to a scratch folder and read it again: cuts lineage, survives lost executors, and is computed once. parts, made from a
    row count, keeps a small table from being spread over as many files as there are shuffle partitions."""
    out = scratch_dir(df.sparkSession, name)
    (df if parts is None else df.coalesce(parts)).write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def fits_broadcast(df: DataFrame, bytes_a_row: int | Column) -> bool:
    """Whether a materialized table's size, counted from its rows, is under the limit. Rows that hold arrays are priced by a column of their sizes."""
    size = df.agg(F.sum(bytes_a_row)).first()[0] or 0 if isinstance(bytes_a_row, Column) else df.count() * bytes_a_row
    return size <= BROADCAST_LIMIT_BYTES


def maybe_broadcast(df: DataFrame, bytes_a_row: int | Column) -> DataFrame:
    """Mark a materialized table for broadcast if it fits; otherwise leave the join to Spark (sort-merge, split where skewed)."""
    return F.broadcast(df) if fits_broadcast(df, bytes_a_row) else df


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed_file(uri: str):
    """A file that appears under its name only when complete, so a retried task replaces a lost attempt's file whole."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    staged = f"{path}.{uuid.uuid4().hex}.staged"
    try:
        with fs.open_output_stream(staged) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(staged)
        raise
    fs.move(staged, path)


def open_random(uri: str) -> pa.NativeFile:
    """Random access: memory-mapped on a local or mounted file system, ranged reads elsewhere."""
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


_worker_state: dict[str, object] = {}


def worker_state(name: str, make: Callable[[], T]) -> T:
    """A cache that a worker process keeps over its tasks. Only one lives at a time: that of another operator goes."""
    if name not in _worker_state:
        _worker_state.clear()
        _worker_state[name] = make()
    return _worker_state[name]


def rows(batches: Iterable[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that Python objects for only few texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    give_back()


def give_back() -> None:
    """Return memory that a task has freed to the system: workers live on and would keep their peak, beside the JVM's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
