"""Token ids as Arrow IPC files of equal-length sequences with masks.

Documents are laid end to end in ascending document id, an end id after each, and cut into sequences of fixed length. A file is an Arrow
IPC file whose record batches hold a fixed-size list of ids and a fixed-size list of mask values, a byte each (1: a real token, 0: padding at
the file's end). Masks are dictionary-encoded: a file has two at most, that of a full sequence and that of its last. All batches but a file's last have equally many sequences, so sequence k sits in batch k // batch_rows at row k % batch_rows,
and a memory-mapped reader gets it without copying. A Parquet index maps each document to its file, offset and length.

Defined cases: null text is empty (the end id alone); null ids sort first; rows of equal id sort by text, and those whose
texts also begin alike (RANGE_CHARS) share a file; an empty table gives no files and
an empty index; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import committed_file, open_random, rows
from orrery.llm.text_encoding import has_cut_safe_splitter, worker_encoder

#: Texts order rows of one id; so many code points of them tell ranges apart, so that a null or repeated id is not one file.
RANGE_CHARS = 32
INDEX_SCHEMA = "file_no int, doc_id long, offset long, n_tokens long"


def file_uri(out_dir: str, file_no: int) -> str:
    return f"{out_dir}/sequences-{file_no:06d}.arrow"


class _Packer:
    """Cuts a stream of ids into record batches of equal-length sequences."""

    def __init__(self, out: pa.NativeFile, dtype: np.dtype, seq_len: int, batch_rows: int):
        self.dtype, self.seq_len, self.batch_tokens = dtype, seq_len, seq_len * batch_rows
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema(
            [("input_ids", pa.list_(value, seq_len)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), seq_len)))],
            metadata={"seq_len": str(seq_len), "batch_rows": str(batch_rows)},
        )
        self.writer = pa.ipc.new_file(out, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.held: list[bytes] = []
        self.held_tokens = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_tokens += len(ids) // self.dtype.itemsize
        if self.held_tokens >= self.batch_tokens:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            full = len(flat) // self.batch_tokens * self.batch_tokens
            for at in range(0, full, self.batch_tokens):
                self._write(flat[at : at + self.batch_tokens], self.batch_tokens)
            self.held, self.held_tokens = [flat[full:].tobytes()], len(flat) - full

    def _write(self, flat: np.ndarray, real: int) -> None:
        """Whole sequences of which all but the last hold real tokens alone."""
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len)
        kinds, which = [np.ones(self.seq_len, np.uint8)], np.zeros(len(ids), np.int8)
        if real < len(flat):
            kinds.append((np.arange(self.seq_len) < real - len(flat) + self.seq_len).astype(np.uint8))
            which[-1] = 1
        masks = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(kinds)), self.seq_len)
        self.writer.write_batch(pa.record_batch([ids, pa.DictionaryArray.from_arrays(pa.array(which), masks)], schema=self.schema))

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


def write_sequences(docs: DataFrame, out_dir: str, tokenizer_json: str, end_id: int, seq_len: int = 1024, batch_rows: int = 256) -> DataFrame:
    """Write one file a range of ids, and the index under out_dir/index. Returns the index, read back.

    One range shuffle of (doc_id, text); ids are made after it, so they are never shuffled. A task holds one batch of tokens and a few texts.
    """
    if not has_cut_safe_splitter(tokenizer_json):
        raise ValueError("the tokenizer's splitter must be the plain byte-level one")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches := iter(rows(batches)), None)
        if first is None:
            return
        encoder = worker_encoder(shared.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        file_no, offset, index = TaskContext.get().partitionId(), 0, []
        with committed_file(file_uri(out_dir, file_no)) as out:
            packer = _Packer(out, encoder.dtype, seq_len, batch_rows)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                lengths = []
                for ids in encoder.encode(batch["text"].to_pylist()):
                    packer.add(ids)
                    packer.add(end)
                    lengths.append(len(ids) // encoder.dtype.itemsize + 1)
                n = np.array(lengths, np.int64)
                starts = offset + np.cumsum(n) - n
                offset += int(n.sum())
                index.append(pa.record_batch([pa.array(np.full(len(n), file_no, np.int32)), batch["doc_id"], pa.array(starts), pa.array(n)], names=["file_no", "doc_id", "offset", "n_tokens"]))
                batch = next(batches, None)
            packer.close()
        yield from index

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = text.repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{out_dir}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")


class SequenceFile:
    """Random access to one file's sequences; arrays are views of the mapped file."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(open_random(uri))
        meta = self.reader.schema.metadata
        self.seq_len, self.batch_rows = int(meta[b"seq_len"]), int(meta[b"batch_rows"])

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.batch_rows + self.reader.get_batch(n - 1).num_rows if n else 0

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k, both without a copy."""
        ids, mask = self.reader.get_batch(k // self.batch_rows).slice(k % self.batch_rows, 1).columns
        kind = mask.dictionary.slice(mask.indices[0].as_py(), 1)
        return ids.flatten().to_numpy(zero_copy_only=True), kind.flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """A run of ids by its place in the file, across sequences."""
        size, parts = self.seq_len * self.batch_rows, []
        while count > 0:
            flat = self.reader.get_batch(start // size)["input_ids"].flatten().to_numpy()
            parts.append(flat[start % size : start % size + count])
            start, count = start + len(parts[-1]), count - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def document_digests(spark: SparkSession, out_dir: str) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) a document. start counts the ids of all files and documents before it; the
    running sum over files sees one row a file."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, SequenceFile] = {}
        for batch in rows(batches, 4096):
            crcs = []
            for file_no, offset, n in zip(*(batch[c].to_pylist() for c in ("file_no", "offset", "n_tokens")), strict=True):
                if file_no not in opened:
                    opened = {file_no: SequenceFile(file_uri(out_dir, file_no))}
                crcs.append(zlib.crc32(opened[file_no].tokens(offset, n).astype("<u4").tobytes()))
            yield pa.record_batch([*(batch[c] for c in ("file_no", "doc_id", "offset", "n_tokens")), pa.array(crcs, pa.int64())], names=["file_no", "doc_id", "offset", "n_tokens", "ids_crc32"])

    # As many tasks as files: the index is a few bytes a document, so sizes of its partitions would say nothing of the work.
    ordered = index.repartitionByRange(max(1, totals.count()), "file_no").sortWithinPartitions("file_no", "offset")
    found = ordered.mapInArrow(digest, INDEX_SCHEMA + ", ids_crc32 long").join(bases, "file_no")
    return found.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
