"""The registered queries of this subpackage. Each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import forced_bpe, language_id, merkle, mixing, nearest, paragraphs, sequence_files, simhash, toxicity, warc_bundles
from orrery.llm.common import id_bucket, scratch_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = shipped
    return shipped


def tokenizer_json(name: str) -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "token-files")
    sequence_files.write_sequences(table(spark, sf_dir, "documents"), out, tokenizer_json("byte_bpe_50k.json"), end_id=2)
    return sequence_files.document_digests(spark, out)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "warc")
    warc_bundles.write_bundles(warc_bundles.mark_revisits(table(spark, sf_dir, "pages"), min_revisit_bytes=1000), out)
    return warc_bundles.read_bundles(spark, out, with_payload=False).drop("url")


ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY payload_digest) END AS response_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response_id IS NOT NULL AND page_id IS DISTINCT FROM response_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
FROM q
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("rid")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, train=id_bucket("doc_id", 3) != 1)
    held_out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    return language_id.identify(held_out, model).drop("text")


@query
def op5_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return forced_bpe.round_trip_digests(docs, tokenizer_json("word_bpe_49k.json")).drop("text")


@query
def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


ORACLE_SQL["op6_merkle"] = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars,
             COALESCE(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
      FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) AS edited FROM n),
p AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
             list_transform(regexp_extract_all(text, '{merkle.PIECE}'), lambda x: left(md5(x), {merkle.NODE_DIGITS})) AS a,
             list_transform(regexp_extract_all(edited, '{merkle.PIECE}'), lambda x: left(md5(x), {merkle.NODE_DIGITS})) AS b,
             list_transform(regexp_extract_all(next_text, '{merkle.PIECE}'), lambda x: left(md5(x), {merkle.NODE_DIGITS})) AS c FROM e),
r AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(COALESCE(array_to_string(a, ','), ''), '([{merkle.SECTION_ENDS}])(,|$)', '\1;', 'g'), ';'), lambda x: x <> ''), lambda x: md5(replace(x, ',', ''))) AS ha,
                list_transform(list_filter(string_split(regexp_replace(COALESCE(array_to_string(b, ','), ''), '([{merkle.SECTION_ENDS}])(,|$)', '\1;', 'g'), ';'), lambda x: x <> ''), lambda x: md5(replace(x, ',', ''))) AS hb,
                list_transform(list_filter(string_split(regexp_replace(COALESCE(array_to_string(c, ','), ''), '([{merkle.SECTION_ENDS}])(,|$)', '\1;', 'g'), ';'), lambda x: x <> ''), lambda x: md5(replace(x, ',', ''))) AS hc FROM p),
s AS (SELECT *, md5(COALESCE(array_to_string(ha, ''), '')) AS ra, md5(COALESCE(array_to_string(hb, ''), '')) AS rb, md5(COALESCE(array_to_string(hc, ''), '')) AS rc FROM r)
SELECT doc_id, n_chars, edited_sha256,
       ra || ':' || COALESCE(array_to_string(list_transform(ha, lambda x: left(x, {merkle.NODE_DIGITS})), ''), '') || ':' || COALESCE(array_to_string(a, ''), '') AS fingerprint,
       rb || ':' || COALESCE(array_to_string(list_transform(hb, lambda x: left(x, {merkle.NODE_DIGITS})), ''), '') || ':' || COALESCE(array_to_string(b, ''), '') AS edited_fingerprint,
       CASE WHEN ra = rb THEN 1.0 ELSE len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) END AS near_edited,
       CASE WHEN ra = rc THEN 1.0 ELSE len(list_intersect(a, c)) / greatest(len(list_distinct(list_concat(a, c))), 1) END AS near_next
FROM s
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows=id_bucket("doc_id", 4) != 2)
    held_out = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return toxicity.score(held_out, model).drop("text")


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return paragraphs.remove_repeats(docs)
