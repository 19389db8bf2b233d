"""A corpus pipeline over `documents`: language identification, near-duplicate removal, removal of repeated passages, mixing of sources, tokens.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, written and read again, and returns a DataFrame. All but the last
return the columns of documents (doc_id, text, lang, source, n_chars). A stage first deletes the scratch tables of stages before it.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import forced_bpe, language_id, mixing, near_copies, paragraphs
from orrery.llm.common import release_scratch, scratch_count, scratch_dir, ship_package
from orrery.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which a predicted language outweighs the one given.
SURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: text null, without a letter, or with a score below that of an even guess among the
    languages learned. lang becomes the prediction where it is missing or the score is SURE or more."""
    _begin(spark, first=True)
    model = language_id.fit(docs, train=F.lit(True))
    guess = 1 / max(1, sum(map(len, model.members.values())))
    found = language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= guess))
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles alike by 0.8 or more) stays, that of the smallest doc_id: SimHash at a similarity."""
    _begin(spark)
    return near_copies.keep_one(docs).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one are cut out; documents of which nothing but white space is left go."""
    _begin(spark)
    found = paragraphs.remove_repeats(docs).where((F.col("removed_words") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return found.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, or up to three times."""
    _begin(spark)
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids) of every document."""
    _begin(spark)
    found = forced_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), tokenizer_json("word_bpe_49k.json"))
    return found.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, fingerprint components and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


#: Of each thread, so that pipelines side by side leave each other's folders alone.
_stage = threading.local()


def _begin(spark: SparkSession, first: bool = False) -> None:
    """Delete what the stage before this one left in scratch folders; it has been written by now."""
    ship_package(spark)
    if not first:
        release_scratch(spark, getattr(_stage, "began_at", 0))
    _stage.began_at = scratch_count()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scratch_dir(spark, "pipeline", keep=True)
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
