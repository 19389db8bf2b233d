from __future__ import annotations

import random
from pathlib import Path

import public_tokenizers
import pytest

from orrery.llm.common import ship_package

WORDS = "the of and under river stone bright window carry yellow mountain question paper garden silver winter morning letter bridge market".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    out = []
    for k in range(n):
        out.append(draw.choice(WORDS) + draw.choice(["", "", "", "", "ing", "ed"]))
        if k % 9 == 8:
            out[-1] += draw.choice([".", ".", ",", ".\n"])
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def prepared(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def edge_docs(prepared):
    """Nulls in every column, empty, blank and long texts, rows repeated whole, equal ids with other texts, near copies, and columns whose
    names clash with those the operators add."""
    base = prose(1, 90)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None), (5, prose(2, 40), None, None), (5, prose(3, 40), "en", "b"), (None, prose(4, 30), "en", "b"), (None, None, None, None),
        (6, base, "fr", "b"), (7, base.replace("river", "river ocean", 1), "en", "b"), (8, prose(5, 9000), "en", "c"), (9, "one", "en", "c"), (10, "12 34 !!", "es", "c"), (11, "x" * 30_000, "en", "c"), (12, "Zoë naïve 日本語 😀  <|endoftext|> İstanbul", "fr", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = prepared.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], schema)
    clash = dict.fromkeys("score lang_pred fp rid spans removed token_ids n_tokens first home part size target copies predicted cell component".split())
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer_json():
    return lambda name: Path(public_tokenizers.path(name)).read_text(encoding="utf-8")
