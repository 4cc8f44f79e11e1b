import os

import pytest

from ledgerlens.llm.shipping import ship

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, secrets int, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    words = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [
        (1, "", "en", "a", 0, 0.5, 1, "x"), (2, None, None, None, None, None, None, None), (3, " \n\t ", "en", "a", 4, 0.5, 1, "x"),
        (4, words, "en", "a", 1, 0.5, 1, "x"), (5, words, "en", "b", 1, 0.5, 1, "x"), (5, words, "en", "b", 1, 0.5, 1, "x"),
        (None, words, "en", "b", 1, 0.5, 1, "x"), (None, "one two", "en", "b", 1, 0.5, 1, "x"), (6, "one two", None, "b", 1, 0.5, 1, "x"),
        (7, "Ünï ▁ \U0001F600 cödé", "de", None, 1, 0.5, 1, "x"), (8, "x" * 50_000, "de", "c", 1, 0.5, 1, "x"),
    ]
    return spark.createDataFrame(rows, ODD)
