"""Queries with a SQL form, and the shape of all others."""

import pytest

import corpus_pipeline
from ledgerlens.llm.oracles import ORACLES
from ledgerlens.llm.queries import QUERIES
from tools.check_oracles import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    message, _, good = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
    assert good, message


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights",
        "SentencePiece encoding and decoding"]
