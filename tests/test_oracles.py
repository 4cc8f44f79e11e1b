"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from ledgerlens.plans import registered
from tools.check_oracles import compare, connect

ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in registered.QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    message, _, good = compare(spark, con, sf_dir, name, entry.queries()[name], ORACLES[name])
    assert good, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1000


def test_every_query_without_sql_is_a_model():
    assert set(registered.QUERIES) - set(ORACLES) == {
        "train_candidates", "evaluate_model", "compare_with_production", "model_score"
    }
