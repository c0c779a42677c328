"""Spark queries vs their DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = [
    "normalise_descriptions",
    "val_error_report",
    "src_expand_records",
    "update_two_batches",
    "union_candidates",
    "first_value_priority",
    "match_ids",
    "dnb_match",
    "update_then_match",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_against_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["match"], r


def test_every_query_has_an_oracle():
    assert set(E.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "match_id", "similarity"]
    assert df.count() > 0
