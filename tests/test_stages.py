"""The fold's operators in all six stages of the second batch vs their DuckDB oracle."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from matchfold.schema import ATTRIBUTES
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
STAGED = [
    "lookup_left_join",
    "impacted_existing",
    "impacted_dependents",
    "union_candidates",
    "latest_per_value",
    "first_value_priority",
    "upsert_mapping",
    "seed_insert_if_absent",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", STAGED)
def test_all_stages_against_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["match"] and r["rows"] > 0, r
    if key.startswith(("latest", "upsert", "seed", "lookup", "first", "union")):
        got = {x["attribute"] for x in E.queries()[key](spark, SF).select("attribute").distinct().collect()}
        assert got == set(ATTRIBUTES)


def test_dependents_of_every_higher_attribute(spark):
    got = E.queries()["impacted_dependents"](spark, SF).where(F.col("attribute") == "company_name")
    assert {x["higher"] for x in got.select("higher").distinct().collect()} == {"companies_house_id", "duns_number"}
