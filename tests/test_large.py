"""Large batches and tables: results with every side taken for large, and what their plans send to the driver or to one task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from matchfold import StateStore, match, normalise_descriptions
from matchfold.operators import match as match_module
from matchfold.operators import update as update_module
from matchfold.operators.joins import attach
from matchfold.operators.seed import insert_if_absent
from matchfold.plans import queries as query_module
from matchfold.session import scratch_path
from matchfold.sources import store as store_module
from matchfold.sources.fixtures import derived_descriptions
from tests.described import about, descriptions
from tests.oracle_harness import compare, duck
from tests.test_plans import nodes, plan_text, scans_below_an_exchange

SF = "/root/testdata/sf0.001"
NAMED = [
    "dnb_match", "update_then_dnb_match", "state_counts", "seed_insert_if_absent", "similarity_string", "priority_coalesce",
    "lookup_left_join", "stream_update", "union_candidates", "update_mappings", "assign_new_ids", "sink_matches_json", "upsert_mapping", "latest_duns_per_match", "impacted_existing",
]


@pytest.fixture(scope="module")
def large():
    """Every batch and table counts as large; folds kept from before are not used."""
    modules, kept = (update_module, match_module, store_module, query_module), dict(query_module._CACHE)
    before = [m.LARGE_BATCH for m in modules]
    query_module._CACHE.clear()
    for m in modules:
        m.LARGE_BATCH = -1
    yield
    for m, n in zip(modules, before):
        m.LARGE_BATCH = n
    query_module._CACHE.clear()
    query_module._CACHE.update(kept)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", NAMED)
def test_large_sides_against_oracle(spark, con, large, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["match"] and r["rows"] > 0, r


def _broadcasts(df) -> list[str]:
    return [n.toString() for n, _ in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]


def test_large_match_and_seed_broadcast_nothing(spark, large):
    """Files of a few KB: by their size Spark would broadcast every side."""
    store = StateStore(spark, scratch_path(spark, "t-large"), buckets=2)
    batch = normalise_descriptions(descriptions(spark, [about(i, register=f"AB{i:06d}", dnb=f"dun{i}", name=f"name{i}") for i in range(30)]))
    state = store.update(batch, batch_id=0)
    seeds = state.tables["duns_number"].select("value", "prev_match_id", "match_id", "source", "datetime")
    for df in (match(state, batch, dnb=True), match(state, batch), insert_if_absent(state.tables["duns_number"], seeds, large=True)):
        assert not _broadcasts(df)


def test_parts_are_not_broadcast(spark):
    assert not _broadcasts(derived_descriptions(spark, SF))


def test_rows_without_a_key_stay_out_of_the_join(spark):
    """Their shuffle would bring all of them to the one task of the null key."""
    path = scratch_path(spark, "t-keyless")
    spark.range(1000).select("id", F.when(F.col("id") < 10, F.concat(F.lit("v"), F.col("id") % 4)).alias("a")).write.parquet(path)
    rows = spark.read.parquet(path)
    side = spark.createDataFrame([("v0", 5), ("v1", 6)], "_v string, m long")
    out = attach(rows, side, "a", "_v", large=True)
    assert out.columns == ["id", "a", "m"]
    got = {r.id: r.m for r in out.collect()}
    assert len(got) == 1000 and got[0] == 5 and got[5] == 6 and got[2] is None and got[500] is None
    assert "isnotnull(a" in plan_text(out) and not _broadcasts(out)
    written = [int(n.metrics().apply("shuffleRecordsWritten").value()) for n in _shuffles(out)]
    assert written and sum(written) <= 10 + side.count()


def _shuffles(df):
    """The shuffles that ran, below an adaptive plan's stages."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node)
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_seed_query_broadcasts_nothing(spark):
    """Small tables too: each would be a page of up to 64 MB in the driver."""
    assert not _broadcasts(E.queries()["seed_insert_if_absent"](spark, SF))


def test_lookup_query_joins_the_tuples_once(spark):
    """Not again for each of the six stages."""
    text = plan_text(E.queries()["lookup_left_join"](spark, SF))
    assert "/second-" not in text and "<=>" not in text
    assert "/known-" in text


def test_stored_index_is_not_shuffled(spark):
    """Beside an update's fresh entries, which are."""
    from matchfold.operators.cluster_index import ENTRY_COLUMNS, entries

    store = StateStore(spark, scratch_path(spark, "t-index"), buckets=2)
    batch = normalise_descriptions(descriptions(spark, [about(i, register=f"AB{i:06d}", dnb=f"dun{i}") for i in range(30)]))
    state = store.update(batch, batch_id=0)
    delta = state.tables["duns_number"].select("*", F.lit(None).cast("long").alias("old_prev"))
    index, keys = state.by_cluster(), delta.select(F.col("match_id").alias("_key")).distinct()
    both = index.plus(entries("duns_number", delta)).at(keys, large=True)
    assert _rows(both) == _rows(index.at(keys, large=True)) != []
    assert both.columns == ENTRY_COLUMNS
    stored = scans_below_an_exchange(both, "_index")
    assert stored and not any(stored)


def _rows(df):
    return sorted(map(str, df.collect()))
