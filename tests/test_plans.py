"""Physical-plan checks: no cartesian products, no single-partition sort of data."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from matchfold import match, normalise_descriptions
from matchfold.operators.state import empty_state
from matchfold.operators.update import update_mappings
from tests.described import about, descriptions

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _state(spark):
    tuples = [about(0, register="ch1", dnb="dun1", name="name1"), about(1, dnb="dun1", name="name2", email="a@b.org"), about(2, register="ch2", dnb="dun2")]
    batch = normalise_descriptions(descriptions(spark, tuples))
    trace: dict = {}
    state = update_mappings(empty_state(spark), batch, trace=trace)
    state = update_mappings(state, batch, trace=trace)  # second pass: existing-row branch active
    return state, batch, trace


def test_no_cartesian_or_nested_loop(spark):
    state, batch, trace = _state(spark)
    plans = [match(state, batch), match(state, batch, dnb=True)]
    for t in trace.values():
        if isinstance(t, dict):
            plans += [t["candidates"], t["latest"], t["delta"]]
    for p in plans:
        text = plan_text(p)
        assert not any(f in text for f in FORBIDDEN), text


def test_match_reads_only_needed_columns(spark):
    state, batch, _ = _state(spark)
    text = plan_text(match(state, batch))
    # mapping scans read value and match_id only
    assert "ReadSchema: struct<value:string,match_id:bigint>" in text


def test_id_allocation_has_no_single_partition_exchange(spark):
    from matchfold.operators import ids

    captured = []
    real = ids.materialise

    def spy(df, name, path=None):
        captured.append(plan_text(df))
        return real(df, name, path)

    ids.materialise = spy
    try:
        df = spark.range(0, 100).select(F.col("id").alias("k"))
        ids.assign_dense_ids(df, F.lit(True), [F.col("k")], start=0, out_col="nid", num_partitions=4)
    finally:
        ids.materialise = real
    assert captured and "rangepartitioning" in captured[0].lower()
    assert "SinglePartition" not in captured[0]


def nodes(plan):
    """The physical plan's nodes with their ancestors, adaptive plans included."""
    todo = [(plan, ())]
    while todo:
        node, above = todo.pop()
        yield node, above
        name = node.getClass().getSimpleName()
        children = [node.inputPlan()] if name == "AdaptiveSparkPlanExec" else [node.children().apply(i) for i in range(node.children().size())]
        todo += [(c, (*above, name)) for c in children]


def scans_below_an_exchange(df, part: str) -> list[bool]:
    out = []
    for node, above in nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and part in node.toString():
            # an exchange of rows already joined or found is of the batch's size: only one right above the scan counts
            held = [x for x in above if x not in ("WholeStageCodegenExec", "InputAdapter", "ProjectExec", "FilterExec", "ColumnarToRowExec", "SortExec", "UnionExec", "AdaptiveSparkPlanExec")]
            out.append(bool(held) and "Exchange" in held[-1])
    return out


def test_stored_state_is_probed_in_place(spark):
    """The match's lookups and a layered table read the stored rows without an exchange of them."""
    from matchfold import StateStore
    from matchfold.operators.match import found_values, keyed_batch
    from matchfold.session import scratch_path

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        store = StateStore(spark, scratch_path(spark, "t-bucketed"), buckets=parts, fold_share=100.0)
        first = [about(i, register=f"AB{i:06d}", dnb=f"dun{i}", name=f"name{i}") for i in range(80)]
        store.update(normalise_descriptions(descriptions(spark, first)), batch_id=0)
        batch = normalise_descriptions(descriptions(spark, [about(0, register="AB000001", dnb="dun1", name="name1"), about(1, register="AB000002", dnb="dun1")] * 40))
        state = store.update(batch, batch_id=1)
        found = found_values(state, keyed_batch(batch))
        assert not any(scans_below_an_exchange(found, "duns_number")) and scans_below_an_exchange(found, "duns_number")
        assert not any(scans_below_an_exchange(state.tables["company_name"], "company_name"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_small_batch_reads_only_its_buckets(spark):
    from matchfold import StateStore
    from matchfold.operators.match import found_values, keyed_batch
    from matchfold.session import scratch_path

    store = StateStore(spark, scratch_path(spark, "t-pruned"), buckets=16)
    store.update(normalise_descriptions(descriptions(spark, [about(i, register=f"AB{i:06d}", dnb=f"dun{i}") for i in range(50)])), batch_id=0)
    state = store.load()
    asked = spark.createDataFrame([(1,)], "key long")
    # only then does the plan name the buckets; they are left out either way
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan_text(found_values(state, keyed_batch(normalise_descriptions(descriptions(spark, [about(0, register="AB000001")])))))
        assert "SelectedBucketsCount: 1 out of 16" in text
        text = plan_text(state.by_cluster().at(asked, small=True))
        assert "out of 16" in text and "SelectedBucketsCount: 16 out of 16" not in text
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert state.by_cluster().at(asked, small=True).select("value").distinct().count() == 2
