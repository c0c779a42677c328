"""Read-only matching of descriptions against the state (P3) and the D&B variant.

The state is probed where it lies: per attribute, the batch's distinct values meet the
mapping table without an exchange of it (a bucketed table is laid out by value, a few values
become a filter that reads only their buckets).  What is found is of the batch's size; it is
united, joined to the batch's ``(row, attribute, value)`` pairs and folded back per row.
Newest D&B numbers come from the cluster index, by the clusters that the batch met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.functions.matching import priority_coalesce, similarity_string
from matchfold.operators.cluster_index import SMALL_BATCH
from matchfold.operators.joins import LARGE_BATCH, sized
from matchfold.operators.materialise import materialise
from matchfold.operators.state import MappingState
from matchfold.operators.update import mapping_lookup
from matchfold.schema import ATTRIBUTES


def epoch_micros(c):
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)

MID_COLS = [f"{a}_match_id" for a in ATTRIBUTES]


def unpivot_values(rows: DataFrame) -> DataFrame:
    """``(_rk, _attr, value)`` for every non-null attribute value of every row."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_attr"), F.col(a).alias("value")) for i, a in enumerate(ATTRIBUTES)])
    return (
        rows.select("_rk", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))
    )


def found_values(state: MappingState, rows: DataFrame, size: int | None = None) -> DataFrame:
    """``(_attr, value, match_id)`` of every value of the batch (of ``size`` rows) that the state knows."""
    size = rows.count() if size is None else size
    small, large = size <= SMALL_BATCH, size > LARGE_BATCH
    parts = [
        mapping_lookup(state.tables[a], rows, a, small, large).select(F.lit(i).alias("_attr"), F.col("_fval").alias("value"), F.col("_fmid").alias("match_id"))
        for i, a in enumerate(ATTRIBUTES)
        if state.size(a) != 0
    ]
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "_attr int, value string, match_id long")


def lookup_all(state: MappingState, rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per row, the cluster of each of its six attribute values (NULL if unknown).

    ``rows`` should be stored.  The join with what was found is between batch-sized
    sides; adaptive execution splits a hot value."""
    size = rows.count()
    found = found_values(state, rows, size) if found is None else found
    hits = unpivot_values(rows).join(sized(found, size > LARGE_BATCH), ["_attr", "value"], "inner")
    per_row = hits.groupBy("_rk").agg(
        *[F.max(F.when(F.col("_attr") == i, F.col("match_id"))).alias(MID_COLS[i]) for i in range(len(ATTRIBUTES))]
    )
    return rows.join(sized(per_row, size > LARGE_BATCH), "_rk", "left")


def keyed_batch(batch: DataFrame) -> DataFrame:
    """Batch with a row key ``_rk``, materialised once: normalisation (regex work)
    runs a single time and the key is stable across the plan's branches."""
    if "_rk" in batch.columns:
        return batch
    return materialise(batch.withColumn("_rk", F.monotonically_increasing_id()), "match-batch")


def match_detail(state: MappingState, batch: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rows with all six cluster ids, the chosen cluster and the similarity string."""
    looked = lookup_all(state, keyed_batch(batch), found)
    return looked.withColumn("aggr_match_id", priority_coalesce(*MID_COLS)).withColumn(
        "similarity", similarity_string(MID_COLS, "aggr_match_id")
    )


def match(state: MappingState, batch: DataFrame, dnb: bool = False, request: str | None = None) -> DataFrame:
    """P3/P4 over a *normalised* batch.

    match: ``(id, match_id, similarity)``, one row per description (duplicate ids
    kept).  dnb: ``match_id`` is the description's own D&B number, else the newest
    D&B number of its cluster; one row per id.  ``request`` names a column that tells
    requests apart: it is carried to the result, and ids count within a request.
    """
    keep, rows = [request] if request else [], keyed_batch(batch)
    if not dnb:
        detail = match_detail(state, rows)
        return detail.select(*keep, "id", F.col("aggr_match_id").alias("match_id"), "similarity")
    size = rows.count()
    found = materialise(found_values(state, rows, size), "match-found")
    return dnb_choose(state, match_detail(state, rows, found), found.select("match_id").distinct(), keep, size > LARGE_BATCH)


def latest_duns_per_cluster(state: MappingState, clusters: DataFrame, large: bool = False) -> DataFrame:
    """A2 helper: newest D&B number per cluster (ties: smallest number), of the clusters asked for."""
    k = ATTRIBUTES.index("duns_number")
    duns = state.by_cluster().at(clusters.select("match_id"), k, large=large).where(F.col("now") & (F.col("attribute") == k))
    return duns.groupBy("match_id").agg(
        F.min(
            F.struct(
                (-epoch_micros(F.col("datetime"))).alias("neg_us"),
                F.col("value").alias("duns"),
                F.col("datetime").alias("dt"),
            )
        ).alias("_dm")
    )


def dnb_choose(state: MappingState, detail: DataFrame, clusters: DataFrame, keep: list[str], large: bool = False) -> DataFrame:
    """J5 + A2: attach the cluster's newest D&B number; keep one row per id (of a request).

    ``clusters`` are those that any value of the batch was found in.
    Among rows sharing an id the chosen one is: no cluster D&B row first, then the
    newest cluster D&B datetime, smallest number, newest description, attributes."""
    dm = latest_duns_per_cluster(state, clusters, large).withColumnRenamed("match_id", "_dm_id")
    # rows of no cluster find nothing: their row keys spread them over the shuffle's tasks
    key = F.coalesce("aggr_match_id", "_rk")
    joined = detail.join(sized(dm, large), F.col("aggr_match_id").isNotNull() & (key == F.col("_dm_id")), "left")
    out_id = F.coalesce(F.col("duns_number"), F.col("_dm.duns"))
    ordering = F.struct(
        F.col("_dm").isNotNull().alias("o1"),
        F.col("_dm.neg_us").alias("o2"),
        F.col("_dm.duns").alias("o3"),
        F.col("datetime").isNull().alias("o4"),
        (-epoch_micros(F.col("datetime"))).alias("o5"),
        *[F.col(a).alias(f"o_{a}") for a in ATTRIBUTES],
        out_id.alias("match_id"),
        F.col("similarity").alias("similarity"),
    )
    best = joined.groupBy(*keep, "id").agg(F.min(ordering).alias("_b"))
    return best.select(*keep, "id", F.col("_b.match_id").alias("match_id"), F.col("_b.similarity").alias("similarity"))
