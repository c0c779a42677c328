"""The update fold: assign every attribute value of a batch to a cluster.

The batch is first reduced to its distinct attribute tuples, each with its newest
(datetime, source): rows that agree in all six attributes decide alike.  Attributes are then
processed in priority order.  Stage *k* (attribute ``F``, higher attributes
``H = ATTRIBUTES[:k]`` already updated by this batch):

1. **lookup** -- the batch's distinct values get ``F``'s current cluster (``_fmid``).
2. **impact keys** -- ``coalesce(_fmid, prev id of H[k-1], ..., prev id of H[0])``
   per batch row: clusters whose existing ``F`` members must be re-decided.
3. **existing impacted** -- ``F`` rows in those clusters.  Each carries, per higher
   attribute, the newest ``H`` row that *was* in the same cluster
   (``H.prev_match_id = F.match_id``).  Both come from one lookup in the cluster index,
   whose cost follows the clusters asked for; the newest ``H`` rows are aggregated per
   cluster first (one row each), so the join is 1:1.
4. **latest values** -- one ``groupBy(value)`` over batch rows and impacted rows:
   newest ``(datetime, source)`` and, per ``H``, the cluster of the newest row with
   a non-null ``H`` value.  Plain ``max(struct(...))`` aggregates: map-side partial
   aggregation absorbs hot values, and no window sorts a hot partition.
5. **cluster** -- first non-null of the ``H`` clusters in priority order, then the
   value's own cluster, else a new id (dense, oldest latest-datetime first).
6. **write** -- only new or changed values, as a delta; without any, nothing is written.

Every stage materialises its inputs and decisions to the shared checkpoint folder,
cutting lineage and making a lost executor cost a re-read, not a re-run of
earlier stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.operators.cluster_index import SMALL_BATCH, ClusterIndex, entries, listed, pruned
from matchfold.operators.ids import assign_dense_ids
from matchfold.operators.joins import LARGE_BATCH, attach, sized
from matchfold.operators.materialise import materialise
from matchfold.operators.state import MAPPING_COLUMNS, MappingState
from matchfold.schema import ATTRIBUTES

#: What a state is written through: (attribute, rows to write, their number) -> the stored rows, and the table they give.
TableSink = Callable[[str, DataFrame, int], "_stored"]


def prepare_batch(batch: DataFrame) -> DataFrame:
    """The row layout the fold works on: one row per distinct attribute tuple, with its newest (datetime, source)."""
    newest = F.max(F.struct("datetime", "source")).alias("_n")
    return batch.groupBy(*ATTRIBUTES).agg(newest).select("_n.datetime", "_n.source", *ATTRIBUTES)


def _h(j: int) -> str:
    return f"_h{j}"


def mapping_lookup(mapping: DataFrame, rows: DataFrame, attr: str, small: bool = False, large: bool = False) -> DataFrame:
    """The mapping rows of the batch's distinct values: ``(_fval, _fprev, _fmid)``.

    A semi join against the distinct values: the value list is broadcast when its
    size allows (never that of a ``large`` batch), and a bucketed mapping is read without a shuffle.  The values of a
    ``small`` batch become a filter, which reads only their buckets.  The result is
    batch-sized, one row per value."""
    vals = rows.where(F.col(attr).isNotNull()).select(F.col(attr).alias("value")).distinct()
    return pruned(mapping, "value", listed(vals, small)).join(sized(vals, large), "value", "left_semi").select(
        F.col("value").alias("_fval"),
        F.col("prev_match_id").alias("_fprev"),
        F.col("match_id").alias("_fmid"),
    )


def lookup_current(rows: DataFrame, mapping: DataFrame, attr: str) -> DataFrame:
    """J1 at row level: batch rows left-joined to ``attr``'s mapping (NULL never
    matches).  The fold itself never needs this row-level join (see
    ``impact_keys``); it is the operator's inspectable form."""
    look = mapping_lookup(mapping, rows, attr)
    return rows.join(look, F.col(attr) == F.col("_fval"), "left").drop("_fval")


def impact_keys(rows: DataFrame, look: DataFrame, k: int, large: bool = False) -> DataFrame:
    """Cluster ids whose existing members of attribute k must be re-decided:
    per batch row ``coalesce(current id of its value, prev id of H[k-1], ..., H[0])``.

    Built without joining every row to the lookup: stored values give their own
    id (from the per-value lookup); rows without a value give their prev-id
    coalesce; rows whose value is not stored are found per distinct
    ``(value, prev-id coalesce)`` pair, so a hot value is pre-aggregated away."""
    attr = ATTRIBUTES[k]
    cprev = F.coalesce(*[F.col(f"_prev{j}") for j in reversed(range(k))])
    stored = look.select(F.col("_fmid").alias("_key"))
    no_value = rows.where(F.col(attr).isNull()).select(cprev.alias("_key"))
    pairs = rows.where(F.col(attr).isNotNull()).select(F.col(attr).alias("_fval"), cprev.alias("_key")).where(
        F.col("_key").isNotNull()
    ).distinct()
    unknown = pairs.join(sized(look.select("_fval"), large), "_fval", "left_anti").select("_key")
    keys = stored.unionByName(no_value).unionByName(unknown)
    return keys.where(F.col("_key").isNotNull()).distinct()


def best_dependents(touched: DataFrame, k: int) -> DataFrame:
    """J2 (eager form): per impacted cluster id, for each higher attribute j < k the
    newest row whose *previous* cluster was that id -> ``(prev_match_id, _h0.._h{k-1})``.

    ``touched`` are the index entries of the impacted clusters.  ONE grouped
    aggregate (partial aggregation absorbs a hot cluster), so the literal
    product of all dependents per cluster never materialises."""
    newest = F.struct(F.col("datetime").alias("dt"), F.col("match_id").alias("mid"))
    return touched.where(F.col("was") & (F.col("attribute") < k)).groupBy(F.col("key").alias("prev_match_id")).agg(
        *[F.max(F.when(F.col("attribute") == j, newest)).alias(_h(j)) for j in range(k)]
    )


def existing_impacted(touched: DataFrame, best: DataFrame, k: int, large: bool = False) -> DataFrame:
    """J3 + J2: existing rows of attribute k in impacted clusters, one per value.

    Of a large batch ``touched`` and ``best`` are stored: the join is then between two exchanges,
    and adaptive execution can split a hot cluster; a smaller ``best`` is broadcast after
    Spark's own check."""
    ex = touched.where(F.col("now") & (F.col("attribute") == k)).select(
        "value",
        F.col("match_id").alias("_fmid"),
        F.col("prev_match_id").alias("_fprev"),
        F.struct(F.col("datetime").alias("dt"), F.col("source").alias("src")).alias("_newest"),
    )
    return ex.join(sized(best.withColumnRenamed("prev_match_id", "_pj"), large), F.col("_fmid") == F.col("_pj"), "left").drop("_pj")


def batch_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Batch rows with a value for attribute k.  The value's stored ids are not
    attached per row: they arrive with the impacted existing rows (or, for the
    first attribute, per value after aggregation)."""
    attr = ATTRIBUTES[k]
    return rows.where(F.col(attr).isNotNull()).select(
        F.col(attr).alias("value"),
        F.lit(None).cast("long").alias("_fmid"),
        F.lit(None).cast("long").alias("_fprev"),
        F.struct(F.col("datetime").alias("dt"), F.col("source").alias("src")).alias("_newest"),
        *[
            F.when(
                F.col(ATTRIBUTES[j]).isNotNull(),
                F.struct(F.col("datetime").alias("dt"), F.col(f"_mid{j}").alias("mid")),
            ).alias(_h(j))
            for j in range(k)
        ],
    )


def latest_values(candidates: DataFrame, k: int) -> DataFrame:
    """A1 + W1: one row per value; newest (datetime, source); per higher attribute
    the cluster of the newest row where it is present (ties: larger id)."""
    return candidates.groupBy("value").agg(
        F.max("_newest").alias("_newest"),
        F.max("_fmid").alias("_fmid"),
        F.max("_fprev").alias("_fprev"),
        *[F.max(_h(j)).alias(_h(j)) for j in range(k)],
    )


def chosen_cluster(k: int) -> Column:
    """Priority coalesce of higher-attribute clusters, then the value's own."""
    return F.coalesce(*[F.col(f"{_h(j)}.mid") for j in range(k)], F.col("_fmid"))


def update_stage(
    state: MappingState,
    rows: DataFrame,
    k: int,
    sink: TableSink | None = None,
    trace: dict | None = None,
    present: int | None = None,
    rows_materialised: bool = False,
    size: int = LARGE_BATCH + 1,
) -> tuple[MappingState, DataFrame]:
    """Fold one attribute.  ``rows`` must carry ``_prev{j}, _mid{j}`` for j < k
    (the post-update lookups of earlier stages).  Returns the new state and the
    rows extended with ``_prev{k}, _mid{k}``.

    ``size`` is the batch's number of rows.  ``present`` (non-null values of the attribute in the batch) and the state's
    known table sizes let trivial work be skipped: with an empty table there is
    nothing to look up and no existing row to re-decide (the initial load)."""
    attr, small, large = ATTRIBUTES[k], size <= SMALL_BATCH, size > LARGE_BATCH
    old_f = state.tables[attr]
    old_size = state.size(attr)
    if present == 0 and old_size == 0:
        # Nothing in the batch and nothing stored: the stage is a no-op.
        if trace is not None:
            trace[attr] = None
        nulls = [F.lit(None).cast("long").alias(f"_prev{k}"), F.lit(None).cast("long").alias(f"_mid{k}")]
        return state, rows.select("*", *nulls)
    if not rows_materialised:
        rows = materialise(rows, f"rows-{attr}")
    cands = batch_candidates(rows, k)
    keys = look = touched = best = None
    if old_size != 0:
        look = materialise(mapping_lookup(old_f, rows, attr, small, large), f"look-{attr}")
    if k > 0 and look is not None:
        # Every stored batch value's id is an impact key, so its own row is among
        # the impacted existing rows and brings _fmid/_fprev into the aggregate.
        # Small (impacted cluster ids) but used by several branches: written once.
        keys = materialise(impact_keys(rows, look, k, large), f"keys-{attr}")
        touched = materialise(state.by_cluster().at(keys, upto=k, small=small, large=large), f"touched-{attr}")
        best = best_dependents(touched, k)
        if large:
            best = materialise(best, f"best-{attr}")
        cands = cands.unionByName(existing_impacted(touched, best, k, large))
        latest = latest_values(cands, k)
    elif look is not None:
        # First attribute: no dependents; attach stored ids per value (1:1 join).
        latest = (
            latest_values(cands, k)
            .drop("_fmid", "_fprev")
            .join(sized(look, large), F.col("value") == F.col("_fval"), "left")
            .drop("_fval")
        )
    else:
        latest = latest_values(cands, k)
    latest = materialise(latest.withColumn("_cand", chosen_cluster(k)), f"latest-{attr}")
    moved = F.col("_cand").isNull() | F.col("_fmid").isNull() | (F.col("_fmid") != F.col("_cand"))
    n_values, n_new, n_inserted, n_changed = latest.agg(
        F.count("*"), F.count_if(F.col("_cand").isNull()), F.count_if(F.col("_fmid").isNull()), F.count_if(moved)
    ).first()
    decided = latest.withColumn("_nid", F.lit(None).cast("long"))
    if n_new:
        # New ids in order of the value's latest datetime (then value).
        decided = assign_dense_ids(
            latest, need=F.col("_cand").isNull(), order=[F.col("_newest.dt"), F.col("value")], start=state.last_id, out_col="_nid", name=f"ids-{attr}"
        )
    decided = decided.withColumn("_new", F.coalesce("_cand", "_nid"))
    changed = F.col("_fmid").isNull() | (F.col("_fmid") != F.col("_new"))
    delta = decided.where(changed).select(
        "value",
        F.coalesce("_fmid", "_new").alias("prev_match_id"),
        F.col("_new").alias("match_id"),
        F.col("_newest.src").alias("source"),
        F.col("_newest.dt").alias("datetime"),
        F.col("_fprev").alias("old_prev"),
    )
    tables, index = state.tables, state.by_cluster()
    if n_changed:
        write = sink or _stored
        stored = write(attr, delta, n_changed)
        delta = stored.delta
        tables = {**tables, attr: stored.table(old_f, old_size)}
        index = index.plus(entries(attr, delta))
    after = decided.select(
        F.col("value").alias("_aval"),
        F.when(changed, F.coalesce("_fmid", "_new")).otherwise(F.col("_fprev")).alias(f"_prev{k}"),
        F.col("_new").alias(f"_mid{k}"),
    )
    # Lazy: materialised as the next stage's input.  Many values are merged, both sides shuffled, so
    # adaptive execution can split a hot value's partition of the batch rows.
    next_rows = attach(rows, after, attr, "_aval", n_values > LARGE_BATCH)
    if trace is not None:
        trace[attr] = {
            "rows": rows,
            "look": look,
            "keys": keys,
            "touched": touched,
            "best": best,
            "candidates": cands,
            "latest": latest,
            "decided": decided,
            "delta": delta.select(*MAPPING_COLUMNS),
            "n_new": n_new,
            "large": large,
        }
    sizes = None
    if state.sizes is not None and old_size is not None:
        sizes = {**state.sizes, attr: old_size + n_inserted}  # values are never deleted
    return MappingState(tables, state.last_id + n_new, state.version, dict(state.meta), sizes, index), next_rows


class _stored:
    """A state kept without a store: the delta, and the table after it, in the checkpoint folder."""

    def __init__(self, attr: str, delta: DataFrame, rows: int):
        self.attr, self.rows, self.delta = attr, rows, materialise(delta, f"delta-{attr}")

    def table(self, old: DataFrame, old_size: int | None) -> DataFrame:
        return materialise(upsert(old, self.delta, large=self.rows > LARGE_BATCH) if old_size != 0 else self.delta.select(*MAPPING_COLUMNS), f"map-{self.attr}")


def upsert(old: DataFrame, delta: DataFrame, partitions: int | None = None, large: bool = False) -> DataFrame:
    """Insert new values, replace changed ones (value is the key).

    With ``partitions`` (the bucket count of a bucketed ``old``) the delta is
    hash-laid-out like the state, so the anti join and the union keep the state's
    layout: only the delta is shuffled, never the stored rows."""
    if partitions:
        delta = delta.repartition(partitions, "value")
    return old.join(sized(delta.select("value"), large), "value", "left_anti").select(*MAPPING_COLUMNS).unionByName(
        delta.select(*MAPPING_COLUMNS)
    )


def update_mappings(
    state: MappingState,
    batch: DataFrame,
    sink: TableSink | None = None,
    trace: dict | None = None,
    stages: int = len(ATTRIBUTES),
) -> MappingState:
    """Fold a *normalised* batch into the state, attribute by attribute.

    ``batch`` needs ``datetime, source`` and the six normalised attributes.
    ``sink`` stores what each stage writes (default: checkpoint folder).
    """
    rows = materialise(prepare_batch(batch), "batch")
    present = rows.agg(F.count("*").alias("size"), *[F.count(a).alias(a) for a in ATTRIBUTES]).first().asDict()
    for k in range(stages):
        state, rows = update_stage(
            state, rows, k, sink=sink, trace=trace, present=present[ATTRIBUTES[k]], rows_materialised=(k == 0), size=present["size"]
        )
    if trace is not None:
        trace["rows"] = rows
    if sink is None and state.index is not None and len(state.index.layers) > 4 * len(ATTRIBUTES):
        state = replace(state, index=ClusterIndex([materialise(state.index.whole(), "index")]))
    return state
