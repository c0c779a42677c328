"""Spark side of every registered query (see ``__spark_entry__.py``).

All queries read the driver's tables: descriptions are derived from ``orders``
and ``part`` (``matchfold.sources.fixtures``).  Folds are expensive and shared by
many keys, so each (session, data directory) keeps its folded states in a small
cache; the states themselves live as Parquet in the checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.functions import normalise as N
from matchfold.functions.patterns import EMAIL_PATTERN
from matchfold.functions.matching import priority_coalesce, similarity_string
from matchfold.operators.joins import LARGE_BATCH, attach, sized
from matchfold.operators.match import MID_COLS, latest_duns_per_cluster, match, match_detail
from matchfold.operators.materialise import materialise
from matchfold.operators.state import MAPPING_COLUMNS, MappingState
from matchfold.operators.update import existing_impacted
from matchfold.operators.validate import split_valid, validate_descriptions
from matchfold.operators import validate as V
from matchfold.plans.api import resolve_requests
from matchfold.schema import ATTRIBUTES
from matchfold.session import scratch_path
from matchfold.sources.fixtures import BROKEN_PAYLOADS, JSON_MARKS, MARKED_COLUMNS, derived_descriptions, flawed_descriptions
from matchfold.sources.payload import expand_payloads, match_json, parse_description_text, parse_payload_text
from matchfold.sources.store import StateStore
from matchfold.streaming.stream import stream_updates

_CACHE: dict = {}

class FixtureRun:
    """Folds over the derived descriptions of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._memo: dict = {}

    def raw(self, batch: int | None = None) -> DataFrame:
        return derived_descriptions(self.spark, self.sf_dir, batch)

    def batch(self, batch: int | None = None, mode: str = "update") -> DataFrame:
        valid, _ = split_valid(self.raw(batch), mode)
        return N.normalise_descriptions(valid)

    def second(self) -> DataFrame:
        """The second batch, normalised once for all stages that show it."""
        if "second" not in self._memo:
            self._memo["second"] = materialise(self.batch(2), "second")
        return self._memo["second"]

    def second_known(self) -> DataFrame:
        """The second batch with what the last stage knows of each attribute tuple.  A stage only adds columns to the
        fold's rows, so the last one's rows hold what every stage saw: one join does for all."""
        if "known" not in self._memo:
            t = self.trace2(ATTRIBUTES[-1])
            # the tuples' hash comes first: the merge sorts by its keys, and one number decides nearly every comparison
            tuple_hash = F.xxhash64(*ATTRIBUTES)
            rows = t["rows"].withColumn("_other", tuple_hash).drop("datetime", "source").withColumnsRenamed({x: f"_{x}" for x in ATTRIBUTES})
            same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in ATTRIBUTES], F.col("_tuple") == F.col("_other"))
            known = self.second().withColumn("_tuple", tuple_hash).join(sized(rows, t["large"]), same)
            self._memo["known"] = materialise(known.drop("_tuple", "_other", *[f"_{x}" for x in ATTRIBUTES]), "known")
        return self._memo["known"]

    def _fold(self, key: str, batches: tuple) -> tuple[list[MappingState], list[dict]]:
        if key not in self._memo:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            store = StateStore(self.spark, scratch_path(self.spark, f"state-{key}"), buckets=buckets)
            store.create()
            states, traces = [], []
            for i, b in enumerate(batches):
                trace: dict = {}
                states.append(store.update(self.batch(b), batch_id=i, trace=trace))
                traces.append(trace)
            self._memo[key] = (states, traces, store)
        states, traces, _ = self._memo[key]
        return states, traces

    def store(self, key: str) -> StateStore:
        return self._memo[key][2]

    def single(self) -> MappingState:
        return self._fold("single", (None,))[0][0]

    def state1(self) -> MappingState:
        return self._fold("two", (1, 2))[0][0]

    def state2(self) -> MappingState:
        return self._fold("two", (1, 2))[0][1]

    def trace2(self, attr: str) -> dict:
        return self._fold("two", (1, 2))[1][1][attr]


def run_for(spark: SparkSession, sf_dir: str) -> FixtureRun:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = FixtureRun(spark, sf_dir)
    return _CACHE[key]


# --- normalisation ----------------------------------------------------------------

def _norm_query(expr_fn, raw_col: str, with_source: bool = False):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = run_for(spark, sf_dir).raw()
        e = expr_fn(F.col(raw_col), F.col("source")) if with_source else expr_fn(F.col(raw_col))
        return d.select("id", F.col(raw_col).alias("raw"), e.alias("value"))

    return q


def q_normalise_descriptions(spark, sf_dir):
    return N.normalise_descriptions(run_for(spark, sf_dir).raw())


# --- validation -------------------------------------------------------------------

def _val_query(mode: str, flag):
    def q(spark, sf_dir):
        d = validate_descriptions(flawed_descriptions(spark, sf_dir), mode)
        return d.select("n", flag(d).alias("violates"))

    return q


def _path_has(suffixes):
    def flag(d):
        return F.exists(
            F.col("errors"),
            lambda e: reduce(lambda a, b: a | b, [e["path"].endswith(s) & e["message"].endswith(m) for s, m in suffixes]),
        )

    return flag


def q_val_required_match(spark, sf_dir):
    d = validate_descriptions(flawed_descriptions(spark, sf_dir), "match")
    missing_id = F.lit("'id' is a required property")
    return d.select("n", F.exists(F.col("errors"), lambda e: e["message"] == missing_id).alias("violates"))


def q_val_required_update(spark, sf_dir):
    d = validate_descriptions(flawed_descriptions(spark, sf_dir), "update")
    missing = [F.lit(f"'{c}' is a required property") for c in V.REQUIRED["update"]]
    return d.select(
        "n", F.exists(F.col("errors"), lambda e: e["message"].isin(*missing)).alias("violates")
    )


def q_val_any_attribute(spark, sf_dir):
    d = validate_descriptions(flawed_descriptions(spark, sf_dir), "update")
    return d.select(
        "n",
        F.exists(F.col("errors"), lambda e: e["message"] == F.lit(f"'{V.ANY_OF_FIRST}' is a required property")).alias(
            "violates"
        ),
    )


def q_val_min_length(spark, sf_dir):
    return _val_query("update", _path_has([(f"/{c}", " is too short") for c in V.MIN_LENGTH_ONE]))(spark, sf_dir)


def q_val_ch_length(spark, sf_dir):
    return _val_query(
        "update", _path_has([("/companies_house_id", " is too short"), ("/companies_house_id", " is too long")])
    )(spark, sf_dir)


def q_val_email(spark, sf_dir):
    return _val_query("update", _path_has([("/contact_email", f" does not match {EMAIL_PATTERN!r}")]))(spark, sf_dir)


def q_val_error_report(spark, sf_dir):
    d = validate_descriptions(flawed_descriptions(spark, sf_dir), "update", index_col="n")
    return d.select(
        "n",
        F.size("errors").alias("n_errors"),
        F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), " | ").alias(
            "report"
        ),
    )


# --- JSON sources and sink ------------------------------------------------------------

def _description_json(d: DataFrame) -> DataFrame:
    fields = [
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime") if c == "datetime" else F.col(c)
        for c in ("id", "source", "datetime", *ATTRIBUTES)
    ]
    return d.select(F.to_json(F.struct(*fields)).alias("value"))


def q_src_json_descriptions(spark, sf_dir):
    return parse_description_text(_description_json(run_for(spark, sf_dir).raw()))


def _payloads(d: DataFrame, size: int = 100) -> DataFrame:
    """Payload documents of the descriptions of up to ``size`` orders each (bounded groups), by the key ``n``."""
    fields = [
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime") if c == "datetime" else F.col(c)
        for c in ("id", "source", "datetime", *ATTRIBUTES)
    ]
    item = F.struct("n", F.struct(*fields).alias("d"))
    return d.groupBy(F.floor(F.col("n") / size).alias("payload_id")).agg(
        F.to_json(
            F.struct(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["d"]).alias("descriptions"))
        ).alias("value")
    )


def _broken(docs: DataFrame) -> DataFrame:
    """Some payloads cut short, no object, or without a list of descriptions."""
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in BROKEN_PAYLOADS.items())
    return docs.withColumn("value", F.expr(f"CASE payload_id % 7 {cases} ELSE value END"))


def _numbered(r: FixtureRun) -> DataFrame:
    return r.raw().withColumn("n", F.col("id").cast("long"))


def q_src_expand_records(spark, sf_dir):
    """Whole payloads row by row; of each broken one a row that says why."""
    out = expand_payloads(_broken(_payloads(_numbered(run_for(spark, sf_dir)))), "value", key_col="payload_id")
    return out.select("payload_id", F.col("_pos").alias("pos"), "id", "source", "datetime", *ATTRIBUTES,
                      F.size("type_errors").alias("n_type_errors"), F.col("payload_error").alias("error"))


def q_request_matches_json(spark, sf_dir):
    """Requests of up to ten descriptions, some broken: the answers to those accepted."""
    r = run_for(spark, sf_dir)
    _, answers, _ = resolve_requests(r.state1(), _broken(_payloads(_numbered(r), 10)), "payload_id")
    return answers


def q_request_rejects(spark, sf_dir):
    """Requests of up to ten flawed descriptions, some broken as a whole: the error that rejects each."""
    docs = _broken(_payloads(flawed_descriptions(spark, sf_dir), 10))
    _, _, rejects = resolve_requests(run_for(spark, sf_dir).state1(), docs, "payload_id", mode="none")
    return rejects


def q_val_types(spark, sf_dir):
    """Payloads in which some values are numbers, true, null or lists."""
    d = flawed_descriptions(spark, sf_dir).withColumns({c: F.expr(e) for c, e in MARKED_COLUMNS.items()})
    value = reduce(lambda v, m: F.replace(v, F.lit(f'"{m[0]}"'), F.lit(m[1])), JSON_MARKS.items(), F.col("value"))
    out = expand_payloads(_payloads(d).withColumn("value", value), "value", key_col="payload_id")
    return out.select("payload_id", F.col("_pos").alias("pos"), (F.size("type_errors") > 0).alias("violates"),
                      F.array_join("type_errors.message", " | ").alias("messages"))


def q_val_payload_shape(spark, sf_dir):
    parsed = parse_payload_text(_broken(_payloads(_numbered(run_for(spark, sf_dir)))), "value")
    return parsed.select("payload_id", F.col("payload_error").isNull().alias("ok"), F.col("payload_error").alias("error"))


def q_sink_matches_json(spark, sf_dir):
    r = run_for(spark, sf_dir)
    return match_json(match(r.single(), r.batch(None, "match")))


# --- fold operators, in all six stages of the second batch ----------------------------------

def _per_stage(spark, sf_dir, fn) -> DataFrame:
    r = run_for(spark, sf_dir)
    return reduce(DataFrame.unionByName, [fn(r.trace2(a)).withColumn("attribute", F.lit(a)) for a in ATTRIBUTES])


def q_assign_new_ids(spark, sf_dir):
    return _per_stage(
        spark, sf_dir, lambda t: t["decided"].where(F.col("_nid").isNotNull()).select("value", F.col("_nid").alias("match_id"))
    )


def q_delta_changed_only(spark, sf_dir):
    return _per_stage(spark, sf_dir, lambda t: t["delta"])


def _stages(fn, first: int = 0):
    """``fn(run, attribute, k)`` over the stages from ``first`` on, with an attribute column.  The first
    attribute has no higher one, so it has no impacted rows and no dependents."""

    def q(spark, sf_dir):
        r = run_for(spark, sf_dir)
        parts = [fn(r, a, k).withColumn("attribute", F.lit(a)) for k, a in enumerate(ATTRIBUTES) if k >= first]
        return reduce(DataFrame.unionByName, parts)

    return q


def _higher(k: int, **cols) -> list:
    """Columns of every higher attribute, null from the k-th on: name -> (expression of j, type)."""
    return [
        (F.col(e.format(j=j)) if j < k else F.lit(None)).cast(t).alias(f"h{j}_{n}")
        for j in range(len(ATTRIBUTES) - 1)
        for n, (e, t) in cols.items()
    ]


def _lookup_stage(r, a, k):
    """The descriptions of the second batch with what the stage knows of their attribute tuple."""
    look = r.trace2(a)["look"]
    tm = attach(r.second_known(), look, a, "_fval", look.count() > LARGE_BATCH)
    return tm.select(
        "id", F.col(a).alias("value"), F.col("_fprev").alias("f_prev"), F.col("_fmid").alias("f_mid"),
        *_higher(k, prev=("_prev{j}", "long"), mid=("_mid{j}", "long")),
    )


def _existing_stage(r, a, k):
    t = r.trace2(a)
    ex = existing_impacted(t["touched"], t["best"], k, t["large"])
    return ex.select(
        "value", F.col("_fprev").alias("prev_match_id"), F.col("_fmid").alias("match_id"),
        F.col("_newest.src").alias("source"), F.col("_newest.dt").alias("datetime"),
    )


def _dependents_stage(r, a, k):
    best = r.trace2(a)["best"]
    parts = [
        best.where(F.col(f"_h{j}").isNotNull()).select(
            "prev_match_id", F.lit(ATTRIBUTES[j]).alias("higher"), F.col(f"_h{j}.dt").alias("h_datetime"), F.col(f"_h{j}.mid").alias("h_match_id")
        )
        for j in range(k)
    ]
    return reduce(DataFrame.unionByName, parts)


def _candidates_stage(r, a, k):
    t = r.trace2(a)
    look = t["look"].select("_fval", F.col("_fmid").alias("_lmid"))
    c = t["candidates"].join(sized(look, look.count() > LARGE_BATCH), F.col("value") == F.col("_fval"), "left")
    return c.select(
        "value", F.coalesce("_fmid", "_lmid").alias("f_mid"), F.col("_newest.dt").alias("f_dt"), F.col("_newest.src").alias("f_src"),
        *_higher(k, dt=("_h{j}.dt", dict(r.state1().tables[a].dtypes)["datetime"]), mid=("_h{j}.mid", "long")),
    )


def _latest_stage(r, a, k):
    return r.trace2(a)["latest"].select("value", F.col("_newest.dt").alias("datetime"), F.col("_newest.src").alias("source"))


def _first_stage(r, a, k):
    return r.trace2(a)["latest"].select("value", *_higher(k, match_id=("_h{j}.mid", "long")))


def _upsert_stage(r, a, k):
    """The table as stored: layers of the first version and the second's delta."""
    return r.state2().tables[a]


def _seed_stage(r, a, k):
    from matchfold.operators.seed import insert_if_absent

    newest = r.second().where(F.col(a).isNotNull()).groupBy(F.col(a).alias("value")).agg(F.max(F.struct("datetime", "source")).alias("_n"))
    seeds = newest.select(
        "value", F.lit(0).cast("long").alias("prev_match_id"), F.lit(0).cast("long").alias("match_id"),
        F.col("_n.source").alias("source"), F.col("_n.datetime").alias("datetime"),
    )
    # always merged: grouped by value, the seeds are laid out as the stored table is, and nothing goes to the driver
    return insert_if_absent(r.state1().tables[a], seeds, large=True)


# --- state, match and composites -----------------------------------------------------------

def q_state_scan(spark, sf_dir):
    r = run_for(spark, sf_dir)
    r.state1()
    store = r.store("two")
    return store.load(r.state1().version).long()


def q_update_attr(attr: str):
    def q(spark, sf_dir):
        return run_for(spark, sf_dir).state2().tables[attr].select(*MAPPING_COLUMNS)

    return q


def q_update_mappings(spark, sf_dir):
    return run_for(spark, sf_dir).single().long()


def q_update_two_batches(spark, sf_dir):
    return run_for(spark, sf_dir).state2().long()


def q_state_counts(spark, sf_dir):
    return run_for(spark, sf_dir).state2().long().groupBy("attribute").agg(F.count(F.lit(1)).alias("n_rows"))


def q_cluster_members(spark, sf_dir):
    from matchfold.operators.clusters import cluster_members

    return cluster_members(run_for(spark, sf_dir).state2())


def q_match_ids(spark, sf_dir):
    r = run_for(spark, sf_dir)
    return match(r.state1(), r.batch(None, "match"))


def q_dnb_match(spark, sf_dir):
    r = run_for(spark, sf_dir)
    return match(r.state1(), r.batch(None, "match"), dnb=True)


def q_update_then_match(spark, sf_dir):
    r = run_for(spark, sf_dir)
    return match(r.single(), r.batch(None, "match"))


def q_update_then_dnb_match(spark, sf_dir):
    r = run_for(spark, sf_dir)
    return match(r.single(), r.batch(None, "match"), dnb=True)


def q_priority_coalesce(spark, sf_dir):
    r = run_for(spark, sf_dir)
    d = match_detail(r.state2(), r.batch(None, "match"))
    return d.select("id", priority_coalesce(*MID_COLS).alias("match_id"))


def q_similarity_string(spark, sf_dir):
    r = run_for(spark, sf_dir)
    d = match_detail(r.state2(), r.batch(None, "match"))
    return d.select("id", similarity_string(MID_COLS, "aggr_match_id").alias("similarity"))


def q_latest_duns_per_match(spark, sf_dir):
    st = run_for(spark, sf_dir).state2()
    clusters = st.tables["duns_number"].select("match_id").distinct()
    return latest_duns_per_cluster(st, clusters, st.size("duns_number") > LARGE_BATCH).select(
        "match_id", F.col("_dm.duns").alias("duns_number"), F.col("_dm.dt").alias("datetime")
    )


def q_stream_update(spark, sf_dir):
    """The two batches arrive as JSON-lines files; an availableNow stream runs
    after each arrival and folds its micro-batch into a versioned store."""
    r = run_for(spark, sf_dir)
    src = scratch_path(spark, "stream-src")
    ckpt = scratch_path(spark, "stream-ckpt")
    store = StateStore(spark, scratch_path(spark, "stream-state"))
    store.create()
    for b in (1, 2):
        _description_json(r.raw(b)).write.text(f"{src}/batch={b}")
        stream_updates(spark, src, store, ckpt)
    return store.load().long()


QUERIES = {
    "norm_companies_house_id": _norm_query(N.norm_companies_house_id, "companies_house_id"),
    "norm_duns_number": _norm_query(N.norm_duns_number, "duns_number"),
    "norm_name_ch": _norm_query(N.norm_name_ch, "company_name"),
    "norm_name_general": _norm_query(N.norm_name_general, "company_name"),
    "norm_company_name": _norm_query(N.norm_company_name, "company_name", with_source=True),
    "norm_contact_email": _norm_query(N.norm_contact_email, "contact_email"),
    "norm_cdms_ref": _norm_query(N.norm_cdms_ref, "cdms_ref"),
    "norm_postcode": _norm_query(N.norm_postcode, "postcode"),
    "normalise_descriptions": q_normalise_descriptions,
    "val_payload_shape": q_val_payload_shape,
    "val_required_match": q_val_required_match,
    "val_required_update": q_val_required_update,
    "val_any_attribute": q_val_any_attribute,
    "val_types": q_val_types,
    "val_min_length": q_val_min_length,
    "val_ch_length": q_val_ch_length,
    "val_email": q_val_email,
    "val_error_report": q_val_error_report,
    "src_json_descriptions": q_src_json_descriptions,
    "src_expand_records": q_src_expand_records,
    "request_matches_json": q_request_matches_json,
    "request_rejects": q_request_rejects,
    "sink_matches_json": q_sink_matches_json,
    "lookup_left_join": _stages(_lookup_stage),
    "impacted_existing": _stages(_existing_stage, 1),
    "impacted_dependents": _stages(_dependents_stage, 1),
    "union_candidates": _stages(_candidates_stage),
    "latest_per_value": _stages(_latest_stage),
    "first_value_priority": _stages(_first_stage),
    "assign_new_ids": q_assign_new_ids,
    "delta_changed_only": q_delta_changed_only,
    "upsert_mapping": _stages(_upsert_stage),
    "seed_insert_if_absent": _stages(_seed_stage),
    "state_scan": q_state_scan,
    **{f"update_{a}": q_update_attr(a) for a in ATTRIBUTES},
    "update_mappings": q_update_mappings,
    "update_two_batches": q_update_two_batches,
    "state_counts": q_state_counts,
    "cluster_members": q_cluster_members,
    "match_ids": q_match_ids,
    "dnb_match": q_dnb_match,
    "update_then_match": q_update_then_match,
    "update_then_dnb_match": q_update_then_dnb_match,
    "priority_coalesce": q_priority_coalesce,
    "similarity_string": q_similarity_string,
    "latest_duns_per_match": q_latest_duns_per_match,
    "stream_update": q_stream_update,
}
