"""Benchmark of the headline operations; prints ONE JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   BENCH_CPUS (default 8)

Timed (seconds, wall clock, JVM already started):
  update_mappings    validate + normalise + fold every derived description into an
                     empty versioned store (six stages, id allocation, commit)
  update_incremental fold the second half of the orders into the state built from
                     the first half (impacted-row recomputation, upserts)
  match_ids          match every description against the incremental state
  dnb_match          the D&B variant of the same
Match results run to completion through Spark's ``noop`` sink.  One untimed pass
over the smallest tables (sf0.001, if present) warms the JVM first, so the
figures are steady-state rather than JIT/codegen compilation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchfold.functions.normalise import normalise_descriptions  # noqa: E402
from matchfold.operators.match import match  # noqa: E402
from matchfold.operators.validate import split_valid  # noqa: E402
from matchfold.session import build_session, scratch_path  # noqa: E402
from matchfold.sources.fixtures import derived_descriptions  # noqa: E402
from matchfold.sources.store import StateStore  # noqa: E402


def batch(spark, sf_dir, n, mode="update"):
    valid, _ = split_valid(derived_descriptions(spark, sf_dir, n), mode)
    return normalise_descriptions(valid)


def timed(fn):
    t = time.perf_counter()
    out = fn()
    return out, round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", "matchfold-bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm_dir):
        warm = StateStore(spark, scratch_path(spark, "bench-warmup"), buckets=cpus)
        w = warm.update(batch(spark, warm_dir, None), batch_id=0)
        match(w, batch(spark, warm_dir, None, "match"), dnb=True).write.format("noop").mode("overwrite").save()

    # state tables bucketed on value, one bucket per shuffle partition
    single = StateStore(spark, scratch_path(spark, "bench-single"), buckets=cpus)
    single.create()
    _, times["update_mappings"] = timed(lambda: single.update(batch(spark, sf_dir, None), batch_id=0))

    store = StateStore(spark, scratch_path(spark, "bench-two"), buckets=cpus)
    store.create()
    store.update(batch(spark, sf_dir, 1), batch_id=0)
    state, times["update_incremental"] = timed(lambda: store.update(batch(spark, sf_dir, 2), batch_id=1))

    queries = batch(spark, sf_dir, None, "match")
    _, times["match_ids"] = timed(lambda: match(state, queries).write.format("noop").mode("overwrite").save())
    _, times["dnb_match"] = timed(
        lambda: match(state, queries, dnb=True).write.format("noop").mode("overwrite").save()
    )
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
