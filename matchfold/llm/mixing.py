"""Operator 10: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queued, pass after pass (a
document at most ``max_epochs`` times).  An item's virtual finish time is the words
queued in its source up to and including it, divided by the source's target.  All
queues are then served in order of finish time until the total budget is spent: an
item is taken if the words served before it are below the budget.

Scale.  Running sums never need a whole source in one task: a source is cut into
ranges of the shuffle hash, each range is summed by ``groupBy``, and a window runs
only inside one range; the sums of earlier ranges come from a narrow table.  The
global order is cut into ranges of finish time in the same way.  A hot source thus
spreads over all ranges.

Rows: a null or empty text has size 0; it finishes with its predecessor and takes 0
words.  Null sources form one source, last in order.  Repeated rows are queued each.
A source of size 0 has target 0.  Ties in finish time are served by source, hash and
id; equal rows are interchangeable.  Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchfold.llm.common import boxed, materialise, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From (source, source_size), one row per source: adds ``target``.

    Sources by code point, null last, take the weights in turn.  The budget is ``share``
    of all sizes; a target stops at ``max_epochs`` of its source's size and the excess is
    shared again.  The end state is one level: with sources in order of limit per weight,
    those whose limit is below the level of what is left are full, the others get level
    times weight.  (Levels computed past the first open source are lower: it has the largest.)
    The table has one row per source, so its windows see only that.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
    t = t.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / F.col("_open"))
    t = t.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    t = t.withColumn("_common", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_common") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``."""
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    slot = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    head = F.conv(F.substring("_slot", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("_slot", slot)
    sized = materialise(sized.withColumn("_range", F.floor(head * ranges).cast("int")), "mix-sizes")

    per_range = sized.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    per_range = materialise(per_range, "mix-ranges")
    goal = targets(per_range.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, float(max_epochs))
    goal = materialise(goal, "mix-targets")
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    plan = starts.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    plan = plan.withColumnsRenamed({"source": "_s", "_range": "_r"})

    inside = Window.partitionBy("source", "_range").orderBy("_slot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("_run", F.sum("size").over(inside))
    queued = queued.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    upto = F.col("_start") + F.col("_run")
    queued = queued.withColumn("_item", F.monotonically_increasing_id())
    queued = materialise(queued.select("doc_id", "source", "size", "source_size", "target", "_slot", "_item", upto.alias("_upto")), "mix-queue")

    total = goal.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    budget = math.floor(total * share + 0.5)
    # time 1 is where each source meets its target; only items that start before it, or just after, can be served
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    items = queued.where("size > 0").withColumn("_epoch", epoch)
    items = items.withColumn("_finish", (F.col("_epoch") * F.col("source_size") + F.col("_upto")) / F.col("target"))
    items = items.withColumn("_tick", F.floor(F.least(F.col("_finish"), F.lit(2.0)) * ranges).cast("int"))
    ticks = items.groupBy("_tick").agg(F.sum("size").alias("_sum"))
    # one row per range of finish time: their number is fixed by ``ranges``
    before = Window.partitionBy(F.lit(0)).orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = materialise(ticks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))), "mix-ticks")
    served = items.join(ticks.where(F.col("_before") + F.col("_sum") <= budget).select("_tick"), "_tick", "left_semi").select("_item", "size")
    # the range in which the budget ends is ranked item by item
    edge = items.join(ticks.where((F.col("_before") < budget) & (F.col("_before") + F.col("_sum") > budget)), "_tick")
    order = Window.partitionBy("_tick").orderBy("_finish", F.col("source").isNull(), F.col("source").cast("binary"), "_slot", "doc_id", "size", "_item")
    edge = edge.withColumn("_ahead", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    served = served.unionByName(edge.where(F.col("_ahead") < budget).select("_item", "size"))
    taken = served.groupBy("_item").agg(F.sum("size").alias("taken"))
    out = queued.join(taken, "_item", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it was taken.

    Documents of size 0 are never taken.
    """
    plan = mix(docs, **options)
    times = plan.groupBy("doc_id", "source", "size").agg(
        F.sum(F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("long")).otherwise(0)).alias("_times"), F.count("*").alias("_rows")
    )
    times = times.where("_times > 0").withColumnsRenamed({"doc_id": "_d", "source": "_s", "size": "_n"})
    sized = boxed(docs, _id=F.col("doc_id"), _source=F.col("source"), _size=word_count(F.col("text")))
    on = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    joined = sized.join(times, on)
    # rows with the same id, source and size share their copies evenly, the first by text one more
    rank = F.row_number().over(Window.partitionBy("_d", "_s", "_n").orderBy("row.text"))
    each, rest = F.floor(F.col("_times") / F.col("_rows")), F.col("_times") % F.col("_rows")
    one = joined.where("_rows = 1").withColumn("_k", F.col("_times"))
    several = joined.where("_rows > 1").withColumn("_k", each + (rank <= rest).cast("long"))
    rows = one.unionByName(several).where("_k > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))).select("row.*")
