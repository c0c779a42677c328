"""Dense, gap-free id allocation in a global order without a single-partition sort.

``row_number()`` over an un-partitioned window would pull every row into one task.
Instead the rows that need an id, and only they, are range-partitioned on the order and
sorted within each partition.  The low 33 bits of ``monotonically_increasing_id()`` are
the record's position within its partition (documented behaviour).  Running sums of the
partitions' counts -- a table of one row per partition -- shift each partition into place
by a join.  Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchfold.operators.materialise import materialise

_POSITION_MASK = (1 << 33) - 1


def assign_dense_ids(
    df: DataFrame,
    need: Column,
    order: Sequence[Column],
    start: int,
    out_col: str,
    num_partitions: int | None = None,
    name: str = "ids",
) -> DataFrame:
    """Give rows where ``need`` holds the ids ``start+1, start+2, ...`` in ``order``.

    Other rows get NULL in ``out_col`` and are passed on as they are.  ``order`` must be a total order.  ``df`` is read
    twice: it should be stored.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = F.coalesce(need.cast("boolean"), F.lit(False))
    ranged = (
        df.where(need)
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    # Materialise: partition ids and positions must not change if a task is re-run.
    numbered = materialise(ranged, name)
    # one row per partition, so this window and its broadcast are bounded by ``n``
    counts = numbered.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    with_id = numbered.join(F.broadcast(starts), "_pid").withColumn(out_col, F.lit(start) + F.col("_before") + F.col("_pos") + F.lit(1))
    others = df.where(~need).withColumn(out_col, F.lit(None).cast("long"))
    return with_id.drop("_pid", "_pos", "_before").unionByName(others)
