"""How the joins of fold, match and seed treat a side that may be large, and rows without a key.

Spark takes a stored side for small by the size of its files.  Ids and values pack well in
Parquet: files of 10 MB can be hundreds of MB as a broadcast's hash table, and the driver
builds it.  Where the number of rows is known, it decides: a side of more than ``LARGE_BATCH``
rows is merged (both sides shuffled or read by bucket, nothing sent to the driver); for a
smaller one Spark's own size checks decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of joins with more rows are never broadcast.  Batches of more rows also get their newest
#: dependents stored before the join, so that a hot cluster can be split.
LARGE_BATCH = 200_000


def sized(side: DataFrame, large: bool) -> DataFrame:
    """``side`` of a join, never broadcast if ``large``."""
    return side.hint("merge") if large else side


def attach(rows: DataFrame, side: DataFrame, key: str, other: str, large: bool) -> DataFrame:
    """Stored ``rows`` left-joined to ``side`` (unique in ``other``), without that column.

    Rows whose ``key`` is null find nothing and stay out of the join: a shuffle would bring
    all of them to one task."""
    found = rows.where(F.col(key).isNotNull()).join(sized(side, large), F.col(key) == F.col(other), "left").drop(other)
    new = [F.lit(None).cast(t).alias(c) for c, t in side.dtypes if c != other]
    return found.unionByName(rows.where(F.col(key).isNull()).select("*", *new))
