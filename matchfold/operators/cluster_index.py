"""The state a second time, by cluster: which values are, and were before, in a cluster.

An entry says for a cluster (``key``) and a value that the value is in it (``now``) or was in
it before its last move (``was``).  A changed row gives one entry for each cluster it touches:
the new one, the old one, and the one before, whose entry says neither.  So lookups by
``match_id`` and by ``prev_match_id`` are one, over all attributes, and updates only append.

Layers are in order of time; of the entries of one cluster and value the newest counts.  They
are laid out by ``slot`` = 8 * cluster + a share of the value's hash: the entries of a very
large cluster lie in 8 places, and the (batch-sized) clusters asked for are repeated 8 times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.operators.joins import sized
from matchfold.schema import ATTRIBUTES

SLOTS = 8
ENTRY_DDL = (
    "slot BIGINT, key BIGINT, attribute INT, value STRING, now BOOLEAN, was BOOLEAN, "
    "prev_match_id BIGINT, match_id BIGINT, source STRING, datetime TIMESTAMP_NTZ"
)
ENTRY_COLUMNS = [x.split()[0] for x in ENTRY_DDL.split(", ")]
#: Keys of batches of up to so many rows are put into the scan's filter, which then reads only their buckets.
SMALL_BATCH = 64


def slot_of(key: Column, part: Column) -> Column:
    return key * SLOTS + part


def pruned(df: DataFrame, column: str, keys: list | None) -> DataFrame:
    return df if keys is None else df.where(F.col(column).isin(keys))


def listed(keys: DataFrame, small: bool) -> list | None:
    """The keys (first column) of a small batch; at most one per row and attribute."""
    return [r[0] for r in keys.collect()] if small else None


def entries(attr: str, delta: DataFrame) -> DataFrame:
    """Entries of rows written: ``delta`` has the mapping columns and ``old_prev``, the previous cluster before the last."""
    clusters = F.array_distinct(F.filter(F.array("match_id", "prev_match_id", "old_prev"), lambda x: x.isNotNull()))
    out = delta.withColumn("key", F.explode(clusters))
    part = F.pmod(F.xxhash64("value"), F.lit(SLOTS))
    return out.select(
        slot_of(F.col("key"), part).alias("slot"),
        "key",
        F.lit(ATTRIBUTES.index(attr)).alias("attribute"),
        "value",
        (F.col("key") == F.col("match_id")).alias("now"),
        (F.col("key") == F.col("prev_match_id")).alias("was"),
        "prev_match_id",
        "match_id",
        "source",
        "datetime",
    )


class ClusterIndex:
    """``fresh``: how many of the layers, the last ones, are an update's own and not laid out by slot yet."""

    def __init__(self, layers: list[DataFrame] | None = None, fresh: int = 0):
        self.layers, self.fresh = layers or [], fresh

    @staticmethod
    def of(tables: dict[str, DataFrame]) -> "ClusterIndex":
        """An index over tables that have none stored (a scan of them)."""
        old = F.lit(None).cast("long").alias("old_prev")
        return ClusterIndex([reduce(DataFrame.unionByName, [entries(a, t.select("*", old)) for a, t in tables.items()])])

    def plus(self, layer: DataFrame) -> "ClusterIndex":
        return ClusterIndex([*self.layers, layer], self.fresh + 1)

    def numbered(self) -> list[DataFrame]:
        return [x.withColumn("_layer", F.lit(i)) for i, x in enumerate(self.layers)]

    def union(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.numbered())

    def groups(self) -> list[DataFrame]:
        """The layers as they are looked into: each stored one alone, so that its layout spares the exchange, the fresh ones together."""
        layers, stored = self.numbered(), len(self.layers) - self.fresh
        return layers[:stored] + ([reduce(DataFrame.unionByName, layers[stored:])] if self.fresh else [])

    def newest(self, found: DataFrame) -> DataFrame:
        """Of the entries of one cluster and value the one of the newest layer, if it is live."""
        if len(self.layers) > 1:
            rest = [c for c in ENTRY_COLUMNS if c not in ("slot", "key", "attribute", "value")]
            one = found.groupBy("slot", "key", "attribute", "value").agg(F.max_by(F.struct(*rest), F.col("_layer")).alias("_e"))
            found = one.select("slot", "key", "attribute", "value", "_e.*")
        return found.where(F.col("now") | F.col("was")).select(*ENTRY_COLUMNS)

    def at(self, clusters: DataFrame, upto: int = len(ATTRIBUTES) - 1, small: bool = False, large: bool = False) -> DataFrame:
        """The live entries of the clusters (one column, distinct, not null), of attributes up to ``upto``;
        ``large`` ones, of which there may be many, are not broadcast."""
        if not self.layers:
            return clusters.sparkSession.createDataFrame([], ENTRY_DDL)
        name = clusters.columns[0]
        parts = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_part")
        slots = clusters.select(name, parts).select(slot_of(F.col(name), F.col("_part")).alias("slot"))
        known = listed(clusters, small)
        asked = None if known is None else [k * SLOTS + i for k in known for i in range(SLOTS)]
        found = [pruned(x.where(F.col("attribute") <= upto), "slot", asked).join(sized(slots, large), "slot", "left_semi") for x in self.groups()]
        return self.newest(reduce(DataFrame.unionByName, found))

    def whole(self) -> DataFrame:
        """All live entries (for writing the layers as one)."""
        return self.newest(self.union())
