"""The mapping state: six attribute -> cluster tables plus the id high-water mark."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.operators.cluster_index import ClusterIndex
from matchfold.schema import ATTRIBUTES, MAPPING_SCHEMA

MAPPING_COLUMNS = [f.name for f in MAPPING_SCHEMA.fields]


@dataclass(frozen=True)
class MappingState:
    """Immutable view of one state version.

    ``tables[attr]`` has columns ``value, prev_match_id, match_id, source, datetime``
    with ``value`` unique.  ``last_id`` is the highest cluster id ever handed out
    (ids of clusters that lost all members are never reused).  ``index`` is the same
    by cluster; a state without one answers by scans of its tables.
    """

    tables: dict[str, DataFrame]
    last_id: int = 0
    version: int | None = None
    meta: dict = field(default_factory=dict)
    sizes: dict[str, int] | None = None  # row count per table when known
    index: ClusterIndex | None = None

    def table(self, attr: str) -> DataFrame:
        return self.tables[attr]

    def by_cluster(self) -> ClusterIndex:
        return self.index if self.index is not None else ClusterIndex.of(self.tables)

    def long(self) -> DataFrame:
        """All six tables as ``attribute, value, prev_match_id, match_id, source, datetime``."""
        parts = [
            self.tables[a].select(F.lit(a).alias("attribute"), *MAPPING_COLUMNS) for a in ATTRIBUTES
        ]
        return reduce(DataFrame.unionByName, parts)

    def with_table(self, attr: str, df: DataFrame) -> "MappingState":
        tables = dict(self.tables)
        tables[attr] = df
        return MappingState(tables, self.last_id, self.version, dict(self.meta), None)

    def size(self, attr: str) -> int | None:
        return None if self.sizes is None else self.sizes.get(attr)


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_SCHEMA)


def empty_state(spark: SparkSession) -> MappingState:
    return MappingState({a: empty_mapping(spark) for a in ATTRIBUTES}, 0, 0, {}, {a: 0 for a in ATTRIBUTES}, ClusterIndex())
