"""Insert-if-absent (S8): seed a mapping table without touching existing rows.

``StateStore.seed`` does the same to a stored state, as one committed version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.operators.joins import sized
from matchfold.operators.state import MAPPING_COLUMNS


def insert_if_absent(table: DataFrame, seeds: DataFrame, large: bool = False) -> DataFrame:
    """``table`` plus the ``seeds`` whose value is not present yet; ``created``
    tells which rows were inserted.  Of several seeds of one value the newest counts
    (by datetime, then source, then ids).  A ``large`` table is not broadcast."""
    newest = F.max(F.struct("datetime", "source", "match_id", "prev_match_id")).alias("_r")
    one = seeds.groupBy("value").agg(newest).select("value", "_r.prev_match_id", "_r.match_id", "_r.source", "_r.datetime")
    kept = table.select(*MAPPING_COLUMNS, F.lit(False).alias("created"))
    new = one.join(sized(table.select("value"), large), "value", "left_anti").select(*MAPPING_COLUMNS, F.lit(True).alias("created"))
    return kept.unionByName(new)
