"""Cluster view (P9): every value of every cluster with its attribute priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.operators.state import MappingState
from matchfold.schema import ATTRIBUTES


def cluster_members(state: MappingState) -> DataFrame:
    """``match_id, priority, attribute, value, datetime`` -- long form, one row per
    member, so a very large cluster is never gathered into one row or task; sort or
    group it downstream as needed."""
    prio = F.array_position(F.array(*[F.lit(a) for a in ATTRIBUTES]), F.col("attribute")).cast("int")
    return state.long().select("match_id", prio.alias("priority"), "attribute", "value", "datetime")
