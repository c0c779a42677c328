"""Column expressions of the match result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def priority_coalesce(*cols: Column | str) -> Column:
    """First non-null cluster id in attribute priority order."""
    return F.coalesce(*_cols(cols))


def similarity_string(ids: Sequence[Column | str], chosen: Column | str) -> Column:
    """One digit per attribute: '1' iff that attribute's cluster is the chosen one."""
    chosen = F.col(chosen) if isinstance(chosen, str) else chosen
    digits = [F.when(c == chosen, F.lit("1")).otherwise(F.lit("0")) for c in _cols(ids)]
    return F.concat(*digits)
