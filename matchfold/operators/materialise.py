"""Lineage cuts: write to the shared checkpoint folder and read back.

Parquet (rather than ``localCheckpoint``) survives executor loss, and the
re-read relation carries file-size statistics that the optimizer uses for its
size-checked broadcast decisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from matchfold.session import scratch_path

#: Folders written inside a ``scratch`` block that has not ended.
_OPEN: list[list[str]] = []


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    if _OPEN and path is None:
        _OPEN[-1].append(target)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """What is materialised inside is removed at the end, unless ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        written = _OPEN.pop()
        if not keep:
            for target in written:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        elif _OPEN:
            _OPEN[-1] += written
