"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.operators.materialise import materialise  # noqa: F401  re-exported

#: A key set up to this many rows may be broadcast (8-byte keys: about 16 MB on the wire).
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own setting: the one figure by which a user sizes shuffles to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keys_join(big: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Join a wide table to a narrow key table, broadcasting the keys only if they are few.

    ``keys`` must be stored already (it is counted).  Beyond ``limit`` rows the join
    shuffles both sides, and adaptive execution splits hot keys.
    """
    few = keys.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Rows of ``docs`` whole in one column ``row``, so that helper columns beside it clash with no name of theirs."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009..U+000D, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def planes(a: np.ndarray) -> bytes:
    """An integer array with its bytes regrouped by significance, which compresses well when sorted."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a key depends on all bits of its parts."""
    a = a ^ (a >> np.uint64(31))
    a = a * np.uint64(0x9E3779B97F4A7C15)
    a = a ^ (a >> np.uint64(29))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def cuts(keys: np.ndarray, blocks: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted 64-bit keys by equal ranges of the key space, empty ones left out."""
    step = (1 << 64) // blocks
    edge = np.searchsorted(keys, np.array([i * step for i in range(1, blocks)], np.uint64))
    edge = [0, *edge.tolist(), len(keys)]
    for i in range(blocks):
        if edge[i] < edge[i + 1]:
            yield i, slice(edge[i], edge[i + 1])


def frames(batches: Iterable, rows: int) -> Iterator:
    """Pandas frames of at most so many rows."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


_TABLES: dict = {}


def worker_tables(key, make):
    """Tables that a Python worker keeps from task to task, one set at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
        gc.freeze()  # they stay: the collector need not walk them again and again
    return _TABLES[key]


def release(keep: bool = False) -> None:
    """Give memory that this worker has freed back to the system: idle workers live on beside the JVM's heap.

    Without ``keep`` the tables of another operator that ran in this worker go as well.
    """
    import ctypes

    import pyarrow as pa

    if _TABLES and not keep:
        _TABLES.clear()
        gc.unfreeze()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
