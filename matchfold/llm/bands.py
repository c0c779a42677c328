"""Operator 4: quality rules by compression bands.

The whole text and each fixed chunk of it are compressed with zstandard.  A ratio (raw
bytes by compressed bytes) above the upper limit of its length band means repetitive
text, one below the lower limit text that does not compress like prose.  A document is
rejected if its whole ratio leaves its band, or if more than ``bad_chunks`` of its
chunks leave theirs.

Rows: a null or empty text has no words and fails the base rules.  Each row is judged
alone, so repeated rows give repeated results.  Long texts are read whole; their
chunks are compressed one after another.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bytes from, lowest ratio, highest ratio): short texts carry frame costs, long ones repeat more.  Each lower limit
#: lies above random base64 or printable words of six letters of the band's largest size and below the 0.1 percentile
#: of prose of its smallest.  Texts below 128 bytes are too short to tell the two apart.
BANDS = (
    (0, 0.40, 2.6), (128, 1.05, 2.6), (144, 1.08, 2.6), (176, 1.13, 2.6), (224, 1.19, 2.6),
    (256, 1.23, 3.0), (384, 1.30, 3.0), (512, 1.35, 3.0), (768, 1.42, 3.0),
    (1024, 1.50, 3.4), (2048, 1.60, 3.4), (4096, 1.65, 3.8), (16384, 1.70, 4.4), (65536, 1.75, 5.0),
)
CHUNK_BYTES = 4096
BAD_CHUNKS = 0.25
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, bad_chunks long"
)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()]
    return len(lines) - len(set(lines))


def repeated_window_words(ws: list[bytes], n: int = 8) -> int:
    """Words inside n-word windows that occur at least twice.

    Windows are compared exactly: words are numbered, then pairs of numbers, then pairs
    of pairs, so equal numbers mean equal windows of 2, 4 and 8 words.
    """
    if len(ws) <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
    span = 1
    while span < n:
        both = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids = np.unique(both, return_inverse=True)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ws) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def ratio(compressor, raw: bytes) -> float:
    return len(raw) / len(compressor.compress(raw)) if raw else 1.0


def in_band(size: int, r: float, bands=BANDS) -> bool:
    low, high = next((lo, hi) for start, lo, hi in reversed(bands) if size >= start)
    return low <= r <= high


def judge(compressor, text: str | None, bands=BANDS, chunk: int = CHUNK_BYTES, bad_share: float = BAD_CHUNKS) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    ws = raw.split()
    n = len(ws)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeats = repeated_window_words(ws)
    failed = n < 20 or 100 * repeats > 30 * n
    whole = ratio(compressor, raw)
    # equal cuts of at most ``chunk`` bytes; a text of one chunk is judged as a whole only
    count = -(-len(raw) // chunk)
    size = -(-len(raw) // count) if count else 0
    parts = [raw[i : i + size] for i in range(0, len(raw), size)] if count > 1 else []
    bad = sum(not in_band(len(p), ratio(compressor, p), bands) for p in parts)
    good = in_band(len(raw), whole, bands) and bad <= bad_share * len(parts)
    return n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, not failed and good, whole, len(parts), bad


def verdict(text: Column, bands=BANDS, chunk: int = CHUNK_BYTES, bad_share: float = BAD_CHUNKS, level: int = 3) -> Column:
    """The judgement of a text column as a struct."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for s in batches:
            yield pd.DataFrame([judge(compressor, t, bands, chunk, bad_share) for t in s], columns=names)

    return run(text)


def compression_bands(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, ratios, base_failed and kept for each row."""
    return docs.select("doc_id", verdict(F.col("text"), **options).alias("_v")).select("doc_id", "_v.*")
