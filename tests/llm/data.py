"""Small tables for the operator tests, with the awkward rows every operator must take."""

from __future__ import annotations

import random
import zlib

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _key string, label string"


def crc(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def prose(rng: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    texts = [None, "", " \t\n", "one", "Two words", "ÄÖ ß 日本語 😀", "12 34", "a b c d e", "A B C D E", base, base, base.upper()]
    texts += [" ".join(words[:60] + ["xx"] + words[61:]), " ".join(["start"] + words), "z" * 5000, prose(rng, 30_000), "\\<|turn|> <|end|>", "x\x00y\x1cz w"]
    texts += [prose(rng, rng.randint(3, 200)) for _ in range(30)]
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], 0, 0.5, "ids", "k", "l") for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (9, "same id, other text", "de", "a", 1, None, None, None, None), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def labels(spark, rows=None):
    rng = random.Random(2)
    made = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(45)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (999, 0, 0)]
    return spark.createDataFrame(made if rows is None else rows, "doc_id long, quality int, toxic int")
