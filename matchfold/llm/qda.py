"""Operator 9: quality by regularised quadratic discriminant analysis.

Each text is turned into a vector of document statistics (log and log-odds
transformed).  Class means and covariances come from sums over all labelled training
rows, computed where the rows are; covariances are shrunk towards the pooled one and
towards a multiple of the identity.  A text's score is the posterior from the
difference of Mahalanobis log densities; the Cholesky factors are computed once and
sent with the model.

Rows: null and empty texts have the statistics of the empty text and get a score too.
Labels that are null are not used; several labels of one id count as its largest.
Repeated rows are scored each; in learning each row counts.  Rows of learning are chosen by id, never by
other columns.  With one class only, its share is the score of every text; with no
label at all the score is 0.5.  Only ``doc_id`` and ``text`` of documents are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import materialise

FEATURES = (
    "log_words", "word_length", "upper", "digits", "bangs", "symbols", "bars", "stops", "distinct",
    "same_as_previous", "top_word", "line_repeats", "ends_in_mark",
)


def odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole >= part else float(np.log(part + 1.0))


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    ws = raw.split()
    n, chars = len(ws), max(len(text), 1)
    count = Counter(ws)
    upper = len(raw.translate(None, bytes(set(range(256)) - set(range(65, 91)))))
    digits = len(raw.translate(None, bytes(set(range(256)) - set(range(48, 58)))))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(ws, ws[1:]))
    marks = sum(w[-1:] in b"!#*$%&|" for w in ws)
    return [
        float(np.log1p(n)),
        float(np.log1p(len(raw) / max(n, 1))),
        odds(upper, chars),
        odds(digits, chars),
        odds(raw.count(b"!"), chars),
        odds(symbols, chars),
        odds(raw.count(b"|"), chars),
        odds(raw.count(b".") + raw.count(b","), chars),
        odds(len(count), n),
        odds(same, n),
        odds(max(count.values(), default=0), n),
        odds(len(lines) - len(set(lines)), len(lines)),
        odds(marks, n),
    ]


def statistics(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([features(t) for t in s], dtype=object)

    return run(text)


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class, from (y, x): one partial row per batch and class."""
    d = len(FEATURES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, g in pdf.groupby("y"):
                x = np.stack(g["x"].to_numpy())
                yield pd.DataFrame({"y": [int(y)], "m": [np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])]})

    parts = rows.mapInPandas(partial, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v"))
    out = {}
    # one number per class and moment: their count is fixed by the number of features
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["y"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return {y: (m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)) for y, m in out.items()}


class Discriminant:
    def __init__(self, by_class: dict, to_pooled: float = 0.1, to_identity: float = 0.05):
        total = sum(m[0] for m in by_class.values())
        self.share = by_class[1][0] / total if 1 in by_class and total else (0.0 if total else 0.5)
        self.parts = []
        if not {0, 1} <= set(by_class):
            return
        n = {y: m[0] for y, m in by_class.items()}
        mean = {y: m[1] / m[0] for y, m in by_class.items()}
        cov = {y: m[2] / m[0] - np.outer(mean[y], mean[y]) for y, m in by_class.items()}
        pooled = sum(n[y] * cov[y] for y in (0, 1)) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        for y in (0, 1):
            c = ((1 - to_pooled) * cov[y] + to_pooled * pooled) / np.outer(self.scale, self.scale)
            c = (1 - to_identity) * c + to_identity * np.trace(c) / len(c) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.parts.append((mean[y], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n[y] / total))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        density = []
        for mean, whiten, half_log_det, log_share in self.parts:
            z = ((x - mean) / self.scale) @ whiten.T
            density.append(log_share - half_log_det - 0.5 * (z * z).sum(1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def posterior(x: Column, model: Discriminant, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(sent.value.scores(np.stack(s.to_numpy()))) if len(s) else pd.Series([], dtype=float)

    return run(x)


def labelled(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """One row per labelled id: (doc_id, y)."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
    return rows.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> DataFrame:
    """doc_id, x (statistics) and score for each row; ``learn`` (over doc_id) chooses the labelled rows used."""
    spark = docs.sparkSession
    stats = materialise(docs.select("doc_id", statistics(F.col("text")).alias("x")), "qda-statistics")
    rows = stats.join(labelled(labels, label, learn), "doc_id").select("y", "x")
    model = Discriminant(moments(rows))
    return stats.select("doc_id", "x", posterior(F.col("x"), model, spark).alias("score"))
