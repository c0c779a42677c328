"""Operator 8: toxicity by nearest labelled examples.

A bounded sample of labelled rows (``max_examples`` of each class, by smallest hash of
the id) gives the examples.  Terms are words and word starts of four letters (with levels of count), all those of
the sample, with TF-IDF weights times their tie to the label: the square of how far the
log odds of the label given the term exceed one standard error of theirs.  A term of a
few rows, all of one label, counts however large the sample is; one whose odds are those
of chance weighs nothing.  Examples are held as posting lists, with the
largest weight of each term in each block of examples.  For a text, lists are read from the
term that can add most to a cosine downwards, until the block maxima of the terms not yet
read leave few examples that can reach the k-th best sum; their cosines are finished from
their own terms: the neighbours are exact.  Votes are weighted by similarity and by what a
sampled example of its class stands for, with a share of the prior, so scores are
calibrated to the labelled rows.  The neighbours are returned as evidence.

Rows: null and empty texts, and texts without any tied term, have no neighbour and get the
prior.  Null labels are not used; several labels of an id count as its largest.  Ties
in similarity go to the example that comes first by (id, text hash).  Whole texts are
read.  Documents of any length and count are scored; only the sample is bounded.
Without labels the score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import materialise, release
from matchfold.llm.qda import labelled

#: Labelled rows of each class that the examples are drawn from.
MAX_EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 64
PRIOR_WEIGHT = 0.3
#: A vote's weight is its cosine to this power: chance likeness on one weak term counts for little.
POWER = 3

#: A word start met so often is one more term.
LEVELS = (2, 4, 8)

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Words in lower case, and "^" with the first four letters of longer ones.

    A word start met 2, 4 or 8 times is one more term for each level: the cosine of a
    text with one term would not show how often it occurs.
    """
    out: dict[str, int] = dict(Counter(_WORD.findall((text or "").lower())))
    starts: dict[str, int] = {}
    for w, n in out.items():
        w = "^" + w[:4]
        starts[w] = starts.get(w, 0) + n
    out.update(starts)
    for w, n in starts.items():
        for level in LEVELS:
            if n >= level:
                out[f"{w}*{level}"] = 1
    return Counter(out)


class Examples:
    """A block-max inverted index over the labelled examples."""

    def __init__(
        self, vectors: list[Counter], labels: list[int], vocabulary: list[str], shares: dict[int, float], block: int = BLOCK, ties: list[float] | None = None
    ):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.labels = np.array(labels, int)
        n = len(vectors)
        rows = Counter(t for v in vectors for t in v)
        self.idf = np.array([np.log((1 + n) / (1 + rows[t])) + 1 for t in vocabulary])
        if ties is not None:
            self.idf *= np.array(ties)
        sampled = Counter(labels)
        self.prior = shares.get(1, 0.0)
        self.stands_for = np.array([shares.get(y, 0.0) * n / max(sampled.get(y, 0), 1) for y in (0, 1)])
        found = [self.weights(v) for v in vectors]
        term = np.array([t for v in found for t in v], np.int64)
        doc = np.array([d for d, v in enumerate(found) for _ in v], np.int64)
        val = np.array([w for v in found for w in v.values()], float)
        # by example: finishes the cosine of a candidate
        self.ends = np.searchsorted(doc, np.arange(n + 1))
        self.terms, self.weight = term.astype(np.int32), val
        # by term: posting lists, and the largest weight of a term in each block and in all
        order = np.lexsort((doc, term))
        self.docs, self.vals = doc[order].astype(np.int32), val[order]
        self.starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.blocks = -(-n // block)
        self.block_of = np.arange(n) // block
        top = np.zeros((len(vocabulary), self.blocks), np.float32)
        np.maximum.at(top, (term, doc // block), val.astype(np.float32))
        self.top = top
        self.most = top.max(1, initial=0).astype(float)

    def weights(self, counts: dict[str, int]) -> dict[int, float]:
        """Unit TF-IDF vector over the vocabulary."""
        known = sorted((self.number[t], c) for t, c in counts.items() if t in self.number)
        return dict(zip([t for t, _ in known], self.unit(np.array([t for t, _ in known], np.int64), np.array([c for _, c in known], float)).tolist()))

    def unit(self, ts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[ts]
        return v / (v @ v) ** 0.5 if len(v) else v

    def nearest(self, q: dict[int, float], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, ties to the smaller number."""
        sims, ids = self.search(np.fromiter(q, np.int64, len(q)), np.fromiter(q.values(), float, len(q)), k)
        return list(zip(sims.tolist(), ids.tolist()))

    def search(self, ts: np.ndarray, ws: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Posting lists are read from the term that can add most to a cosine downwards.

        After each helping the k-th best sum so far is a bound from below, and what the terms not yet
        read can add in a block, by the block's largest weights, one from above.  Once few
        examples can still be among the k best, their cosines are taken from their own terms.
        """
        n = len(self.labels)
        if not len(ts) or not n:
            return np.zeros(0), np.zeros(0, np.int64)
        add = ws * self.most[ts]
        order = np.argsort(-add, kind="stable")
        ts, ws = ts[order], ws[order]
        left = np.append(np.cumsum(add[order][::-1])[::-1], 0.0)
        sums, done, share = np.zeros(n), 0, 0.4
        while done < len(ts):
            upto = len(ts) if share < 0.01 else max(done + 1, int(np.searchsorted(-left, -share * left[0])))
            upto = min(upto, len(ts))
            part = ts[done:upto]
            start = self.starts[part]
            size = self.starts[part + 1] - start
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            sums += np.bincount(self.docs[at], np.repeat(ws[done:upto], size) * self.vals[at], n)
            done, share = upto, share / 2
            if done < len(ts) and n > k:
                least = np.partition(sums, n - k)[n - k]
                if least > 0:
                    # block maxima are of single precision: an example that could tie is still taken
                    rest = (ws[done:] @ self.top[ts[done:]])[self.block_of]
                    able = np.flatnonzero(sums + rest >= least - 1e-6)
                    if len(able) <= max(4 * k, n // 32):
                        return self.best(able, self.cosines(able, ts, ws), k)
        hit = np.flatnonzero(sums)
        return self.best(hit, sums[hit], k)

    def cosines(self, examples: np.ndarray, ts: np.ndarray, ws: np.ndarray) -> np.ndarray:
        q = np.zeros(len(self.most))
        q[ts] = ws
        start = self.ends[examples]
        size = self.ends[examples + 1] - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(np.repeat(np.arange(len(examples)), size), self.weight[at] * q[self.terms[at]], len(examples))

    @staticmethod
    def best(examples: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        sims = np.round(sims, 9)
        examples, sims = examples[sims > 0], sims[sims > 0]
        first = np.lexsort((examples, -sims))[:k]
        return sims[first], examples[first]

    def score(self, near: list[tuple[float, int]]) -> float:
        votes = [(s**POWER * self.stands_for[self.labels[i]], self.labels[i]) for s, i in near]
        weight = sum(w for w, _ in votes)
        return float((sum(w for w, y in votes if y) + PRIOR_WEIGHT * self.prior) / (weight + PRIOR_WEIGHT))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_examples: int = MAX_EXAMPLES) -> tuple[Examples, list]:
    """The index and the ids of its examples, from rows that ``learn`` (over doc_id) admits."""
    known = materialise(labelled(labels, label, learn), "tox-labels")
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = {y: n / sum(size.values()) for y, n in size.items()}
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = materialise(drawn, "tox-sample")
    # at most 2 * max_examples ids
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = materialise(rows, "tox-examples")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            seen: Counter = Counter()
            for text, y in zip(pdf["text"], pdf["y"]):
                seen.update((t, y) for t in terms(text))
            yield pd.DataFrame({"term": [t for t, _ in seen], "y": [y for _, y in seen], "n": list(seen.values())})

    got = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = got.get(1, 0), got.get(0, 0)
    if not pos + neg:
        return Examples([], [], [], {}), []
    by_term = rows.mapInPandas(bags, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    ties: dict[str, float] = {}
    if pos and neg:
        # one row's worth of chance is added to each count; a single label ties no term
        p = pos / (pos + neg)
        a, b = F.col("a") + F.lit(p), F.col("b") + F.lit(1 - p)
        excess = F.abs(F.log(a / b) - F.lit(float(np.log(pos / neg)))) - F.sqrt(1 / a + 1 / b)
        # bounded: terms of the sample's rows
        tied = by_term.withColumn("excess", excess).where("excess > 0").orderBy("term")
        ties = {r["term"]: r["excess"] ** 2 for r in tied.select("term", "excess").collect()}
    vocabulary = list(ties)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        known = set(vocabulary)
        for pdf in batches:
            out = [{t: n for t, n in terms(text).items() if t in known} for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "tf": [",".join(f"{t}={n}" for t, n in sorted(v.items())) for v in out]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    # bounded: rows of the sample, terms of the vocabulary
    found = rows.mapInPandas(vectors, f"doc_id {kind}, y int, tf string").orderBy("tf", "doc_id").collect()
    bags_ = [Counter({t: int(n) for t, n in (x.split("=") for x in r["tf"].split(",") if x)}) for r in found]
    return Examples(bags_, [r["y"] for r in found], vocabulary, shares, ties=list(ties.values())), [r["doc_id"] for r in found]


class Terms(dict):
    """Terms of texts by their numbers in an index; each word is looked up once."""

    MOST = 300_000

    def __init__(self, index: Examples):
        super().__init__()
        self.index, self.starts = index, {}
        self.word_term = np.zeros(1024, np.int32)
        self.start_of = np.zeros(1024, np.int32)
        self.start_terms = np.zeros((1024, 1 + len(LEVELS)), np.int32)

    def __missing__(self, word: str) -> int:
        i, number = len(self), self.index.number
        if i == len(self.word_term):
            self.word_term, self.start_of = np.append(self.word_term, self.word_term), np.append(self.start_of, self.start_of)
        start = "^" + word[:4]
        j = self.starts.get(start)
        if j is None:
            j = self.starts[start] = len(self.starts)
            if j == len(self.start_terms):
                self.start_terms = np.concatenate([self.start_terms, self.start_terms])
            self.start_terms[j] = [number.get(t, -1) for t in (start, *(f"{start}*{level}" for level in LEVELS))]
        self.word_term[i], self.start_of[i] = number.get(word, -1), j
        self[word] = i
        return i

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms of a text, as ``Examples.weights`` of ``terms``."""
        if len(self) > self.MOST:
            self.clear()
            self.starts.clear()
        words = _WORD.findall((text or "").lower())
        found, n = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), return_counts=True)
        starts, place = np.unique(self.start_of[found], return_inverse=True)
        m = np.bincount(place, n, len(starts)) if len(found) else np.zeros(0)
        st = self.start_terms[starts]
        ts, counts = [self.word_term[found], st[:, 0]], [n, m]
        for i, level in enumerate(LEVELS):
            often = m >= level
            ts.append(st[often, 1 + i])
            counts.append(np.ones(often.sum()))
        t, c = np.concatenate(ts).astype(np.int64), np.concatenate(counts).astype(float)
        t, c = t[t >= 0], c[t >= 0]
        return t, self.index.unit(t, c)


SCHEMA = "score double, neighbours array<string>, similarities array<double>"


def toxicity(text: Column, index: Examples, ids: list, spark, k: int = NEIGHBOURS) -> Column:
    """score, and the nearest examples (ids as text, cosines) as evidence."""
    sent = spark.sparkContext.broadcast((index, [str(i) for i in ids]))

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        idx, names = sent.value
        known = Terms(idx)
        for s in batches:
            out = []
            for text in s:
                sims, near = idx.search(*known.vector(text), k)
                sims, near = sims.tolist(), near.tolist()
                out.append((idx.score(list(zip(sims, near))), [names[i] for i in near], sims))
            yield pd.DataFrame(out, columns=["score", "neighbours", "similarities"])
            del s, out
            release()
        del known
        release()

    return run(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """``docs`` with score, neighbours and similarities; columns of these names are replaced."""
    index, ids = fit(docs, labels, learn, **options)
    out = docs.withColumn("_tox", toxicity(F.col("text"), index, ids, docs.sparkSession))
    for c in ("score", "neighbours", "similarities"):
        out = out.withColumn(c, F.col(f"_tox.{c}"))
    return out.drop("_tox")
