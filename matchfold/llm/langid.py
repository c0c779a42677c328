"""Operator 2: language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm; a text's score for a language is the sum of the logs over its words plus the
language's log share.  Probabilities are learned by expectation-maximisation (expected
piece counts over all segmentations) on a bounded sample: the ``max_rows`` learning
rows of each language with the smallest hash of the id.

Rows: null texts and texts without a letter are ``und`` with score 0.  Rows of null
language, or not admitted by ``learn``, are not learned from but are scored like all
others.  Words are runs of letters in lower case; a word of any length is summed whole (above
32 letters in logarithms).  Whole texts are read.  Repeated rows give repeated
results; ties go to the first language by code point.  With nothing to learn from every
text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchfold.llm.common import keys_join, materialise, release

MAX_ROWS = 600
ROUNDS = 4
ALPHA = 0.02
UNKNOWN = 1e-7
#: Words of more letters are summed in logarithms, one at a time: their probabilities are below what a double holds.
LONG = 32
_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(model_file: str) -> list[str]:
    """The normal pieces of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Lattice:
    """All segmentations of words into pieces; a letter that is no piece is an unknown one."""

    def __init__(self, vocabulary: list[str]):
        self.number = {x: i for i, x in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        #: numbers of "no piece" and of the unknown piece, after those of the vocabulary
        self.none, self.unknown = len(vocabulary), len(vocabulary) + 1

    def spans(self, letters: int) -> list[tuple[int, int]]:
        """Every (start, end) that a piece may take in a word of so many letters, by end."""
        return [(i, j) for j in range(1, letters + 2) for i in range(max(0, j - self.longest), j)]

    def arcs(self, words: list[str]) -> np.ndarray:
        """For words of equal length: the piece number of each span (rows) of each word (columns)."""
        spans, get = self.spans(len(words[0])), self.number.get
        missing = [self.unknown if j - i == 1 else self.none for i, j in spans]
        slices = [slice(i, j) for i, j in spans]
        out = np.empty((len(words), len(spans)), np.int32)
        for k, word in enumerate(words):
            w = "▁" + word
            out[k] = [get(w[x], m) for x, m in zip(slices, missing)]
        return np.ascontiguousarray(out.T)


def equal_lengths(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Positions of words of the same length, at most so many at a time."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for _, at in sorted(by_length.items()):
        for k in range(0, len(at), most):
            yield at[k : k + most]


def forward(spans: list[tuple[int, int]], arcs: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Probability of each start of each word, all its segmentations summed; ``prob`` holds a column per language."""
    fwd = np.zeros((spans[-1][1] + 1, arcs.shape[1], prob.shape[1]))
    fwd[0] = 1.0
    for (i, j), x in zip(spans, arcs):
        fwd[j] += fwd[i] * prob[x]
    return fwd


class LongWord:
    """The lattice of one word in logarithms; columns of ``logs`` (log probabilities by piece number) are languages.

    Holds one vector per letter, so a word may have any length.
    """

    def __init__(self, lattice: Lattice, word: str, logs: np.ndarray):
        self.lattice, self.word, self.logs = lattice, "▁" + word, logs
        self.ahead = np.full((len(self.word) + 1, logs.shape[1]), -np.inf)
        self.ahead[0] = 0.0
        for j in range(1, len(self.word) + 1):
            starts, found = self.ending_at(j)
            self.ahead[j] = np.logaddexp.reduce(self.ahead[starts] + logs[found], axis=0)

    def ending_at(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of the pieces that end at j; a single letter that is none is the unknown piece."""
        get, none, unknown = self.lattice.number.get, self.lattice.none, self.lattice.unknown
        found = [(i, get(self.word[i:j], unknown if j - i == 1 else none)) for i in range(max(0, j - self.lattice.longest), j)]
        found = [(i, x) for i, x in found if x != none]
        return np.array([i for i, _ in found]), np.array([x for _, x in found])

    def total(self) -> np.ndarray:
        return self.ahead[-1]

    def wanted(self, n: float, want: np.ndarray) -> None:
        """Adds the expected number of each piece in n such words, of the first language."""
        ahead, logs = self.ahead[:, 0], self.logs[:, 0]
        back = np.full(len(ahead), -np.inf)
        back[-1] = 0.0
        for j in range(len(self.word), 0, -1):
            starts, found = self.ending_at(j)
            flow = logs[found] + back[j]
            back[starts] = np.logaddexp(back[starts], flow)
            np.add.at(want, found, n * np.exp(ahead[starts] + flow - ahead[-1]))


def learn_pieces(counts: list[tuple[str, int]], lattice: Lattice, size: int, rounds: int = ROUNDS, alpha: float = ALPHA) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over word counts."""
    p = np.full(size, 1.0 / size)
    groups = []
    long = [(w, n) for w, n in counts if len(w) > LONG]
    counts = [(w, n) for w, n in counts if len(w) <= LONG]
    for at in equal_lengths([w for w, _ in counts]):
        groups.append((lattice.spans(len(counts[at[0]][0])), lattice.arcs([counts[k][0] for k in at]), np.array([counts[k][1] for k in at], float)))
    for _ in range(rounds):
        prob, want = np.append(p, [0.0, UNKNOWN]), np.zeros(size + 2)
        for spans, arcs, n in groups:
            fwd = forward(spans, arcs, prob[:, None])[:, :, 0]
            back = np.zeros_like(fwd)
            back[-1] = np.divide(n, fwd[-1], out=np.zeros_like(n), where=fwd[-1] > 0)
            for (i, j), x in zip(reversed(spans), arcs[::-1]):
                flow = back[j] * prob[x]
                back[i] += flow
                np.add.at(want, x, fwd[i] * flow)
        if long:
            logs = np.log(np.maximum(prob, 1e-300))[:, None]
            for word, n in long:
                LongWord(lattice, word, logs).wanted(n, want)
        got = want[:size] + alpha
        p = got / got.sum()
    return p


class Languages:
    def __init__(self, names: list[str], shares: list[float], table: np.ndarray, vocabulary: list[str], cached: int = 250_000):
        self.names, self.log_share = names, np.log(np.array(shares))
        self.lattice, self.cached = Lattice(vocabulary), cached
        self.prob = np.concatenate([table, np.zeros((1, len(names))), np.full((1, len(names)), UNKNOWN)])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language, all segmentations summed."""
        out = np.empty((len(words), len(self.names)))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        logs = np.log(np.maximum(self.prob, 1e-300))
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = LongWord(self.lattice, w, logs).total()
        for at in equal_lengths([words[k] for k in short]):
            at = [short[k] for k in at]
            same = [words[k] for k in at]
            fwd = forward(self.lattice.spans(len(same[0])), self.lattice.arcs(same), self.prob)
            out[at] = np.log(np.maximum(fwd[-1], 1e-300))
        return out

    def _remember(self, words: set[str]) -> None:
        """Log probabilities of words not met before; the table starts anew when it is full."""
        if not hasattr(self, "_seen") or len(self._seen) > self.cached:
            self._seen: dict[str, int] = {}
            self._logs = np.zeros((1024, len(self.names)))
        new = sorted(words.difference(self._seen))
        size = len(self._seen)
        self._seen.update(zip(new, range(size, size + len(new))))
        if len(self._seen) > len(self._logs):
            more = np.zeros((max(len(self._logs), len(new)), len(self.names)))
            self._logs = np.concatenate([self._logs, more])
        self._logs[size : size + len(new)] = self.log_probability(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = []
        for text in texts:
            ws = letter_words(text)
            if not self.names or not any(any(map(str.isalpha, w)) for w in ws):
                ws = []
            found.append(ws)
        if any(found):
            self._remember(set().union(*found))
        return [self._best(ws) if ws else ("und", 0.0) for ws in found]

    def _best(self, ws: list[str]) -> tuple[str, float]:
        total = self.log_share + self._logs[list(map(self._seen.__getitem__, ws))].sum(0)
        post = np.exp(total - total.max())
        best = int(total.argmax())
        return self.names[best], float(post[best] / post.sum())


def by_size(texts: pd.Series, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters in all."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > most:
            yield run
            run, size = [], 0
    if run:
        yield run


def fit(docs: DataFrame, learn: Column, vocabulary: list[str], lang: str = "lang", max_rows: int = MAX_ROWS) -> Languages:
    rows = docs.where(F.col(lang).isNotNull() & learn & F.col("text").isNotNull())
    rows = rows.select(F.col(lang).alias("_lang"), "text", F.xxhash64("doc_id").alias("_h"))

    def smallest(found: DataFrame, *order: str) -> DataFrame:
        """The first rows of each language, first within each of 256 shares of the tasks: no task
        sorts more than its share of a hot language, and the last step has at most 256 * max_rows rows of it."""
        found = found.withColumn("_share", F.spark_partition_id() % 256)
        for keys in (["_lang", "_share"], ["_lang"]):
            found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= max_rows)
        return found.drop("_share", "_n")

    top = smallest(rows.select("_lang", "_h"), "_h").groupBy("_lang").agg(F.max("_h").alias("_top"))
    top = materialise(top, "lang-limits")
    shares = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    # rows that share the last id: the bound holds for them as well
    sample = smallest(keys_join(rows, top, ["_lang"], "inner").where("_h <= _top"), "_h", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, g in pdf.groupby("_lang"):
                c: Counter = Counter()
                for text in g["text"]:
                    c.update(letter_words(text))
                yield pd.DataFrame({"_lang": name, "word": list(c), "n": list(c.values())})

    by_word = sample.select("_lang", "text").mapInPandas(count, "_lang string, word string, n long").groupBy("_lang", "word").agg(F.sum("n").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        p = learn_pieces(list(zip(pdf["word"], pdf["n"])), Lattice(vocabulary), len(vocabulary))
        return pd.DataFrame({"_lang": [pdf["_lang"].iloc[0]], "p": [p]})

    # one row per language, as long as the fixed vocabulary
    got = {r["_lang"]: r["p"] for r in by_word.groupBy("_lang").applyInPandas(solve, "_lang string, p array<double>").collect()}
    names = sorted(got)
    table = np.array([got[x] for x in names]).T if names else np.zeros((len(vocabulary), 0))
    total = sum(shares.values()) or 1
    return Languages(names, [shares[x] / total for x in names], np.ascontiguousarray(table), vocabulary)


def identified(text: Column, model: Languages, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        m = sent.value
        for s in batches:
            yield pd.DataFrame([x for run in by_size(s) for x in m.predict(run)], columns=["lang_pred", "score"])
            del s
            release()

    return run(text)


def identify_languages(docs: DataFrame, learn: Column, model_file: str, **options) -> DataFrame:
    """doc_id, lang_pred and score for each row; ``learn`` (over doc_id) admits rows to learning."""
    model = fit(docs, learn, pieces(model_file), **options)
    return docs.select("doc_id", identified(F.col("text"), model, docs.sparkSession).alias("_l")).select("doc_id", "_l.*")
