"""Operator 3: language-model scoring by deleted interpolation.

    p(w | h) = a_b f(w | h) + b_b f(w) + c_b / (V + 1),   b = bucket of the count of h

f are maximum-likelihood estimates from all training tokens.  The mixture weights of
each context-frequency bucket are learned by expectation-maximisation on held-out
counts: for the tokens of the ``tune`` rows (a part of the training rows) each token is
taken out of the counts it is scored with.

Scale.  Documents are dealt to chunks by a hash.  A chunk sends each distinct word and
word pair once, with its count, to the block that owns that range of keys, packed and
sorted; blocks send the corpus totals back in the same order.  So a key as common as
"the" costs one entry per chunk, no table of n-grams is broadcast, and the counts of
the whole corpus are used.  Chunks and blocks follow the session's number of shuffle
partitions.  Chunk texts travel compressed.  Words and pairs are known by 64-bit hashes.

Rows: a null or empty text is one end token.  Lower-casing is of A-Z only.  A repeated
row counts and is scored each time.  Long texts count whole.  Without training rows N
and V are 0 and all mass is uniform.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import cuts, materialise, mix, planes, release, shuffle_partitions, unplanes

START, END = np.uint64(0x5B8D1F02A3C4E697), np.uint64(0xC2E1974D60B5A38F)
BUCKETS = 40
STEPS = 4  # histogram steps per power of two
#: A chunk's tokens and their keys are in one Python worker's memory at a time.
CHUNKS_PER_PARTITION = 2
SPAN = 64  # powers of two a ratio may span


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def pack(batches: Iterator) -> Iterator:
    """Rows of (doc_id, text, train, chunk) as one compressed Arrow stream per batch and chunk."""
    import pyarrow as pa
    import pyarrow.compute as pc

    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        release()
        t = pa.Table.from_batches([b])
        t = t.take(pc.sort_indices(t["chunk"]))
        chunk = t["chunk"].to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for i, j in zip(edge, edge[1:]):
            if i < j:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema.remove(3), options=options) as w:
                    w.write_table(t.slice(i, j - i).drop_columns(["chunk"]))
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[i])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "blob"])


class Chunk:
    """Tokens of a chunk's documents: word, context and pair keys, and the document of each token."""

    def __init__(self, blobs):
        import pyarrow as pa

        hashes, self.ids, train, words = Hashes(), [], [], []
        for blob in blobs:
            t = pa.ipc.open_stream(blob).read_all()
            self.ids += t["doc_id"].to_pylist()
            train += t["train"].to_pylist()
            for text in t["text"]:
                ws = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                a = np.empty(len(ws) + 1, np.uint64)
                a[:-1] = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
                a[-1] = END
                words.append(a)
        self.lengths = np.array([len(a) for a in words], np.int64)
        self.doc = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths)
        self.train = np.array(train, bool)[self.doc]
        self.word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        del words, hashes
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[np.cumsum(self.lengths)[:-1]] = START
        context[:1] = START
        self.context = context

    def keys(self, kind: int) -> np.ndarray:
        return self.word if kind == 0 else mix(self.context + mix(self.word))

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and for each token the place of its key."""
        return np.unique(self.keys(kind), return_inverse=True)


def requests(blocks: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        c, out = Chunk(pdf["blob"]), []
        for kind in (0, 1):
            keys, place = c.distinct(kind)
            n = np.bincount(place, weights=c.train, minlength=len(keys)).astype(np.uint32)
            out += [(kind, b, int(key[0]), planes(keys[s]), planes(n[s])) for b, s in cuts(keys, blocks)]
        return pd.DataFrame(out, columns=["kind", "block", "chunk", "keys", "counts"])

    return run


def totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus totals of a block's keys, returned to each chunk in the order of its request."""
    release()
    keys = [unplanes(b, np.uint64) for b in pdf["keys"]]
    own = np.concatenate([unplanes(b, np.uint32) for b in pdf["counts"]]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(distinct), np.int64)
    np.add.at(n, place, own)
    back, at = n[place], 0
    out = []
    for i, (chunk, kind, block) in enumerate(zip(pdf["chunk"], pdf["kind"], pdf["block"])):
        first = i == 0 and kind == 0
        out.append((chunk, kind, block, planes(back[at : at + len(keys[i])]), int(n.sum()) if first else 0, int((n > 0).sum()) if first else 0))
        at += len(keys[i])
    return pd.DataFrame(out, columns=["chunk", "kind", "block", "totals", "n", "v"])


def counted(c: Chunk, answers: pd.DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of each token's word, context and pair."""
    got = []
    for kind in (0, 1):
        a = answers[answers["kind"] == kind].sort_values("block")
        n = np.concatenate([unplanes(b, np.int64) for b in a["totals"]])
        _, place = c.distinct(kind)
        got.append(n[place])
    word, pair = got
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[c.context == START] = n_docs  # every training document starts once
    return word, context, pair


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two its count reaches; counts above 2^38 share the last."""
    return np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def parts(word, context, pair, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    return (
        np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0),
        word / n if n else np.zeros(len(word)),
        1.0 / (v + 1),
    )


def step(p: np.ndarray, base: float) -> np.ndarray:
    """Histogram step of a ratio to the uniform part; 0 for no mass."""
    s = np.zeros(len(p), np.int64)
    some = p > 0
    s[some] = np.clip(np.round(np.log2(p[some] / base) * STEPS) + SPAN * STEPS // 2, 1, SPAN * STEPS)
    return s


def evidence(n: int, v: int, n_docs: int):
    """How often each (bucket, pair step, word step) occurs in a chunk, each token out of its own counts."""

    def run(key, blobs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release()
        c = Chunk(blobs["blob"])
        word, context, pair = (np.maximum(x - 1, 0) for x in counted(c, answers, n_docs))
        p2, p1, p0 = parts(word, context, pair, n - 1, v)
        size = SPAN * STEPS + 1
        code = (bucket(context) * size + step(p2, p0)) * size + step(p1, p0)
        code, count = np.unique(code, return_counts=True)
        return pd.DataFrame({"code": code, "n": count})

    return run


def weights_by_em(code: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket."""
    size = SPAN * STEPS + 1
    out = np.tile([0.3, 0.4, 0.3], (BUCKETS, 1))
    ratio = lambda s: np.where(s > 0, 2.0 ** ((s - SPAN * STEPS // 2) / STEPS), 0.0)
    f = np.stack([ratio(code // size % size), ratio(code % size), np.ones(len(code))], 1)
    b = code // size // size
    f[b == 0, 0] = 0
    for _ in range(rounds):
        share = f * out[b]
        share = share / share.sum(1, keepdims=True) * count[:, None]
        total = np.zeros((BUCKETS, 3))
        np.add.at(total, b, share)
        # one count in all for each part keeps every weight above 0, and unseen buckets near the others
        total += 0.5 * share.sum(0) / max(share.sum(), 1) + 0.01
        out = total / total.sum(1, keepdims=True)
    out[0, 1:] /= out[0, 1:].sum()
    out[0, 0] = 0
    return out


def scores(n: int, v: int, n_docs: int, lam: np.ndarray):
    def run(key, blobs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release()
        c = Chunk(blobs["blob"])
        word, context, pair = counted(c, answers, n_docs)
        p2, p1, p0 = parts(word, context, pair, n, v)
        w = lam[bucket(context)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((word + 1.0) / (n + (v + 1.0)))
        docs = len(c.lengths)
        add = lambda x: np.bincount(c.doc, weights=x, minlength=docs)
        out = {"doc_id": c.ids, "n_tokens": c.lengths, "n_known": add(word > 0).astype(np.int64), "train_tokens": n, "base_score": add(base), "score": add(model)}
        return pd.DataFrame(out)

    return run


def interpolated_scores(docs: DataFrame, train: Column, tune: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``train`` and ``tune`` are conditions on the input columns; tune rows must be train rows.
    """
    spark = docs.sparkSession
    blocks = shuffle_partitions(spark)
    chunks = CHUNKS_PER_PARTITION * blocks
    deal = F.xxhash64("doc_id", F.xxhash64("text"))
    own = F.when(tune, chunks + F.pmod(deal, F.lit(max(1, chunks // 6)))).otherwise(F.pmod(deal, F.lit(chunks))).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", train.alias("train"), own.alias("chunk"))
    packed = lambda d: d.mapInArrow(pack, "chunk int, blob binary")

    asked = packed(rows).groupBy("chunk").applyInPandas(requests(blocks), "kind int, block int, chunk int, keys binary, counts binary")
    told = asked.groupBy("kind", "block").applyInPandas(totals, "chunk int, kind int, block int, totals binary, n long, v long")
    told = materialise(told, "lm-totals")
    size = told.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = size["n"] or 0, size["v"] or 0
    n_docs = docs.where(train).count()
    answers = told.select("chunk", "kind", "block", "totals")

    seen = packed(rows.where(F.col("chunk") >= chunks)).groupBy("chunk").cogroup(answers.where(F.col("chunk") >= chunks).groupBy("chunk"))
    seen = seen.applyInPandas(evidence(n, v, n_docs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # bounded by the bins of the histogram
    seen = seen.toPandas()
    lam = weights_by_em(seen["code"].to_numpy(np.int64), seen["n"].to_numpy(np.float64))

    out = packed(rows).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    out = out.applyInPandas(scores(n, v, n_docs, lam), "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
