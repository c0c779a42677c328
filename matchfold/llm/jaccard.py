"""Operator 5: n-gram Jaccard join by a blocked sparse matrix product.

Documents by distinct 5-word shingles form a sparse 0/1 matrix M; M M' holds overlaps.
Blocks of columns (ranges of the shingle hash) are the units of work, and a pair can
link only if its overlap reaches bounds that follow from the two sizes alone.

1. *Size-derived column cut.*  A document of n shingles needs an overlap of ceil(t n)
   with any partner.  Of its n - ceil(t n) + l smallest hashes at least l are then
   common to both documents' cuts.  Only these columns are multiplied: blocks report which entries
   meet another document, and a document that meets too few is out.
2. For the documents left, columns are counted in full and put in one order, rare first.
   A document with fewer than ceil(t n) shared columns is out; of the others the first
   n - ceil(t n) + 1 columns in that order are kept (the pair's first common column is among them).
3. In each kept column the document with the fewest rarer columns is compared with all
   others of the column (linear in the column).  Exact overlaps give links, links give
   classes.  What is left are pairs of one column whose classes differ; only those are multiplied out,
   under the size bound and the bound that the two positions put on the overlap.

Documents with equal sets are one row of the matrix (64-bit digest of the set).  A set
that is met again in a batch is sent once, and a column met by several documents of a
batch is sent once, so neither copies nor common passages pile up in one block.

Rows: null text, or no words: empty set, linked with nothing.  Fewer than five words:
the whole sequence is the one shingle.  Every input row is returned; repeated rows
have equal sets and are linked.  Words are compared as bytes after lower-casing A-Z;
shingles are known by 64-bit hashes.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchfold.llm.common import BROADCAST_KEYS, boxed, cuts, frames, keys_join, materialise, mix, planes, release, shuffle_partitions, unplanes
from matchfold.llm.interpolation import Hashes

WIDTH = 5
THRESHOLD = 75  # percent
ROWS = 2000  # documents that a worker turns into columns at a time
EXTRA = 5  # percent of a document's shingles that the first cut takes beyond the least


def need(n, threshold: int = THRESHOLD):
    """Least overlap with any partner: ceil(t n)."""
    return -(-threshold * n // 100)


def extra(n, share: int = EXTRA):
    return np.maximum(1, share * n // 100)


class Shingler:
    def __init__(self, width: int = WIDTH, cached: int = 200_000):
        self.width, self.cached, self.hashes = width, cached, Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        ws = (text or "").encode("utf-8", "replace").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > self.cached:
            self.hashes.clear()
        a = np.fromiter(map(self.hashes.__getitem__, ws), np.uint64, len(ws))
        m = max(1, len(a) - self.width + 1)
        h = np.full(m, len(a) if len(a) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(a))):
            h = mix(h + a[k : k + m])
        return np.unique(h)


def digest(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def first_cut(blocks: int, threshold: int):
    """Entries of the cut by block, and one member row per document (carried in the same rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        shingles, turn = Shingler(), 0
        for pdf in frames(batches, ROWS):
            ids, keys, digests, sizes, hits, cols, rows, place = [], [], [], [], {}, [], [], {}
            for doc_id, key, text in zip(pdf["doc_id"], pdf["key"], pdf["text"]):
                h = shingles(text)
                d = digest(h)
                ids.append(doc_id)
                keys.append(key)
                digests.append(d)
                sizes.append(len(h))
                if len(h) and d not in place:
                    place[d] = len(digests) - 1
                    n = len(h)
                    cut = h[: n - need(n, threshold) + int(extra(n))]
                    cols.append(cut)
                    rows.append(np.full(len(cut), d, np.int64))
            col = np.concatenate(cols) if cols else np.zeros(0, np.uint64)
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            fresh = np.ones(len(col), bool)
            fresh[1:] = col[1:] != col[:-1]
            shared = ~fresh
            shared[:-1] |= ~fresh[1:]
            # a column met twice here: its documents have a hit, and one unnamed entry is sent
            met, n_met = np.unique(row[shared], return_counts=True)
            hits = dict(zip(met.tolist(), n_met.tolist()))
            row = np.where(shared, 0, row)
            col, row = col[fresh], row[fresh]
            counts = [hits.get(d, 0) if place.get(d) == i else 0 for i, d in enumerate(digests)]
            out = [(b, planes(col[s]), row[s].tobytes(), None, None, None, None, None) for b, s in cuts(col, blocks)]
            turn = (turn + 1) % blocks
            out.append((turn, None, None, ids, keys, digests, sizes, counts))
            yield pd.DataFrame(out, columns=["block", "cols", "rows", "ids", "keys", "digests", "sizes", "hits"])
            del pdf, out, col, row, cols, rows, order
            release()

    return run


CUT = "block int, cols binary, rows binary, ids array<string>, keys array<long>, digests array<long>, sizes array<int>, hits array<long>"
MEMBER = "doc_id string, key long, digest long, n int, hits long"


def meetings(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of the product: for each document the entries that meet another document."""
    release()
    parts = []
    entries = pdf[pdf["cols"].notna()]
    if len(entries):
        col = np.concatenate([unplanes(b, np.uint64) for b in entries["cols"]])
        row = np.concatenate([np.frombuffer(b, np.int64) for b in entries["rows"]])
        order = np.lexsort((row, col))
        col, row = col[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        differs = np.concatenate([[False], (col[1:] == col[:-1]) & (row[1:] != row[:-1])])
        met = np.add.reduceat(differs, start) > 0
        unnamed = np.logical_or.reduceat(row == 0, start)
        hit = np.repeat(met | unnamed, np.diff(np.append(start, len(col)))) & (row != 0)
        who, n = np.unique(row[hit], return_counts=True)
        # rows are in no order that matters; the ids of members are text, null for hits
        parts.append(pd.DataFrame({"doc_id": None, "key": pd.array([None] * len(who), "Int64"), "digest": who, "n": pd.array([None] * len(who), "Int32"), "hits": n}))
    for _, r in pdf[pdf["cols"].isna()].iterrows():
        parts.append(pd.DataFrame({"doc_id": list(r["ids"]), "key": pd.array(r["keys"], "Int64"), "digest": r["digests"], "n": pd.array(r["sizes"], "Int32"), "hits": r["hits"]}))
    return pd.concat(parts)


def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    shingles = Shingler()
    for pdf in frames(batches, ROWS):
        seen: dict = {}
        for text in pdf["text"]:
            h = shingles(text)
            if len(h):
                seen.setdefault(digest(h), h)
        yield pd.DataFrame({"digest": list(seen), "n": [len(h) for h in seen.values()], "cols": [h.tobytes() for h in seen.values()]})
        del pdf, seen
        release()


def columns_of(blocks: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            col = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["cols"]])
            row = np.repeat(pdf["digest"].to_numpy(np.int64), pdf["n"].to_numpy())
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            yield pd.DataFrame([(b, planes(col[s]), row[s].tobytes()) for b, s in cuts(col, blocks)], columns=["block", "cols", "rows"])
            del pdf, col, row, order
            release()

    return run


def shared_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of a block whose column has two or more documents: (digest, column, documents)."""
    release()
    col = np.concatenate([unplanes(b, np.uint64) for b in pdf["cols"]])
    row = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["rows"]])
    _, place, n = np.unique(col, return_inverse=True, return_counts=True)
    df = n[place]
    some = df > 1
    return pd.DataFrame({"digest": row[some], "col": col[some].view(np.int64), "df": df[some]})


def linked(threshold: int):
    """Of pairs with both packed sorted sets, those that link, with the size of their intersection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            sizes = []
            for p, q in zip(pdf["ca"], pdf["cb"]):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                sizes.append(int((q[at] == p).sum()) if len(q) else 0)
            both = np.array(sizes, np.int64)
            union = pdf["na"].to_numpy(np.int64) + pdf["nb"].to_numpy(np.int64) - both
            good = both * 100 >= union * threshold
            yield pd.DataFrame({"a": pdf["a"][good], "b": pdf["b"][good], "both": both[good]})
            del pdf
            release()

    return run


def classes(links: DataFrame, name: str) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for every id that has a link.

    Each round takes the smallest label among neighbours and then follows that label
    once more, so paths halve; rounds are stored and end when nothing changes.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(edges, f"{name}-edges")
    label = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("label").alias("near"))
        hop = label.join(near, label["id"] == near["a"], "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("hop"))
        far = label.select(F.col("id").alias("_i"), F.col("label").alias("far"))
        now = hop.join(far, hop["hop"] == far["_i"], "left").select("id", "was", F.least("hop", "far").alias("label"))
        now = materialise(now, f"{name}-labels")
        if now.where("was != label").isEmpty():
            return now.select("id", "label")
        label = now.select("id", "label")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int, name: str) -> DataFrame:
    """Pairs (a, b) whose exact overlap reaches the threshold of their union.

    One Python step takes and tests the overlaps: as a column that is both tested and
    returned, the planner would compute it twice, in two workers a task."""
    left = sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("cols").alias("ca"))
    right = sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("cols").alias("cb"))
    both = pairs.join(right, "b").join(left, "a")
    return materialise(both.mapInPandas(linked(threshold), "a long, b long, both int"), name)


def link_classes(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, labels): members has doc_id (as text), key, digest and n for each row of
    ``docs`` (key: xxhash64 of id and text); labels has the class label of each digest that is linked to another."""
    spark = docs.sparkSession
    blocks = shuffle_partitions(spark)
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), key.alias("key"), "text")
    cut = rows.mapInPandas(first_cut(blocks, threshold), CUT)
    met = materialise(cut.groupBy("block").applyInPandas(meetings, MEMBER), "jac-meetings")
    members = met.where("key is not null")

    per_set = met.groupBy("digest").agg(F.sum("hits").alias("hits"), F.max("n").alias("n"), F.min("key").alias("key"))
    least = F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * F.ceil(F.lit(threshold) * F.col("n") / 100) / 100))
    left = materialise(per_set.where((F.col("n") > 0) & (F.col("hits") >= least)).select("key"), "jac-left")
    texts = keys_join(rows, left, ["key"]).select("text")
    sets = materialise(texts.mapInPandas(sets_of, "digest long, n int, cols binary").dropDuplicates(["digest"]), "jac-sets")

    # columns of the documents left, rare first; a column of one document only counts towards positions
    cols = sets.mapInPandas(columns_of(blocks), "block int, cols binary, rows binary")
    shared = cols.groupBy("block").applyInPandas(shared_entries, "digest long, col long, df int")
    least = F.ceil(F.lit(threshold) * F.col("n") / 100)
    own = Window.partitionBy("digest")
    ordered = shared.withColumn("m", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("df", "col")) - 1)
    ordered = ordered.join(sets.select("digest", "n"), "digest").where((F.col("m") >= least) & (F.col("i") <= F.col("m") - least))
    entries = ordered.select("digest", "n", (F.col("n") - F.col("m") + F.col("i")).cast("int").alias("pos"), "col")
    entries = materialise(entries, "jac-entries")

    def may_link(na, pa, nb, pb) -> Column:
        # overlap <= 1 + what follows the first common column, and >= t / (1 + t) of both sizes
        most = F.least(na - pa, nb - pb)
        return most * (100 + threshold) >= (na + nb) * threshold

    centre = entries.groupBy("col").agg(F.min(F.struct("pos", "n", "digest")).alias("c"), F.count("*").alias("k"))
    centre = centre.where("k > 1").select("col", F.col("c.digest").alias("a"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa"))
    pairs = entries.withColumnRenamed("digest", "b").join(centre, "col")
    pairs = pairs.where((F.col("a") != F.col("b")) & may_link(F.col("na"), F.col("pa"), F.col("n"), F.col("pos")))
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jac-pairs")
    links = verified(pairs, sets, threshold, "jac-links")
    label = classes(links, "jac")

    marked = entries.join(label.withColumnRenamed("id", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    marked = materialise(marked, "jac-marked")
    mixed = marked.groupBy("col").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("col")
    rest = materialise(marked.join(mixed, "col", "left_semi"), "jac-rest")
    a, b = (rest.withColumnsRenamed({"digest": s, "n": f"n{s}", "pos": f"p{s}", "label": f"l{s}"}) for s in "ab")
    more = a.join(b, "col").where((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    more = materialise(more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "jac-pairs")
    again = verified(more, sets, threshold, "jac-links")
    if not again.isEmpty():
        label = classes(links.unionByName(again), "jac")
    return members, label


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for each row."""
    members, label = link_classes(docs, threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = members.select(F.col("doc_id").cast(kind).alias("doc_id"), "digest", F.col("n").cast("long").alias("n_shingles"))
    full = rows.where("n_shingles > 0").join(label.withColumnRenamed("id", "digest"), "digest", "left")
    full = materialise(full.select("doc_id", "n_shingles", F.coalesce("label", "digest").alias("label")), "jac-members")
    # stored first, so that the join is a stage of its own and a class of very many copies can be split
    smallest = full.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1")
    smallest = materialise(smallest.select("label", "least"), "jac-least")
    out = keys_join(full, smallest, ["label"], "left", limit=200_000)
    # a class whose ids are all null has no smallest one
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each class: the one with the smallest key (a hash of id and text)
    among those with the smallest doc_id; documents with empty sets all stay."""
    members, label = link_classes(docs, threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = members.where("n > 0").select(F.col("doc_id").cast(kind).alias("doc_id"), "key", "digest")
    full = full.join(label.withColumnRenamed("id", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    full = materialise(full, "jac-members")
    stay = full.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("s"), F.count("*").alias("k"))
    stay = materialise(stay.where("k > 1").select("label", F.col("s.key").alias("stay")), "jac-stay")
    gone = keys_join(full, stay, ["label"], "inner", limit=200_000).where("key != stay").select("doc_id", "key").distinct()
    # rows that agree in id and text have one key: all but one go as well
    again = materialise(full.groupBy("doc_id", "key").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "key"), "jac-again")
    rows = boxed(docs, id=F.col("doc_id"), key=F.xxhash64("doc_id", "text"))

    def by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = keys.limit(BROADCAST_KEYS // 2 + 1).count() <= BROADCAST_KEYS // 2
        keys = keys.withColumnsRenamed({"doc_id": "key_id", "key": "key_of"})
        # by id and hash: two texts of one id would have to share the hash
        return rows.join(F.broadcast(keys) if few else keys.hint("merge"), F.col("id").eqNullSafe(F.col("key_id")) & (F.col("key") == F.col("key_of")), how)

    rows = by_key(rows, materialise(gone, "jac-gone"), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    twice = by_key(rows, again, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return by_key(rows, again, "left_anti").select("row.*").unionByName(twice.select("row.*"))
