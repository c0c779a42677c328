"""Operator 12: spelling variants by blocked Gram matrices.

Words are counted over whole texts (a share of the runs, fixed by a checksum of document and
run, loses one letter first).  Two words are near if one inserted, deleted or replaced letter
turns one into the other.  Near words have letter counts whose squared distance is at most
two, so pairs are found by NumPy products of letter-count blocks:

    |x - y|^2 = |x|^2 + |y|^2 - 2 x.y

Blocks are made by length and, within a length, by how many letters a word has of each of a
few letter groups (its cell).  One edit changes these counts by at most two in all, so a cell
meets only cells of its own length or of the next one whose counts differ that little.  Cells
of many words are cut into chunks of ``CHUNK`` words; a chunk is the left side of a product,
and the chunks it meets stream by, gathered up to ``PARTNERS`` words at a time.  Pairs at
distance two or less are verified letter by letter.  A task returns for each word how many
near words it saw and the best of them, not the pairs.

A word's form is its most frequent near word if that is at least twice as frequent; counts
double along a chain of forms, so chains are short, and roots are found by a few rounds of
pointer doubling over stored tables.

Rows: a null text has no words; a null id counts as the empty text; repeated rows count each.
Only ``doc_id`` and ``text`` are read.  Texts and words of any length are taken whole.  Ties
between forms go to the first in code-point order.  An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import keys_join, materialise, release

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
MIN_LETTERS, MIN_COUNT = 5, 3
#: A run loses a letter where this number divides its checksum.
SPOILED = 97
#: Words held by a counting worker before it hands its counts on.
HELD = 250_000
CHUNK, PARTNERS = 1024, 4096
GROUPS = 6

# Letters of Latin script, about by frequency; dealt to the groups in turn.  Any other
# order gives the same result, with cells of other sizes.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
LETTERS = BY_FREQUENCY + "".join(map(chr, range(0xC0, 0x100)))
LETTER_GROUPS = [LETTERS[i::GROUPS] for i in range(GROUPS)]

# one zero byte appended to a text changes its (unfinished) checksum c to (c >> 8) ^ ZERO[c & 255]
ZERO = np.arange(256, dtype=np.uint32)
for _ in range(8):
    ZERO = np.where(ZERO & 1, (ZERO >> np.uint32(1)) ^ np.uint32(0xEDB88320), ZERO >> np.uint32(1)).astype(np.uint32)
#: Longer words' checksums are taken one by one.
TABLED = 48


def shifted(sums: np.ndarray) -> np.ndarray:
    """Checksums as they enter that of a text of 0, 1, ... TABLED - 1 more bytes."""
    out = [sums.astype(np.uint32)]
    for _ in range(TABLED - 1):
        out.append((out[-1] >> np.uint32(8)) ^ ZERO[out[-1] & np.uint32(255)])
    return np.stack(out)


class Words(dict):
    """Numbers of runs as written; ``words`` has the lower-cased word of each number."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []
        self.sums: list[int] = []
        self.sizes: list[int] = []
        self.numbers: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        word = run.translate(_LOWER)
        n = self.numbers.get(word)
        if n is None:
            n = self.numbers[word] = len(self.words)
            raw = word.encode()
            self.words.append(word)
            self.sums.append(zlib.crc32(raw))
            self.sizes.append(len(raw))
        self[run] = n
        return n


class Counts:
    """Counts of words over (id, text) rows; ``drain`` hands them out."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known, self.n, self.other = Words(), np.zeros(0, np.int64), {}

    def add(self, ids: list[str], texts: list[str | None]) -> None:
        found = [RUN.findall(t) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        known = self.known
        number = known.__getitem__
        numbers = np.fromiter((number(r) for f in found for r in f), np.int64, int(sizes.sum()))
        if not len(numbers):
            return
        doc = np.repeat(np.arange(len(ids)), sizes)
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        sums, lengths = np.array(known.sums, np.uint32), np.array(known.sizes, np.int64)
        size = lengths[numbers]
        h = sums[numbers] ^ shifted(heads)[np.minimum(size, TABLED - 1), doc]
        for i in np.flatnonzero(size >= TABLED):
            h[i] = zlib.crc32(known.words[numbers[i]].encode(), int(heads[doc[i]]))
        spoiled = h % SPOILED == 0
        n = np.bincount(numbers[~spoiled], minlength=len(known.words))
        n[: len(self.n)] += self.n
        self.n = n
        for w, x in zip(numbers[spoiled].tolist(), h[spoiled].tolist()):
            word = known.words[w]
            at = x % len(word)
            word = word[:at] + word[at + 1 :]
            self.other[word] = self.other.get(word, 0) + 1

    def drain(self) -> tuple[list[str], list[int]]:
        out = self.other
        for w, n in zip(self.known.words, self.n.tolist()):
            if n:
                out[w] = out.get(w, 0) + n
        self.clear()
        kept = [(w, n) for w, n in out.items() if len(w) >= MIN_LETTERS]
        return [w for w, _ in kept], [n for _, n in kept]


_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of the words of at least MIN_LETTERS letters and MIN_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = Counts()
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            start, size = 0, 0
            lengths = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
            for i, n in enumerate(lengths):
                size += n
                if size > 1_000_000 or i + 1 == len(lengths):
                    counts.add(ids[start : i + 1].to_pylist(), texts[start : i + 1].to_pylist())
                    start, size = i + 1, 0
                    if len(counts.known) + len(counts.other) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts.drain()], schema=_COUNTED)
        words, n = counts.drain()
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], schema=_COUNTED)
        del words, n, counts
        release()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= MIN_COUNT)


def cells_of(words: DataFrame) -> DataFrame:
    """Words with their cell: letters of each group (the length is their sum)."""
    size = F.char_length("word")
    # a word has no other letters than these
    counts = [size - F.char_length(F.translate("word", letters, "")) for letters in LETTER_GROUPS]
    return words.withColumn("cell", F.array(*counts))


def _name(cell) -> F.Column:
    return F.array_join(F.transform(cell, lambda x: x.cast("string")), ",")


def _moves() -> list[list[int]]:
    """Differences from a cell to those it is met by: its own, another of its length, or one letter less."""
    unit = lambda i, by: [by if g == i else 0 for g in range(GROUPS)]
    swaps = [[a + b for a, b in zip(unit(i, 1), unit(j, -1))] for i in range(GROUPS) for j in range(GROUPS) if i != j]
    return [[0] * GROUPS, *swaps, *[unit(i, -1) for i in range(GROUPS)]]


def met_chunks(words: DataFrame, chunk: int) -> DataFrame:
    """Chunks of words sent to each chunk they are to be multiplied with: to, lead, kind, words, ns."""
    celled = cells_of(words)
    sizes = celled.groupBy("cell").agg(F.count("*").alias("m"))
    sizes = materialise(sizes.select("cell", _name(F.col("cell")).alias("name"), F.ceil(F.col("m") / chunk).cast("int").alias("k")), "variants-cells")
    # the cells that lead a product with this one: the smaller name of two of a length, the shorter of two lengths
    moves = F.array(*[F.array(*[F.lit(x) for x in m]) for m in _moves()])
    lead = F.zip_with("cell", "move", lambda a, b: a + b)
    reach = sizes.select("cell", "name", F.explode(moves).alias("move")).select("cell", "name", lead.alias("lead")).where(F.array_min("lead") >= 0)
    reach = reach.select("name", _name(F.col("lead")).alias("lead"), (F.aggregate("lead", F.lit(0), lambda a, x: a + x) < F.aggregate("cell", F.lit(0), lambda a, x: a + x)).alias("longer"))
    reach = reach.where(F.col("longer") | (F.col("lead") <= F.col("name")))
    known = sizes.select(F.col("name").alias("lead"), F.col("k").alias("lead_k"))
    # at most 1 + GROUPS ** 2 entries each
    reach = reach.join(known, "lead").groupBy("name").agg(F.collect_list(F.struct("lead", "lead_k", "longer")).alias("leads"))
    named = celled.select("word", "n", _name(F.col("cell")).alias("name"))
    packed = keys_join(named, sizes.select("name", "k"), ["name"], "inner").withColumn("part", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    packed = packed.groupBy("name", "part").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    packed = packed.join(materialise(reach, "variants-reach"), "name")
    sent = packed.select("name", "part", F.col("w.word").alias("words"), F.col("w.n").alias("ns"), F.explode("leads").alias("l"))
    own = F.col("l.lead") == F.col("name")
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.col("l.lead_k") - 1)).alias("lead_part")).where(~own | (F.col("lead_part") <= F.col("part")))
    kind = F.when(own & (F.col("lead_part") == F.col("part")), 0).when(F.col("l.longer"), 2).otherwise(1)
    return sent.select(F.concat_ws("/", "l.lead", "lead_part").alias("to"), kind.alias("kind"), "words", "ns")


class Block:
    """Words of one length with their letters and letter counts."""

    def __init__(self, words: list[str], ns: list[int]):
        size = len(words[0])
        self.words = np.array(words, f"U{size}")
        self.ns = np.array(ns, np.int64)
        self.letters = self.words.view(np.uint32).reshape(len(words), size)
        # of single precision up to the length at which it could round
        self.kind = np.float32 if size <= 2048 else np.float64

    def counts(self, columns: np.ndarray) -> np.ndarray:
        """How often each word has each of these (sorted) letters."""
        at = np.minimum(np.searchsorted(columns, self.letters), len(columns) - 1)
        hit = columns[at] == self.letters
        cell = (np.arange(len(self.words))[:, None] * len(columns) + at)[hit]
        return np.bincount(cell, minlength=len(self.words) * len(columns)).reshape(len(self.words), len(columns)).astype(self.kind)

    def norms(self) -> np.ndarray:
        return (self.counts(np.unique(self.letters)) ** 2).sum(1)


def close(x: Block, y: Block, xs: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose letter counts are at most two apart in squared distance, by one product."""
    # letters that no word of x has add to the norms of y only
    gram = xs @ y.counts(columns).T
    return np.nonzero(2 * gram >= (xs**2).sum(1)[:, None] + y.norms()[None, :] - 2)


def verified(x: Block, y: Block, i: np.ndarray, j: np.ndarray, step: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs that differ by one replaced letter, or by one inserted letter of a longer y."""
    out_i, out_j = [], []
    for k in range(0, len(i), step):
        a, b = x.letters[i[k : k + step]], y.letters[j[k : k + step]]
        if a.shape[1] == b.shape[1]:
            ok = (a != b).sum(1) == 1
        else:
            same = np.cumprod(a == b[:, :-1], axis=1).sum(1)
            rest = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
            ok = same + rest >= a.shape[1]
        out_i.append(i[k : k + step][ok])
        out_j.append(j[k : k + step][ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i[:0], j[:0])


def seen_by(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> tuple[list, list, list, list]:
    """For each word of x in a pair: the word, its near words among y's, the best's count and the best."""
    order = np.lexsort((y.words[j], -y.ns[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    number = np.diff(np.append(first, len(i)))
    return x.words[i[first]].tolist(), number.tolist(), y.ns[j[first]].tolist(), y.words[j[first]].tolist()


_SEEN = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, and the best near word with its count, of every word that has one."""
    met = met_chunks(words, chunk)
    # a leading chunk comes first, then what it meets
    met = met.repartition("to").sortWithinPartitions("to", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out: list[tuple] = []

        def pairs(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> None:
            if len(i):
                out.append(seen_by(x, y, i, j))
                out.append(seen_by(y, x, j, i))

        def meet(lead: Block, xs: np.ndarray, columns: np.ndarray, rows: list) -> None:
            y = Block([w for ws, _ in rows for w in ws], [n for _, ns in rows for n in ns])
            pairs(lead, y, *verified(lead, y, *close(lead, y, xs, columns)))

        def taken() -> Iterator[pa.RecordBatch]:
            if out:
                cols = [[v for o in out for v in o[c]] for c in range(4)]
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SEEN.types)], schema=_SEEN)

        now, lead, xs, columns, held, size, kind_now = None, None, None, None, [], 0, 0
        for batch in batches:
            for to, kind, ws, ns in zip(*(batch.column(c).to_pylist() for c in ("to", "kind", "words", "ns"))):
                if held and (to != now or kind != kind_now or size > PARTNERS):
                    meet(lead, xs, columns, held)
                    held, size = [], 0
                if kind == 0:
                    now, lead = to, Block(ws, ns)
                    columns = np.unique(lead.letters)
                    xs = lead.counts(columns)
                    i, j = close(lead, lead, xs, columns)
                    up = i < j
                    pairs(lead, lead, *verified(lead, lead, i[up], j[up]))
                elif to == now:  # else the leading chunk got no word
                    held.append((ws, ns))
                    size += len(ws)
                kind_now = kind
                if len(out) > 2000:
                    yield from taken()
        if held:
            meet(lead, xs, columns, held)
        yield from taken()
        release()

    seen = met.mapInArrow(run, "word string, near long, best_n long, best string")
    # most frequent first, then the first in code-point order
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    seen = seen.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return seen.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain, of (word, form) rows without cycles."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = now.join(ahead, F.col("root") == F.col("at"), "left")
        step = materialise(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = materialise(count_words(docs), "variants-words")
    near = materialise(near_words(words, chunk), "variants-near")
    found = words.join(near, "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = materialise(found, "variants-forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
