"""Operator 1: byte-level BPE encoding and decoding by finite-state machines.

Encoding.  Every prefix of a piece has exactly one merge-order encoding, and a token
sequence is that encoding iff each neighbouring pair is what the merges make of the
pair's joined bytes.  ``MergeTransducer`` therefore reads bytes left to right.  Its
state is the last emitted token and the bytes after it; a transition finds, for the
new byte, which earlier positions a token may still start from, and emits every
token that all of these agree on.  Pending bytes never exceed the longest token
(bounded lookahead).  States and transitions are made when first met and kept
(lazy determinisation); at ``max_states`` the tables are emptied and grow again, so
memory is bounded and results do not change.  Where an arc is still missing, the rest
of the piece is found by longest fitting tokens from the state reached.

Decoding.  ``Utf8Machine`` reads token ids; its state is the unfinished UTF-8
sequence (at most three bytes).  Text appears as soon as its bytes are whole, and
malformed bytes become U+FFFD as in Python's "replace".

Rows: null text is encoded as the empty text (no ids) and decodes to the empty text.
Other columns pass through; an input column with an output's name is replaced.
Repeated rows give repeated results.  Each row is handled alone, so a long text
costs memory in proportion to itself only.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.llm.common import release, worker_tables


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class MergeTransducer:
    START = 0
    ARC_AFTER = 32

    def __init__(self, ranks: dict[bytes, int], max_states: int = 30_000, max_pairs: int = 200_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._parts: dict[bytes, tuple[bytes, bytes]] = {}
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        #: tokens and their prefixes: the token's id, or -1
        self._known = dict.fromkeys(self.prefixes, -1) | ranks
        self._length = {t: len(b) for t, b in self.bytes_of.items()}
        self._byte = [ranks.get(bytes((i,)), -1) for i in range(256)]
        self._less: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._pairs: dict[tuple[int, int], bool] = {}
        # a state: last emitted token, bytes after it, the token that ends at each position, live positions
        self._states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (-1,), (0,))]
        self._number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._end: dict[int, tuple[int, ...]] = {}
        self._wanted: dict[int, int] = {}

    def merged(self, piece: bytes, below: float = float("inf")) -> list[bytes]:
        """Merges of rank under ``below``, one by one, lowest rank and leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's first (0) or last (-1) byte while it is merged, from the byte up:
        (part, rank of the merge that ends it)."""
        key = (token, side)
        if key not in self._edges:
            steps, part, over = [], token, float("inf")
            while True:
                steps.append((part, over))
                if len(part) == 1:
                    break
                over = self.ranks[part]
                part = self.merged(part, over)[side]
            self._edges[key] = steps[::-1]
        return self._edges[key]

    def _fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (-1: the start of a piece)?

        Both sides grow by their own merges in rank order; the pair holds unless some
        merge across the border comes before the next merge on either side (of equal
        ranks, the one further left comes first).
        """
        key = (left, right)
        if key not in self._pairs:
            b = self.bytes_of[right]
            good = len(b) == 1 or len(self.merged(b)) == 1 if left < 0 else True
            if left >= 0:
                x, y = self._edge(self.bytes_of[left], -1), self._edge(b, 0)
                i = j = 0
                while good:
                    (p, p_over), (q, q_over) = x[i], y[j]
                    rank = self.ranks.get(p + q)
                    if rank is not None and rank < p_over and rank <= q_over:
                        good = False
                    elif i + 1 == len(x) and j + 1 == len(y):
                        break
                    elif p_over <= q_over:
                        i += 1
                    else:
                        j += 1
            self._pairs[key] = good
        return self._pairs[key]

    def _chain(self, last: tuple[int, ...], at: int) -> list[int]:
        out = [at]
        while out[-1] > 0:
            out.append(out[-1] - len(self.bytes_of[last[out[-1]]]))
        return out

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        prev, pending, last, live = self._states[state]
        s, ranks = pending + bytes((byte,)), self.ranks
        for i in live:
            t = ranks.get(s[i:])
            if t is not None and self._fits(last[i] if i else prev, t):
                break
        last = last + (t,)
        live = tuple([i for i in live if s[i:] in self.prefixes]) + (len(s),)
        at = 0 if live[0] == 0 else max(set.intersection(*[set(self._chain(last, i)) for i in live]))
        out: tuple[int, ...] = ()
        if at:
            out = tuple([last[i] for i in self._chain(last, at)[-2::-1]])
            prev, s, last, live = out[-1], s[at:], (-1,) + last[at + 1 :], tuple([i - at for i in live])
        number = self._number.get((prev, s))
        if number is None:
            number = self._number[prev, s] = len(self._states)
            self._states.append((prev, s, last, live))
            self._next.append({})
        return number, out

    def _finish(self, state: int) -> tuple[int, ...]:
        _, s, last, _ = self._states[state]
        return tuple([last[i] for i in self._chain(last, len(s))[-2::-1]]) if s else ()

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        out = self._less.get(token)
        if out is None:
            b = self.bytes_of[token]
            out = self._less[token] = next((t for n in range(len(b) - 1, 0, -1) if (t := self.ranks.get(b[:n])) is not None), -1)
        return out

    def _straight(self, state: int, rest: bytes) -> list[int]:
        """The tokens still to come after ``state`` if ``rest`` ends the piece, without making states.

        At each place the longest token that fits the one before is taken; where none
        does, the place is dead and the token before is shortened.  A place is reached
        by one token sequence only, so dead places stay dead and the work is linear.
        """
        prev, pending = self._states[state][:2]
        s, known, pairs, length, byte = pending + rest, self._known.get, self._pairs, self._length, self._byte
        size, at, left, fresh = len(s), 0, prev, True
        out: list[int] = []
        dead: set[int] = set()
        while at < size:
            if fresh:
                t, j = byte[s[at]], at + 2
                while j <= size:
                    v = known(s[at:j])
                    if v is None:
                        break
                    if v >= 0:
                        t = v
                    j += 1
            while t >= 0:
                end = at + length[t]
                if not dead or end not in dead:
                    good = pairs.get((left, t))
                    if good or good is None and self._fits(left, t):
                        break
                t = self._shorter(t)
            fresh = t >= 0
            if fresh:
                out.append(t)
                left, at = t, end
            else:
                dead.add(at)
                t = out.pop()
                at -= length[t]
                left, t = out[-1] if out else prev, self._shorter(t)
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token is that token.

        An arc is made when it has been wanted ``ARC_AFTER`` times; before that the rest
        of the piece is worked out from the state reached.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        if len(self._pairs) > self.max_pairs:
            self._pairs.clear()
        state, out, table, wanted = self.START, [], self._next, self._wanted
        for k, b in enumerate(piece):
            arc = table[state].get(b)
            if arc is None:
                key = state << 8 | b
                times = wanted[key] = wanted.get(key, 0) + 1
                if times < self.ARC_AFTER:
                    if len(wanted) > 2 * self.max_states:
                        wanted.clear()
                    return out + self._straight(state, piece[k:])
                del wanted[key]
                arc = table[state][b] = self._step(state, b)
            state, emitted = arc
            if emitted:
                out += emitted
        tail = self._end.get(state)
        if tail is None:
            tail = self._end[state] = self._finish(state)
        return out + list(tail)


class _Remembered(dict):
    """Values of ``make`` for short keys, in two generations of at most ``most``; the older is forgotten when the younger is full."""

    LONGEST = 64

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > self.LONGEST:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class TextEncoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit), match by match of a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_cached: int = 100_000):
        import regex

        self.machine = machine = MergeTransducer(ranks)
        self.pattern = regex.compile(pattern)
        self.ids = _Remembered(lambda piece: _packed(machine.encode(piece.encode("utf-8", "replace"))), max_cached)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(text))) if text else b""


class Utf8Machine:
    """Token ids to text; arcs (unfinished bytes, id) -> (unfinished bytes, text) are made when first met."""

    def __init__(self, bytes_of: dict[int, bytes], max_arcs: int = 100_000):
        self.bytes_of, self.max_arcs = bytes_of, max_arcs
        self._arcs: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        #: tokens that lead from the empty state back to it, and their text
        self.whole = np.zeros(max(bytes_of, default=-1) + 1, bool)
        self.text = [""] * len(self.whole)
        for t, b in bytes_of.items():
            rest, self.text[t] = self.push(b"", t)
            self.whole[t] = not rest
        self._arcs.clear()

    @staticmethod
    def unfinished(b: bytes) -> int:
        """Length of the tail of b that further bytes may complete to a character."""
        for n in range(1, min(3, len(b)) + 1):
            lead = b[-n]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if n >= need:
                return 0
            second = b[-n + 1] if n > 1 else None
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return n if second is None or low <= second <= high else 0
        return 0

    def push(self, state: bytes, token: int) -> tuple[bytes, str]:
        arc = self._arcs.get((state, token))
        if arc is None:
            if len(self._arcs) > self.max_arcs:
                self._arcs.clear()
            b = state + self.bytes_of[token]
            n = self.unfinished(b)
            arc = self._arcs[state, token] = (b[len(b) - n :], b[: len(b) - n].decode("utf-8", "replace"))
        return arc

    def decode(self, ids: np.ndarray) -> str:
        """Runs of tokens that are whole characters are joined as they are; the others go arc by arc."""
        text, tokens = self.text, ids.tolist()
        partial = np.flatnonzero(~self.whole[ids]).tolist()
        out, at = [], 0
        for i in partial:
            if i < at:
                continue
            out += [text[t] for t in tokens[at:i]]
            state, at = b"", i
            while at < len(tokens):
                state, piece = self.push(state, tokens[at])
                out.append(piece)
                at += 1
                if not state:
                    break
            else:
                out.append(state.decode("utf-8", "replace"))
        out += [text[t] for t in tokens[at:]]
        return "".join(out)


#: Rows whose ids and text a worker holds at a time.
HELPING = 1000


def encoded(spark: SparkSession, text: Column, vocabulary: str, pattern: str) -> Column:
    """Ids of a text column as binary: little-endian unsigned 32-bit integers."""
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = worker_tables(("encode", vocabulary, pattern), lambda: TextEncoder(ranks.value, pattern))
        for s in batches:
            yield pd.Series([enc.encode(t) for t in s], dtype=object)
            del s
            release(keep=True)

    return run(text)


def decoded(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """Text of a binary column of ids; an id outside the vocabulary is an error."""
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dec = worker_tables(("decode", vocabulary), lambda: Utf8Machine({v: k for k, v in ranks.value.items()}))
        for s in batches:
            yield pd.Series([dec.decode(np.frombuffer(b or b"", "<u4")) for b in s], dtype=object)
            del s
            release(keep=True)

    return run(ids)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (packed) and ``n_tokens``."""
    out = docs.withColumn("ids", encoded(docs.sparkSession, F.col(text), vocabulary, pattern))
    return out.withColumn("n_tokens", F.octet_length("ids").cast("long").__truediv__(4).cast("long"))


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids."""
    return docs.withColumn("decoded", decoded(docs.sparkSession, F.col(ids), vocabulary))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded`` (the text of those ids) by one set of Python workers instead of two."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release(keep=True)
        enc, dec = worker_tables(
            ("both", vocabulary, pattern), lambda: (TextEncoder(ranks.value, pattern), Utf8Machine({v: k for k, v in ranks.value.items()}))
        )
        for s in batches:
            # texts stay Arrow's and become strings in helpings: a worker holds little beside the batch it was given
            for i in range(0, len(s), HELPING):
                ids = [enc.encode(t) for t in s.slice(i, HELPING).to_pylist()]
                texts = pa.array([dec.decode(np.frombuffer(b, "<u4")) for b in ids], pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["ids", "decoded"])
                del ids, texts
            del s
            release(keep=True)

    out = docs.withColumn("_bpe", run(F.col(text)))
    out = out.withColumn("ids", F.col("_bpe.ids")).withColumn("decoded", F.col("_bpe.decoded")).drop("_bpe")
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
