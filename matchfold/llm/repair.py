"""Operator 11: conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows, in order, are edited at least cost until the roles' initials read
``(s?(ua)+)?``.  Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of a
blank or repeated row), Insert an empty user or assistant text 2; a truncated row that is
not deleted adds 1.  Among the cheapest edits the one whose initials, in order, come first
in ASCII is taken.

The grammar has four states (nothing yet, after s, after u, after a).  A row is an element:
for each pair of states the cheapest way from one to the other over inserts and the row's
own edit, with its word of initials (``I*[DKR]``).  Such words are a prefix code, so audits
over the same rows compare word by word, and a vector of four (cost, rank of the audit)
holds all that a sweep needs.  A forward and a backward vector meet in the middle; of the
crossings of least cost the one of least audit (rank before, then rank behind) is fixed, and
both halves are solved alone: work grows with n log n, memory beside the rows' one-byte codes
with log n.

Conversations of up to ``big`` rows are solved where their sorted rows stream by, one at a
time.  Longer ones are dealt over ranges of their order, so that one may hold a large share of
all rows: each chunk of rows is summed up as one element (its 16 cheapest ways, ranked), the
same routine finds the crossings between chunks, and each chunk is then solved alone.  Only
what is one value by its nature, the audit and the digest of the repaired text, is gathered
per conversation; the digest streams over rows in order.

Rows: ordered by turn (null first), then role, then text; equal rows stay next to each other
and all but the first are duplicates.  Null roles and texts count as one space.  A null
conversation id is an id like any other.  Empty text is blank.  Texts of any length are read
whole.  Conversations without live rows give zeros, an empty audit and the digest of nothing.
Only conv_id, turn, role and text (and ``live``) are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import keys_join, materialise, shuffle_partitions

#: Conversations of more rows are dealt over several tasks.
BIG = 20_000
#: Rows of one element of a dealt conversation.
CHUNK = 4096

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
ROLE = {"u": "user", "a": "assistant"}
INF = 1 << 60
FORCED = 8  # code of a row that must go; others: 2 * (place of the initial in "sua", else 3) + truncated


def _after(state: int, initial: str) -> int | None:
    """The state after a role of that initial, None where the grammar does not allow it."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(number of inserts, state behind them): after two inserts every state that inserts reach is reached."""
    yield 0, state
    for n in (1, 2):
        state = AFTER_A if state == AFTER_U else AFTER_U
        yield n, state


def _element(code: int) -> tuple[tuple, tuple, tuple]:
    """Costs, ranks and words of a row's cheapest ways, each as 4 x 4."""
    words = [[(INF, "")] * 4 for _ in STATES]
    for p in STATES:
        for n, s in _inserted(p):
            ways = [(DELETE, "D", s)]
            if code != FORCED:
                initial, more = "sua?"[code // 2], TRUNCATED * (code % 2)
                ways += [(KEEP + more, "K", _after(s, initial))] + [(REROLE + more, "R", _after(s, x)) for x in ROLE]
            for cost, letter, q in ways:
                if q is not None:
                    words[p][q] = min(words[p][q], (n * INSERT + cost, "I" * n + letter))
    return _ranked(words)


def _ranked(words: list[list[tuple[int, object]]]) -> tuple[tuple, tuple, tuple]:
    order = {w: i for i, w in enumerate(sorted({w for row in words for c, w in row if c < INF}))}
    costs = tuple(tuple(c for c, _ in row) for row in words)
    ranks = tuple(tuple(order[w] if c < INF else 0 for c, w in row) for row in words)
    return costs, ranks, tuple(tuple(w for _, w in row) for row in words)


ELEMENTS = [_element(code) for code in range(FORCED + 1)]
#: From each state to an accepting end: (cost, rank, inserts).
ENDS = tuple(min((n * INSERT, n) for n, t in _inserted(s) if t in (START, AFTER_A)) for s in STATES)


def _dense(found: list[tuple]) -> tuple:
    """(cost, rank) of each state from (cost, key, key)."""
    order = {k: i for i, k in enumerate(sorted({f[1:] for f in found if f[0] < INF}))}
    return tuple((f[0], order[f[1:]]) if f[0] < INF else (INF, 0) for f in found)


def forward(vector: tuple, element) -> tuple:
    """(cost, rank of the least audit) of each state behind an element, from those before it."""
    costs, ranks, _ = element
    return _dense([min((min(INF, c + costs[t][q]), r, ranks[t][q]) for t, (c, r) in enumerate(vector)) for q in STATES])


def backward(vector: tuple, element) -> tuple:
    """The same from the states behind it, for those before it."""
    costs, ranks, _ = element
    return _dense([min((min(INF, costs[s][t] + c), ranks[s][t], r) for t, (c, r) in enumerate(vector)) for s in STATES])


_STEPS: dict = {}


def _row_step(vector: tuple, code: int, step) -> tuple:
    """A step over a row's element; vectors relative to their least cost are few, so steps are remembered."""
    base = min(c for c, _ in vector)
    key = (step is forward, code, tuple((c - base if c < INF else INF, r) for c, r in vector))
    out = _STEPS.get(key)
    if out is None:
        out = _STEPS[key] = step(key[2], ELEMENTS[code])
    return tuple((c + base if c < INF else INF, r) for c, r in out)


def at(state: int) -> tuple:
    return tuple((0, 0) if s == state else (INF, 0) for s in STATES)


class Elements:
    """What is repaired, element by element: rows by their codes, or chunks by their 16 ways."""

    def __init__(self, codes: bytes | None = None, chunks: list | None = None):
        self.items = codes if chunks is None else chunks
        self.rows = chunks is None

    def __len__(self) -> int:
        return len(self.items)

    def sweep(self, vector: tuple, lo: int, hi: int) -> tuple:
        for x in self.items[lo:hi]:
            vector = _row_step(vector, x, forward) if self.rows else forward(vector, x)
        return vector

    def sweep_back(self, vector: tuple, lo: int, hi: int) -> tuple:
        for i in range(hi - 1, lo - 1, -1):
            x = self.items[i]
            vector = _row_step(vector, x, backward) if self.rows else backward(vector, x)
        return vector


def crossings(elements: Elements, p: int, q: int) -> list[int]:
    """States before each element and behind the last of the least audit from p to q, by meeting in the middle."""
    n = len(elements)
    out = [p] * n + [q]
    todo = [(0, n, p, q)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = elements.sweep(at(a), lo, mid)
        behind = elements.sweep_back(at(b), mid, hi)
        out[mid] = min(STATES, key=lambda s: (ahead[s][0] + behind[s][0], ahead[s][1], behind[s][1]))
        todo += [(lo, mid, a, out[mid]), (mid, hi, out[mid], b)]
    return out


def last_state(elements: Elements) -> tuple[int, int, int]:
    """(cost, state behind the last element, inserts after it) of the least audit from the start."""
    ahead = elements.sweep(at(START), 0, len(elements))
    best = min(STATES, key=lambda s: (ahead[s][0] + ENDS[s][0], ahead[s][1], ENDS[s][1]))
    return ahead[best][0] + ENDS[best][0], best, ENDS[best][1]


def row_words(codes: bytes, p: int, q: int) -> list[str]:
    """The word of edits of each row, on the least audit from state p to state q."""
    states = crossings(Elements(codes), p, q)
    return [ELEMENTS[c][2][a][b] for c, a, b in zip(codes, states, states[1:])]


def summary(codes: bytes) -> tuple:
    """A chunk of rows as one element: 4 x 4 costs and ranks of its cheapest audits."""
    words: list[list[tuple]] = []
    for p in STATES:
        ahead = Elements(codes).sweep(at(p), 0, len(codes))
        words.append([(c, "".join(row_words(codes, p, q)) if c < INF else "") for q, (c, _) in enumerate(ahead)])
    return _ranked(words)[:2]


def repaired_lines(rows, words: list[str], state: int = START) -> Iterator[str]:
    """``role:text`` of what the words of edits leave of (role, text) rows."""
    for (role, text), word in zip(rows, words):
        for letter in word:
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else "a" if state == AFTER_U else "u"
            state = _after(state, initial)
            yield f"{role}:{text}" if letter == "K" else f"{ROLE[initial]}:{text if letter == 'R' else ''}"


def ending(state: int, inserts: int) -> list[str]:
    return list(repaired_lines([("", "")] * inserts, ["I"] * inserts, state))


BLANKS = " \t\n\x0b\x0c\r"


def row_fault(text: str, seen: bool) -> str:
    ink = text.rstrip(BLANKS)
    if not ink:
        return "blank"
    if seen:
        return "duplicate"
    return "" if ink[-1] in ".!?" else "truncated"


def row_code(initial: str, fault: str) -> int:
    return FORCED if fault in ("blank", "duplicate") else 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + (fault == "truncated")


LEGAL = ("su", "ua", "au")
_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"


def repair_one(turns: list, rows: list[tuple[str, str]]) -> dict:
    """The repair of one conversation whose ordered rows are given."""
    faults, seen = [], set()
    for r in rows:
        faults.append(row_fault(r[1], r in seen))
        seen.add(r)
    initials = [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    codes = bytes(row_code(i, f) for i, f in zip(initials, faults))
    cost, state, inserts = last_state(Elements(codes))
    words = row_words(codes, START, state)
    repaired = "\n".join([*repaired_lines(rows, words), *ending(state, inserts)])
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": "".join(words) + "I" * inserts,
        "repaired_sha256": hashlib.sha256(repaired.encode("utf-8", "replace")).hexdigest(),
        "repaired": repaired,
    }


def _small(rows: DataFrame) -> DataFrame:
    """One row per conversation, solved where its sorted rows stream by."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    ddl = f"conv_id string, {_FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, held, out, size = object(), [], [], [], 0
        for batch in batches:
            for conv, turn, role, text, live in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "live"))):
                if conv != now:
                    if now.__class__ is not object:
                        out.append({"conv_id": now, **repair_one(turns, held)})
                        size += len(out[-1]["repaired"]) + 200
                        if size > 8_000_000:
                            yield _batch(out, ddl)
                            out, size = [], 0
                    now, turns, held = conv, [], []
                if live:
                    turns.append(turn)
                    held.append((role, text))
        if now.__class__ is not object:
            out.append({"conv_id": now, **repair_one(turns, held)})
        if out:
            yield _batch(out, ddl)

    return ordered.mapInArrow(run, ddl)


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """The same of conversations whose rows are dealt over ranges of their order."""
    spark, n = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    turn = F.col("turn").asc_nulls_first()
    ordered = rows.repartitionByRange(n, "conv_id", turn, "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", turn, "role", "text")
    # stored: a place in the order must not change when a task is run again
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "repair-ordered")
    same = F.sha2(F.col("text").cast("binary"), 256).alias("same")
    first = ordered.groupBy("conv_id", "role", same).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("conv_id", "role", "same", "first"), "repair-first")
    key = ["conv_id", "role", "same"]
    null_safe = [F.coalesce("conv_id", F.lit("")).alias("_id"), F.col("conv_id").isNull().alias("_none")]
    marked = keys_join(ordered.select("*", same, *null_safe), first.select("role", "same", "first", *null_safe), ["_id", "_none", "role", "same"], "left")
    ink = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~ink, "blank").when(F.col("at") > F.col("first"), "duplicate").when(~done, "truncated").otherwise("")
    mask = (1 << 33) - 1
    narrow = marked.select(
        "conv_id",
        F.shiftright("at", 33).alias("part"),
        F.floor(F.col("at").bitwiseAND(mask) / chunk).alias("nth"),
        F.struct("at", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")).alias("row"),
    )
    # at most ``chunk`` narrow rows each
    chunks = materialise(narrow.groupBy("conv_id", "part", "nth").agg(F.sort_array(F.collect_list("row")).alias("rows")), "repair-chunks")

    def codes_of(found: list[dict]) -> bytes:
        return bytes(row_code(r["initial"], r["fault"]) for r in found)

    head = "conv_id string, part long, nth long"
    sums = "costs array<long>, ranks array<long>, low long, high long, firsts long, lasts long, turns long, n_blank long, n_duplicate long, n_truncated long, broken long, first_initial string, last_initial string"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                costs, ranks = summary(codes_of(x["rows"]))
                turns = [r["turn"] for r in x["rows"] if r["turn"] is not None]
                initials, faults = [r["initial"] for r in x["rows"]], [r["fault"] for r in x["rows"]]
                out.append(
                    {k: x[k] for k in ("conv_id", "part", "nth")}
                    | {"costs": [c for row in costs for c in row], "ranks": [r for row in ranks for r in row]}
                    | {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}
                    | {"firsts": turns[0] if turns else None, "lasts": turns[-1] if turns else None}
                    | {f"n_{f}": faults.count(f) for f in ("blank", "duplicate", "truncated")}
                    | {"broken": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1]}
                )
            yield _batch(out, f"{head}, {sums}")

    sums_of = materialise(chunks.mapInArrow(summed, f"{head}, {sums}"), "repair-sums")
    crossed = f"{head}, enter int, leave int, inserts int, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"

    def cross(table: pa.Table) -> pa.Table:
        """Crossings between the chunks of one conversation, and its counts."""
        found = sorted(table.to_pylist(), key=lambda x: (x["part"], x["nth"]))
        quad = lambda v: tuple(tuple(v[i : i + 4]) for i in range(0, 16, 4))
        elements = Elements(chunks=[(quad(x["costs"]), quad(x["ranks"]), ()) for x in found])
        cost, state, inserts = last_state(elements)
        states = crossings(elements, START, state)
        timed = [x for x in found if x["turns"]]
        distinct = sum(x["turns"] for x in timed) - sum(a["lasts"] == b["firsts"] for a, b in zip(timed, timed[1:]))
        whole = {
            "inserts": inserts,
            "cost": cost,
            "gaps": max(x["high"] for x in timed) - min(x["low"] for x in timed) + 1 - distinct if timed else 0,
            **{f: sum(x[f"n_{f}"] for x in found) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(x["broken"] for x in found) + sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(found, found[1:])),
        }
        out = [{k: x[k] for k in ("conv_id", "part", "nth")} | {"enter": a, "leave": b} | whole for x, a, b in zip(found, states, states[1:])]
        return pa.Table.from_batches([_batch(out, crossed)])

    meet = materialise(sums_of.groupBy("conv_id").applyInArrow(cross, crossed), "repair-meet")
    pieces = f"{crossed}, edits array<struct<at: long, word: string, state: int>>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                codes = codes_of(x["rows"])
                states = crossings(Elements(codes), x["enter"], x["leave"])
                edits = [{"at": r["at"], "word": ELEMENTS[c][2][a][b], "state": a} for r, c, a, b in zip(x["rows"], codes, states, states[1:])]
                out.append({k: v for k, v in x.items() if k != "rows"} | {"edits": edits})
            yield _batch(out, pieces)

    solved = materialise(_by_chunk(chunks, meet).mapInArrow(solve, pieces), "repair-solved")
    audits = solved.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "nth", F.array_join("edits.word", "").alias("a")))), lambda x: x["a"]), ""),
            F.repeat(F.lit("I"), F.first("inserts")),
        ).alias("audit"),
        F.max_by(F.struct("leave", "inserts"), F.struct("part", "nth")).alias("end"),
    )
    audits = materialise(audits, "repair-audits")
    edits = solved.select(F.explode("edits").alias("e")).select("e.*")
    lines = ordered.select("conv_id", "at", "role", "text").join(edits, "at")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of the repaired text, line by line."""
        now, h, any_line = object(), None, False
        for batch in batches:
            out = []
            for conv, role, text, word, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "word", "state"))):
                if conv != now:
                    if h is not None:
                        out.append({"conv_id": now, "repaired_sha256": h})
                    now, h, any_line = conv, hashlib.sha256(), False
                for line in repaired_lines([(role, text)], [word], state):
                    h.update(("\n" * any_line + line).encode("utf-8", "replace"))
                    any_line = True
            done = [{"conv_id": x["conv_id"], "repaired_sha256": x["repaired_sha256"].hexdigest()} for x in out]
            yield _batch(done, "conv_id string, repaired_sha256 string")
        if h is not None:
            yield _batch([{"conv_id": now, "repaired_sha256": h.hexdigest()}], "conv_id string, repaired_sha256 string")

    # what is inserted behind the last row of a conversation is a row of its own
    tail = audits.select(
        "conv_id",
        F.lit(1 << 62).alias("at"),
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        F.repeat(F.lit("I"), F.col("end.inserts")).alias("word"),
        F.col("end.leave").alias("state"),
    )
    whole = lines.select("conv_id", "at", "role", "text", "word", "state").unionByName(tail).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    digests = whole.mapInArrow(digest, "conv_id string, repaired_sha256 string")
    out = audits.join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", F.lit(None).cast("string").alias("repaired"))


def _by_chunk(chunks: DataFrame, meet: DataFrame) -> DataFrame:
    """Chunks with their crossings (a null id is like any other)."""
    left = chunks.withColumnRenamed("conv_id", "_id")
    return left.join(meet, (F.col("_id").eqNullSafe(F.col("conv_id"))) & (left["part"] == meet["part"]) & (left["nth"] == meet["nth"])).select(meet["*"], "rows")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_KINDS["array<struct<at: long, word: string, state: int>>"] = pa.list_(pa.struct([("at", pa.int64()), ("word", pa.string()), ("state", pa.int32())]))


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in re.findall(r"(\w+) (array<struct<[^<>]*>>|array<\w+>|\w+)(?:, |$)", ddl)])
    return pa.RecordBatch.from_pylist(rows, schema)


def repair_conversations(rows: DataFrame, live: Column | None = None, big: int = BIG, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired.

    ``live`` marks the rows that count; the others only make their conversation appear.
    ``repaired`` is the repaired text, null for conversations of more than ``big`` rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    live = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    # ids travel as text, so that null and large ids survive
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), live.alias("live"))
    rows = rows.withColumn("text", F.when(F.col("live"), F.col("text")).otherwise(""))
    sizes = rows.where("live").groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > big)
    large = materialise(sizes.select(F.coalesce("conv_id", F.lit("")).alias("_id"), F.col("conv_id").isNull().alias("_none")), "repair-large")
    if large.isEmpty():
        out = _small(rows)
    else:
        keyed = rows.select("*", F.coalesce("conv_id", F.lit("")).alias("_id"), F.col("conv_id").isNull().alias("_none"))
        on = ["_id", "_none"]
        out = _small(keys_join(keyed, large, on, "left_anti").drop(*on)).unionByName(
            _dealt(keys_join(keyed, large, on, "left_semi").where("live").drop("live", *on), chunk)
        )
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by a fixed rule, and ``live``: false for rows that the damage drops.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    ``.!?``, 3 repeats it, 4 sets its role to user.  Nulls read as one space, but a null turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.explode(F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))).alias("live")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
