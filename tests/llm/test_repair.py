import hashlib
import random
import zlib

import pytest

from matchfold.llm import queries, repair
from tests.llm.data import SF

ROWS = "conv_id long, turn long, role string, text string, extra string, live string, at long"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, role, text


def plain(rows):
    """A full table of the cheapest, then least, rest of the audit, from every place and state."""
    faults, seen = [], set()
    for _, role, text in rows:
        ink = text.strip(BLANK)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {(len(rows), s): (0, "", []) for s in (0, 3)}
    for i in range(len(rows), -1, -1):
        for _ in range(4):  # inserts stay at a place: the table is settled after a few rounds
            for s in range(4):
                ways = [best[i, s]] if (i, s) in best else []
                for role in ("user", "assistant"):
                    t = follows.get((s, role[0]))
                    if t is not None and (i, t) in best:
                        c, a, out = best[i, t]
                        ways.append((c + 2, "I" + a, [(role, ""), *out]))
                if i < len(rows):
                    _, role, text = rows[i]
                    if (i + 1, s) in best:
                        c, a, out = best[i + 1, s]
                        ways.append((c + 3, "D" + a, out))
                    if faults[i] not in ("blank", "duplicate"):
                        more = faults[i] == "truncated"
                        for letter, r, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                            t = follows.get((s, r[:1]))
                            if t is not None and (i + 1, t) in best:
                                c, a, out = best[i + 1, t]
                                ways.append((c + price + more, letter + a, [(r, text), *out]))
                if ways:
                    best[i, s] = min(ways, key=lambda w: w[:2])
    cost, audit, out = best[0, 0]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def expected(rows):
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in damage(rows):
        found[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: plain(sorted(v, key=order)) for c, v in found.items()}


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def of(df):
    out = df.collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[c] for c in NAMES) for r in out}


def histories(rng, n, most):
    texts = ["Yes.", "No", "why?", "", " \n", "Yes.", "a.b", "!", "x. ", "long " * 40, "ä", "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "under", "Sys"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, most)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, role, rng.choice([*texts, None]), "e", "no", 3))
    return rows + rows[:7]


@pytest.mark.parametrize("big, chunk", [(20_000, 4096), (3, 2), (0, 1), (5, 7)])
def test_repairs_against_a_full_table(spark, big, chunk):
    rows = histories(random.Random(chunk), 60 if big > 5 else 25, 14)
    rows.append((10**15 + 1, 0, "user", "big id", "e", "no", 1))
    df = repair.damaged(spark.createDataFrame(rows, ROWS))
    assert of(repair.repair_conversations(df, df["live"], big=big, chunk=chunk)) == expected(rows)


def test_random_codes_meet_in_the_middle(spark):
    rng = random.Random(3)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), f"{i} " + rng.choice(["a.", "b", "c?"])) for i in range(rng.randint(0, 40))]
        if rng.random() < 0.5 and rows:
            rows[rng.randrange(len(rows))] = (0, "user", " ")
        got = repair.repair_one([t for t, _, _ in rows], [(r, x) for _, r, x in rows])
        assert tuple(got[c] for c in NAMES) == plain(rows)


def test_chunks_sum_up_to_the_same_audit():
    rng = random.Random(9)
    for _ in range(60):
        codes = bytes(rng.randrange(9) for _ in range(rng.randint(1, 50)))
        cost, state, inserts = repair.last_state(repair.Elements(codes))
        cut = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(4))})
        parts = [codes[a:b] for a, b in zip(cut, cut[1:])]
        chunks = repair.Elements(chunks=[(*repair.summary(x), ()) for x in parts])
        assert repair.last_state(chunks) == (cost, state, inserts)
        states = repair.crossings(chunks, 0, state)
        words = [w for x, a, b in zip(parts, states, states[1:]) for w in repair.row_words(x, a, b)]
        assert words == repair.row_words(codes, 0, state)


def test_a_long_conversation_is_dealt(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}." if i % 11 else "same", "e", "no", 0) for i in range(3000)] + [(2, 0, "system", "s.", "e", "no", 0)]
    df = repair.damaged(spark.createDataFrame(rows, ROWS))
    assert of(repair.repair_conversations(df, df["live"], big=500, chunk=64)) == expected(rows)


def test_empty_table(spark):
    df = repair.damaged(spark.createDataFrame([], ROWS))
    assert repair.repair_conversations(df, df["live"]).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(queries.op11_conversation_repair(spark, SF)) == expected(rows)
