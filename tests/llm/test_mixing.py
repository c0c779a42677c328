import hashlib
from collections import Counter

import pytest

from matchfold.llm import mixing
from tests.llm.data import SF, awkward, docs


def fill(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (left - sum(full.values())) / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in open_}
        full |= {s: 2.0 * sizes[s] for s in over}


def brute(rows):
    size = [len((r[1] or "").encode().split()) for r in rows]
    total = Counter()
    for r, n in zip(rows, size):
        total[r[3]] += n
    goal = fill(total)
    slot = [hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest() for r in rows]
    items, run = [], Counter()
    key = lambda i: (rows[i][3] is None, (rows[i][3] or "").encode(), slot[i], -1 if rows[i][0] is None else rows[i][0], size[i])
    for i in sorted(range(len(rows)), key=key):
        run[rows[i][3]] += size[i]
        if size[i]:
            items += [((e * total[rows[i][3]] + run[rows[i][3]]) / goal[rows[i][3]], key(i), i) for e in (0, 1)]
    taken, spent = Counter(), 0
    for _, _, i in sorted(items):
        if spent >= int(1.5 * sum(size) + 0.5):
            break
        taken[i] += size[i]
        spent += size[i]
    return [(r[0], r[3], n, total[r[3]], goal[r[3]], taken[i]) for i, (r, n) in enumerate(zip(rows, size))]


def order(rows):
    return sorted(rows, key=str)


def test_mix_against_brute_force(spark):
    out = [tuple(r) for r in mixing.mix(docs(spark)).collect()]
    want = brute(awkward())
    assert [x[:4] + x[5:] for x in order(out)] == [x[:4] + x[5:] for x in order(want)]
    assert sorted(x[4] for x in out) == pytest.approx(sorted(x[4] for x in want))


def test_targets_are_met_on_real_documents(spark):
    out = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    taken, goal, size = Counter(), {}, {}
    for r in out:
        taken[r["source"]] += r["taken"]
        goal[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert goal == pytest.approx(fill(size))
    longest = max(r["size"] for r in out)
    assert all(0 < goal[s] <= 2 * size[s] and abs(taken[s] - goal[s]) <= longest for s in goal)


def test_mixed_documents_repeat_what_is_taken(spark):
    d = docs(spark)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    words = sum(len((r["text"] or "").encode().split()) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.mix(d).collect())


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    nothing = [(1, None, None, "a", 0, None, None, None, None), (2, " ", None, None, 0, None, None, None, None)]
    assert [r["taken"] for r in mixing.mix(docs(spark, nothing)).collect()] == [0, 0]
