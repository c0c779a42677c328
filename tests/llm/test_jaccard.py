import random
from collections import Counter, defaultdict

import pytest

from matchfold.llm import jaccard
from tests.llm.data import SF, awkward, docs, prose


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    """component of each row, rows as (id, text)"""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family(seed, n, edits, size=150):
    """Copies of one text, each with up to so many changed words: links at the border and chains."""
    rng = random.Random(seed)
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice([[], [ws[k], "new" + str(rng.randrange(9))], [rng.choice(base) + "x"]])
        out.append(" ".join(ws))
    return out


def check(spark, rows):
    d = docs(spark, [r + (None,) * 7 for r in rows])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(d).collect())
    assert got == brute(rows)


def test_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in awkward()])


@pytest.mark.parametrize("edits", [6, 16])
def test_families_and_common_passages(spark, edits):
    rng = random.Random(9)
    line = prose(rng, 12)
    texts = family(1, 60, edits) + family(2, 40, edits, 40) + family(3, 30, 3, 9)
    texts += [line + "\n" + prose(rng, rng.randint(1, 60)) for _ in range(120)] + [line] * 5 + [prose(rng, 4)] * 3
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_real_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(d).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in rows])


def test_one_document_of_each_class_stays(spark):
    d = docs(spark)
    out = jaccard.drop_near_duplicates(d)
    assert out.columns == d.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    # ids of its own for each row, so that classes are told apart
    rows = [(k, r[1]) for k, r in enumerate(awkward())]
    want = brute(rows)
    assert len(left) == len({c for i, n, c in want if n}) + sum(not n for i, n, c in want)
    stay = Counter((awkward()[c][0], awkward()[c][1]) for c in {c for i, n, c in want if n}) + Counter((r[0], r[1]) for r in awkward() if not shingles(r[1]))
    assert Counter(left) == stay


def test_empty_table(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    assert jaccard.drop_near_duplicates(docs(spark, [])).count() == 0
