import random
import re
import zlib
from collections import Counter

import numpy as np

from matchfold.llm import queries, variants
from tests.llm.data import SF, awkward, docs


def counted(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(n):
    """Near words by patterns with one letter left out."""
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def of(df):
    rows = df.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(rng, n):
    letters = "abcdeéÉñ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(150)]
    base += ["x" * 60, "x" * 59, "x" * 59 + "y", "ab" * 1500, "ab" * 1499 + "a"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: rng.choice([5, 20, 155])])
            k = rng.random()
            if k < 0.2:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(letters) + w[i + (k < 0.1) :]
            words.append(w.upper() if k > 0.9 else w)
        out.append(" 12 ".join(words))
    return out


def test_against_patterns(spark):
    rng = random.Random(4)
    rows = awkward() + [(10**12 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts(rng, 300))]
    rows += rows[-5:]
    for chunk in (variants.CHUNK, 7):
        assert of(variants.spelling_variants(docs(spark, rows), chunk=chunk)) == plain(counted(rows))


def test_chains_end_at_their_root(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "ccccc": 3}
    rows = [(0, " ".join(w for w, k in n.items() for _ in range(k)), *[None] * 7)]
    if counted(rows) != n:  # a word lost a letter: another document
        rows = [(i, rows[0][1], *[None] * 7) for i in range(1, 60)]
        rows = next([r] for r in rows if counted([r]) == n)
    out = {r[0]: r for r in of(variants.spelling_variants(docs(spark, rows)))}
    assert {out[w][2] for w in n if w != "ccccc"} == {"bbbbb"} and out["ccccc"][1:3] == (None, "ccccc")


def test_checksums_shift():
    heads = np.array([zlib.crc32(x) for x in (b"1:", b":", b"-7:")], np.uint32)
    table = variants.shifted(heads)
    for i, head in enumerate((b"1:", b":", b"-7:")):
        for tail in (b"a", b"hello", "été".encode(), b"x" * 47):
            assert table[len(tail), i] ^ zlib.crc32(tail) == zlib.crc32(head + tail)


def test_counts_in_small_helpings_are_the_same(spark, monkeypatch):
    rows = awkward()
    whole = variants.Counts()
    whole.add([str(r[0]) for r in rows], [r[1] for r in rows])
    want = Counter(dict(zip(*whole.drain())))
    got, part = Counter(), variants.Counts()
    for r in rows:
        part.add([str(r[0])], [r[1]])
        got.update(dict(zip(*part.drain())))
    assert got == want


def test_empty_table(spark):
    assert variants.spelling_variants(docs(spark, [])).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert of(queries.op12_spelling_variants(spark, SF)) == plain(counted(rows))
