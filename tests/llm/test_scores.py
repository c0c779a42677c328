"""Language id, language model, quality rules, toxicity and quality."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from matchfold.llm import bands, interpolation, langid, qda, toxicity
from matchfold.llm.common import fold
from tests.llm.data import SF, awkward, crc, docs, labels, prose


#: the smallest table with enough labels of every language to learn toxicity from
LARGER = "/root/testdata/sf0.1"


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


# language id


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    rng = np.random.default_rng(1)
    table = rng.random((len(vocabulary), 2))
    m = langid.Languages(["x", "y"], [0.5, 0.5], table, vocabulary)

    def every(s):
        if not s:
            return np.ones(2)
        return sum([(table[vocabulary.index(s[:k])] if s[:k] in vocabulary else np.full(2, langid.UNKNOWN) * (k == 1)) * every(s[k:]) for k in range(1, len(s) + 1)])

    for w in ("a", "ab", "abab", "bca", "ccc"):
        assert np.allclose(m.log_probability([w])[0], np.log(every("▁" + w)))


def test_em_raises_the_likelihood():
    vocabulary = ["▁", "a", "b", "ab", "▁ab"]
    counts, lattice = [("ab", 5), ("aab", 2), ("ba", 1)], langid.Lattice(vocabulary)
    value = []
    for rounds in (1, 2, 4, 8):
        p = langid.learn_pieces(counts, lattice, len(vocabulary), rounds, alpha=1e-9)
        m = langid.Languages(["x"], [1.0], p[:, None], vocabulary)
        value.append(sum(n * m.log_probability([w])[0][0] for w, n in counts))
    assert value == sorted(value)


def test_languages_of_held_out_rows(spark):
    d = real(spark)
    out = langid.identify_languages(d, fold("doc_id", 5) != 0, P.path("piece_bpe_32k.model"), max_rows=60)
    held = out.join(d, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_awkward_rows(spark):
    out = langid.identify_languages(docs(spark), F.lit(True), P.path("piece_bpe_32k.model"), max_rows=20).collect()
    assert len(out) == len(awkward())
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und" and r["doc_id"] is not None}
    assert und == {0, 1, 2, 6}
    assert langid.identify_languages(docs(spark, []), F.lit(True), P.path("piece_bpe_32k.model")).count() == 0
    none = langid.identify_languages(docs(spark), F.lit(False), P.path("piece_bpe_32k.model")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


# language model


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [None]


@pytest.mark.parametrize("rows", ["awkward", "real"])
def test_model_against_brute_force(spark, rows):
    if rows == "awkward":
        table, d = [(r[0], r[1]) for r in awkward()], docs(spark)
    else:
        d = real(spark)
        table = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    part = fold("doc_id", 7)
    out = interpolation.interpolated_scores(d, part != 2, part == 3).collect()
    uni = Counter(t for i, x in table if crc(i, 7) != 2 for t in tokens(x))
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for i, x in table:
        ts = tokens(x)
        base = sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in ts)
        want[i, len(ts), sum(t in uni for t in ts), n, round(base, 5)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out)
    assert got == want
    held = [r for r in out if crc(r["doc_id"], 7) == 2]
    if rows == "real":
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mixture_is_a_distribution(spark, monkeypatch):
    """Scores against the formula, with the learned weights, and the sum over all words."""
    kept = {}
    solve = interpolation.weights_by_em
    monkeypatch.setattr(interpolation, "weights_by_em", lambda *a: kept.setdefault("w", solve(*a)))
    table = [(r[0], r[1]) for r in awkward()]
    part = fold("doc_id", 7)
    out = interpolation.interpolated_scores(docs(spark), part != 2, part == 3).collect()
    w = kept["w"]
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    train = [tokens(x) for i, x in table if crc(i, 7) != 2]
    uni, pair, context = Counter(), Counter(), Counter()
    for ts in train:
        uni.update(ts)
        pair.update(zip(["start", *ts], ts))
        context.update(["start", *ts[:-1]])
    n, v = sum(uni.values()), len(uni)

    def p(h, t):
        a, b, c = w[int(interpolation.bucket(np.array([context[h]]))[0])]
        return a * (pair[h, t] / context[h] if context[h] else 0) + b * uni[t] / n + c / (v + 1)

    for h in ("start", b"one", b"th", b"never"):
        assert math.isclose(sum(p(h, t) for t in uni) + p(h, b"unknown word"), 1, rel_tol=1e-9)
    want = Counter((i, round(sum(math.log10(p(h, t)) for h, t in zip(["start", *tokens(x)], tokens(x))), 4)) for i, x in table)
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in out) == want


def test_model_of_an_empty_table(spark):
    assert interpolation.interpolated_scores(docs(spark, []), F.lit(True), F.lit(False)).count() == 0
    out = interpolation.interpolated_scores(docs(spark), F.lit(False), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in out)


# quality rules


def test_bands_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward()] + [(100, "a b c d e f g h i a b c d e f g h q " * 3), (101, "x\ny\nx\n\n\nx"), (102, ("la " * 400))]
    d = docs(spark, [r + (None,) * 7 for r in rows])
    out = bands.compression_bands(d).collect()
    assert len(out) == len(rows)
    want = Counter()
    for i, t in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        often = Counter(wins)
        hit = {k + j for k, x in enumerate(wins) if often[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        want[i, len(ws), sum(map(len, ws)), sum(c in bands.SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    by = {r["doc_id"]: r for r in out}
    assert not by[102]["kept"] and not by[14]["kept"] and by[11]["kept"] and not any(r["kept"] and r["base_failed"] for r in out)


def test_bands_keep_good_documents_and_reject_noise(spark):
    import base64
    import random

    good = bands.compression_bands(real(spark)).join(real(spark, "labels"), "doc_id").where("quality = 1 and not base_failed").collect()
    assert np.mean([r["kept"] for r in good]) > 0.995
    noise = base64.b64encode(random.Random(1).randbytes(6000)).decode()
    noise = " ".join(noise[i : i + 12] for i in range(0, len(noise), 12))
    out = bands.compression_bands(docs(spark, [(1, noise) + (None,) * 7, (2, "spam ham " * 900) + (None,) * 7])).collect()
    assert [r["kept"] for r in out] == [False, False]
    assert bands.compression_bands(docs(spark, [])).count() == 0


def noise_words(rng, size, printable):
    import base64

    s = "".join(chr(rng.randint(33, 126)) for _ in range(size)) if printable else base64.b64encode(rng.randbytes(size)).decode()
    return " ".join(s[i : i + 6] for i in range(0, len(s), 6))[:size]


def test_bands_reject_noise_of_every_size_and_keep_prose(spark):
    import random

    import zstandard

    rng, c = random.Random(4), zstandard.ZstdCompressor(level=3)
    ends = [start - 1 for start, _, _ in bands.BANDS[2:]] + [220, 400, 1000, 2000, 3000, 4000, 8000, 12000, 30000, 200_000]
    for size in ends:
        for printable in (False, True):
            assert not any(bands.judge(c, noise_words(rng, size, printable))[6] for _ in range(10)), (size, printable)
    texts = [r["text"] for r in real(spark).join(real(spark, "labels"), "doc_id").where("quality = 1 and text is not null").collect()]
    for start, low, _ in bands.BANDS[1:]:
        cut = [t.encode()[:start] for t in texts if len(t.encode()) >= start]
        assert not cut or np.mean([bands.ratio(c, x) >= low for x in cut]) > 0.99, start


def test_bands_reject_long_documents_that_are_half_noise(spark):
    import random

    import zstandard

    rng, c = random.Random(6), zstandard.ZstdCompressor(level=3)
    long = [r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").where("length(text) between 9000 and 20000").orderBy("doc_id").limit(40).collect()]
    long = [t for t in long if bands.judge(c, t)[6]]
    assert len(long) >= 30
    for t in long:
        half = len(t) // 2
        assert not bands.judge(c, t[:half] + " " + noise_words(rng, len(t.encode()) - half, False))[6]


def test_long_words_are_summed_whole():
    vocabulary = ["▁a", "a", "b", "ab", "aab", "▁"]
    rng = np.random.default_rng(4)
    table = rng.dirichlet(np.ones(len(vocabulary)), 2).T
    m = langid.Languages(["x", "y"], [0.5, 0.5], table, vocabulary)
    for word in ("ab" * 20, "aabbc" * 9, "a" * 33, "b" * 700, "abq" * 3000):
        got = m.log_probability([word, "ab"])
        # the plain forward sum, with numbers that hold any size
        from fractions import Fraction

        if len(word) < 60:
            s, ahead = "▁" + word, [[Fraction(1)] * 2]
            for j in range(1, len(s) + 1):
                row = [Fraction(0)] * 2
                for i in range(max(0, j - 3), j):
                    x = s[i:j]
                    p = table[vocabulary.index(x)] if x in vocabulary else [langid.UNKNOWN if j - i == 1 else 0] * 2
                    row = [r + ahead[i][k] * Fraction(float(p[k])) for k, r in enumerate(row)]
                ahead.append(row)
            assert np.allclose(got[0], [float(np.log(float(x * 10**280))) - 280 * np.log(10) for x in ahead[-1]])
        assert np.isfinite(got).all()


def test_long_and_short_lattices_agree():
    vocabulary = ["▁a", "a", "b", "ab", "aab", "▁", "ba"]
    rng = np.random.default_rng(4)
    counts = [("".join(rng.choice(list("abc"), rng.integers(1, 30))), int(rng.integers(1, 5))) for _ in range(30)]
    lattice = langid.Lattice(vocabulary)
    want = langid.learn_pieces(counts, lattice, len(vocabulary))
    long = langid.LONG
    try:
        langid.LONG = 0
        got = langid.learn_pieces(counts, lattice, len(vocabulary))
    finally:
        langid.LONG = long
    assert np.allclose(got, want)


# toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(30)]
    bag = lambda: Counter(rng.choice(vocabulary, rng.integers(0, 6)).tolist())
    vectors = [bag() for _ in range(300)]
    index = toxicity.Examples(vectors, [int(x) for x in rng.integers(0, 2, 300)], vocabulary, {0: 0.8, 1: 0.2}, block=16)
    dense = np.zeros((300, 30))
    for i, v in enumerate(vectors):
        for t, w in index.weights(v).items():
            dense[i, t] = w
    for _ in range(200):
        q = index.weights(bag())
        sims = np.round(sum((w * dense[:, t] for t, w in q.items()), np.zeros(300)), 9)
        want = [(s, i) for s, i in sorted(zip(sims.tolist(), range(300)), key=lambda x: (-x[0], x[1])) if s > 0][:15]
        assert index.nearest(q) == want


def test_toxicity_of_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"{LARGER}/{x}.parquet") for x in ("documents", "labels"))
    out = toxicity.toxicity_scores(d.select("doc_id", "text"), lab, fold("doc_id", 5) != 0)
    held = out.join(lab, "doc_id").where(fold("doc_id", 5) == 0).collect()
    y, s = [r["toxic"] for r in held], [r["score"] for r in held]
    # some toxic labels of this table mark texts without any toxic word
    assert auc(y, s) > 0.93
    assert np.mean([(a >= 0.5) == b for a, b in zip(s, y)]) > 0.96
    assert np.mean([a >= 0.5 for a, b in zip(s, y) if not b]) < 0.01


@pytest.mark.parametrize("table, least_auc, least_right", [(LARGER, 0.97, 0.98), (SF, 0.97, 0.97)])
def test_toxicity_learns_from_few_rows(spark, table, least_auc, least_right):
    d, lab = (spark.read.parquet(f"{table}/{x}.parquet") for x in ("documents", "labels"))
    out = toxicity.toxicity_scores(d.select("doc_id", "text"), lab, fold("doc_id", 5) != 0)
    held = out.join(lab, "doc_id").where(fold("doc_id", 5) == 0).collect()
    y, s = [r["toxic"] for r in held], [r["score"] for r in held]
    assert auc(y, s) > least_auc
    assert np.mean([(a >= 0.5) == b for a, b in zip(s, y)]) > least_right


def test_toxicity_of_a_rare_group(spark):
    """A word of 1% of the toxic rows, and of no other row, marks toxic texts."""
    import random

    rng = random.Random(3)
    common = ["idiot", "scum", "moron", "trash"]
    said = [(0, "")] * 2000 + [(1, None)] * 1980 + [(1, "zottel")] * 20 + [(0, "")] * 40 + [(1, "zottel")] * 40
    rows = [(i, f"{prose(rng, 120)} {' '.join(rng.sample(common, 2)) if w is None else w}", y) for i, (y, w) in enumerate(said)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(d, lab, F.col("doc_id") < 4000).where("doc_id >= 4000").collect()
    assert len(out) == 80 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] >= 4040) for r in out]) > 0.95


def test_awkward_rows_get_scores(spark):
    d, lab = docs(spark), labels(spark)
    for fit, column in ((toxicity.toxicity_scores, "score"), (qda.quality_scores, "score")):
        out = fit(d, lab, fold("doc_id", 5) != 0).collect()
        assert len(out) == len(awkward()) and all(0 <= r[column] <= 1 for r in out)
        assert fit(docs(spark, []), lab, F.lit(True)).count() == 0
        none = fit(d, labels(spark, []), F.lit(True)).collect()
        assert len(none) == len(awkward()) and all(0 <= r[column] <= 1 for r in none)
        one = fit(d, labels(spark, [(9, 1, 1), (20, 1, 1)]), F.lit(True)).collect()
        assert all(0 <= r[column] <= 1 for r in one)


# quality


def test_quality_of_held_out_rows(spark):
    out = qda.quality_scores(real(spark), real(spark, "labels"), fold("doc_id", 5) != 0)
    held = out.join(real(spark, "labels"), "doc_id").where(fold("doc_id", 5) == 0).collect()
    y, s = [r["quality"] for r in held], [r["score"] for r in held]
    assert auc(y, s) > 0.95
    assert np.mean([(a >= 0.3) == b for a, b in zip(s, y)]) > 0.93


def test_moments_and_densities(spark):
    rng = np.random.default_rng(2)
    d = len(qda.FEATURES)
    x = [rng.normal(y, 1 + y, d).tolist() for y in (0, 1) * 60]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(x)], "y int, x array<double>").repartition(3)
    got = qda.moments(rows)
    a = np.array(x)
    for y in (0, 1):
        part = a[y::2]
        assert got[y][0] == 60 and np.allclose(got[y][1], part.sum(0)) and np.allclose(got[y][2], part.T @ part)
    m = qda.Discriminant(got, to_pooled=0.0, to_identity=0.0)
    cov = [np.cov(a[y::2].T, bias=True) for y in (0, 1)]
    z = rng.normal(0.5, 1, (5, d))
    dens = [[-0.5 * (v - a[y::2].mean(0)) @ np.linalg.solve(cov[y], v - a[y::2].mean(0)) - 0.5 * np.linalg.slogdet(cov[y])[1] for y in (0, 1)] for v in z]
    assert np.allclose(m.scores(z), [1 / (1 + np.exp(p - q)) for p, q in dens], atol=1e-3)
