"""The pipeline's five stages on awkward rows, each against a plain model of its rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

from matchfold.llm import queries, toxicity
from matchfold.llm.bpe import read_ranks
from matchfold.llm.common import fold
from tests.llm.data import awkward, labels
from tests.llm.test_mixing import brute

#: Names that helper columns have, or had: a user's columns of any name stay as they are.
CLASHING = ["_gone", "_key", "_s", "_score", "_n", "_size", "_copy", "_d", "_k", "_rows", "_times", "_nth", "_tox", "row", "id", "key", "gone_id", "label", "digest"]


def table(spark, rows):
    made = [(*r[:4], i, *[f"{c}{i % 5}" for c in CLASHING]) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table(spark, awkward()).write.parquet(f"{path}/documents.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_model(rows):
    """One row of each class: the least id (null last); rows of equal id and text are one."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i) if sets[i] else ("alone", i), []).append(r)
    return list(out.values())


def test_toxicity_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), labels(spark), fold("doc_id", 5) != 0).collect()
    toxic = {(r["doc_id"], r["text"]) for r in scored if r["score"] >= 0.5}
    assert kept.columns == docs.columns
    assert rows_of(kept) == [r for r in rows_of(docs) if (r[0], r[1]) not in toxic]


def test_exact_stage(spark):
    docs = table(spark, awkward())
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = rows_of(kept)
    assert set(got) <= set(rows_of(docs)) and len(set(got)) == len(got)
    groups = {}
    for r in awkward():
        groups.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
    assert sorted(((r[1] or ""), -1 if r[0] is None else r[0]) for r in got) == sorted((t, max(ids)) for t, ids in groups.items())


def test_near_stage(spark):
    docs = table(spark, awkward())
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = rows_of(kept)
    assert set(got) <= set(rows_of(docs)) and len(set(got)) == len(got)
    want = []
    for group in near_model(awkward()):
        if len(group) == 1:
            want.append(group[0][:2])
        else:
            want.append((min((r[0] is None, r[0] or 0) for r in group), "class"))
    alone = [w for w in want if w[1] != "class"]
    least = [w[0] for w in want if w[1] == "class"]
    assert Counter(r[:2] for r in got if not any((r[0] is None, r[0] or 0) == x and r[:2] not in alone for x in least)) == Counter(alone)
    assert len(got) == len(want)


def test_mixing_stage(spark):
    docs = table(spark, awkward())
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    got = rows_of(mixed)
    assert set(got) <= set(rows_of(docs))
    taken = Counter()
    for r, (_, _, n, _, _, t) in zip(awkward(), brute(awkward())):
        if n:
            taken[r[0], r[3], n] += t // n
    have = Counter((r[0], r[3], len((r[1] or "").encode().split())) for r in got)
    assert have == Counter({k: v for k, v in taken.items() if v})


def test_whole_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, frame = None, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, folder).collect(), docs.schema)
    enc = tiktoken.Encoding("t", pat_str=queries.pattern(), mergeable_ranks=read_ranks(queries.vocabulary()), special_tokens={})
    want = Counter()
    for r in frame.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want and want


def test_empty_table(spark, folder, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for t in (folder, tmp_path):
        lab = spark.read.parquet(f"{folder}/labels.parquet")
        if t is tmp_path:
            lab.write.parquet(f"{tmp_path}/labels.parquet")
            assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels(spark, tmp_path):
    table(spark, awkward()[:20]).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.agg(F.count("*")).first()[0] == 20
