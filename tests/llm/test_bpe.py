import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from matchfold.llm import bpe
from tests.llm.data import SF, awkward, docs

PIECES = ["a", "the", "tion", "Ġ", "é", "1", " ", "  ", "\n", "\t", "'s", "'", "ﬁ", "𝒳", "½", "\x1c", "\x85", "　", "日本", "😀", "!", "'LL", "====", "\xa0", "́", "\r\n", "don't", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size, arc_after", [(60_000, 32), (60_000, 1), (40, 1), (40, 2)])
def test_random_texts_encode_like_the_library(ranks, reference, size, arc_after):
    enc = bpe.TextEncoder(ranks, P.PATTERN, max_cached=50)
    enc.machine.max_states = enc.machine.max_pairs = size  # small tables are emptied often
    enc.machine.ARC_AFTER = arc_after  # 1: no piece is worked out without arcs
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert ids == reference.encode_ordinary(t), t


def test_lookahead_is_bounded(ranks):
    m = bpe.MergeTransducer(ranks)
    m.ARC_AFTER = 1
    for _ in range(2):
        assert [x for x in m.encode(b"anonandthtiondthrelyes" * 40)]
    longest = max(map(len, ranks))
    assert all(len(s[1]) <= longest for s in m._states)


def test_utf8_machine_decodes_any_bytes_like_python(ranks):
    dec = bpe.Utf8Machine({v: k for k, v in ranks.items()})
    rng = random.Random(4)
    pool = [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xC0, 0xED, 0xA0, 0xF4, 0x90]
    for _ in range(4000):
        b = bytes(rng.choice(pool) for _ in range(rng.randint(0, 8)))
        ids = np.array([ranks[bytes((x,))] for x in b], "<u4")
        assert dec.decode(ids) == b.decode("utf-8", "replace")


def test_rows_round_trip(spark, reference):
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode_documents(bpe.encode_documents(docs(spark), path, P.PATTERN), path).collect()
    both = bpe.round_trip(docs(spark), path, P.PATTERN)
    assert str(both._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    assert len(out) == both.count() == len(awkward())
    for r in out + both.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "")


def test_empty_table_and_real_texts(spark, reference):
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.encode_documents(docs(spark, []), path, P.PATTERN).count() == 0
    assert bpe.round_trip(docs(spark, []), path, P.PATTERN).collect() == []
    d = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 7 == 0)
    for r in bpe.encode_documents(d, path, P.PATTERN).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == reference.encode_ordinary(r["text"])
