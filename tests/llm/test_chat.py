import hashlib
from collections import defaultdict

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from matchfold.llm import chat
from tests.llm.data import SF

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_turns long"
TRICKY = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>hi<|end|>\n", "\\", "<", "|>", "", "  lead and trail \n\n", "日本 😀 é", "<\\|end|>", "a\x00b", "\\\\<|", "x" * 3000]


def tokenizer():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|b\n", ""]), st.text(st.sampled_from("\\<|>turnexd \n"), max_size=20)), max_size=5))
def test_rendering_reads_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_token_ranges_against_all_pairs():
    offsets = [(0, 2), (2, 3), (3, 3), (3, 7), (7, 8), (7, 8), (8, 12)]
    spans = [(0, 1), (2, 3), (3, 8), (11, 12)]
    for (a, b), (i, j) in zip(spans, chat.token_ranges(spans, offsets)):
        hit = [k for k, (s, e) in enumerate(offsets) if s < b and e > a]
        assert (hit[0], hit[-1] + 1) == (i, j)


def check(spark, rows):
    out = chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), tokenizer())).collect()
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    got = {r["conv_id"]: r for r in out}
    assert len(out) == len(got) and set(got) == set(convs)
    for c, rs in convs.items():
        rs = sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        assert got[c]["n_turns"] == len(rs)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(said)
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_awkward_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], TRICKY[(c + t) % len(TRICKY)], "f", 0) for c in range(12) for t in range(5)]
    rows += [(50, 1, "assistant", None, None, None), (50, None, None, "x", None, None), (50, 1, "assistant", None, None, None), (None, 0, "assistant", "null id", None, None), (2**60 + 1, 0, "assistant", "far id", None, None)]
    check(spark, rows)


def test_real_conversations(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"], None, None) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA), tokenizer()).count() == 0
