"""Operator 7: chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is

    <|turn|>ROLE<|text|>TEXT<|end|>NEWLINE

Inside roles and texts every backslash is doubled and a backslash is put between "<"
and "|", so the control strings occur only where the template puts them, and reading
back undoes it.  The rendering is tokenized once, with offsets.  The spans of assistant
texts (in order) and the token offsets (in order) are intersected by binary search:
each span maps to a range of tokens under the loss, and to the exact characters.

Conversations are rendered turn by turn from rows sorted by (conversation, turn), so
a task holds one conversation's rendering at a time and not its rows as well.  One conversation is one output
row, which bounds how far it can be spread.

Rows: turns are ordered by turn (null first), then role, then text; repeated rows are
turns of their own.  Null role or text is the empty string; a null conversation id is
an id like any other.  A conversation of empty texts has markers only and no loss.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(turns: list[tuple[str, str]], learn_from: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the character spans of the texts to learn from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn_from and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def token_ranges(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the tokens [first, last) that share a character with it."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    return [(bisect_right(ends, a), bisect_left(starts, b)) for a, b in spans]


def masked_text(formatted: str, spans, ranges, offsets) -> str:
    """Unescaped text under the loss: what the tokens of each range cover of their span."""
    out = []
    for (a, b), (i, j) in zip(spans, ranges):
        if i < j:
            out.append(formatted[max(a, offsets[i][0]) : min(b, offsets[j - 1][1])])
    return unescape("".join(out))


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


FORMATTED = (
    "n_turns long, formatted string, token_ids array<int>, loss_spans array<struct<start: int, end: int>>, "
    "loss_tokens array<struct<start: int, end: int>>, loss_text string"
)


def format_conversations(rows: DataFrame, tokenizer_json: str, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id and the columns of FORMATTED.

    ``tokenizer_json`` is the text of a tokenizer file of the tokenizers library.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    # ids travel as text, so that null and large ids survive pandas
    ids = F.col("conv_id").cast("string").alias("conv_id")
    ordered = rows.select(ids, "turn", *text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from tokenizers import Tokenizer, processors

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(sent.value)
        tokenizer.encode_special_tokens = True
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep leading spaces

        def done(conv, turns) -> tuple:
            formatted, spans = render(turns, learn_from)
            enc = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = enc.offsets
            ranges = token_ranges(spans, offsets)
            pairs = [[{"start": a, "end": b} for a, b in x] for x in (spans, ranges)]
            return conv, len(read_back(formatted)), formatted, enc.ids, *pairs, masked_text(formatted, spans, ranges, offsets)

        names = ["conv_id", "n_turns", "formatted", "token_ids", "loss_spans", "loss_tokens", "loss_text"]
        now, turns, out, size = object(), [], [], 0
        for pdf in batches:
            for conv, role, body in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                if conv != now:
                    if turns:
                        out.append(done(now, turns))
                        size += len(out[-1][2])
                        if size > 8_000_000:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
                    now, turns = conv, []
                turns.append((role, body))
        if turns:
            out.append(done(now, turns))
        if out:
            yield pd.DataFrame(out, columns=names)

    out = ordered.mapInPandas(run, f"conv_id string, {FORMATTED}")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss read back from the output, as counts and SHA-256."""

    @F.pandas_udf("turns_sha256 string")
    def turns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for x in s:
                h = hashlib.sha256()
                for role, body in read_back(x):
                    h.update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                out.append(h.hexdigest())
            yield pd.DataFrame({"turns_sha256": out})

    return formatted.select(
        "conv_id",
        "n_turns",
        turns("formatted").getField("turns_sha256").alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("token_ids").cast("long").alias("n_tokens"),
    )
