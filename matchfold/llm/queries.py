"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.llm import bands, bpe, chat, exact, interpolation, jaccard, langid, mixing, qda, repair, toxicity, variants, warc
from matchfold.llm import sql
from matchfold.llm.common import fold, table


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame) -> DataFrame:
    out = bpe.round_trip(docs.select("doc_id", "text"), vocabulary(), pattern())
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    out = langid.identify_languages(docs, ~held, vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), fold("doc_id", 7)
    out = interpolation.interpolated_scores(docs, train=part != 2, tune=part == 3)
    return out.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bands.compression_bands(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return rows.unionByName(extra)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return chat.digests(chat.format_conversations(conversations(spark, sf_dir), tokenizer))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    out = qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_conversations(rows, F.col("live")).drop("repaired")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages carry no time: one is captured each second, in order of their ids
    captured = F.lit(1_577_836_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    index = warc.archive_index(table(spark, sf_dir, "pages"), captured)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_compression_bands": op4_compression_bands,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS slot
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
            FROM d GROUP BY source
        ), c AS (
            SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM s
        ), f AS (
            SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM c WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), g AS (
            SELECT source, source_size,
                   CASE WHEN cap <= level * w THEN cap
                        ELSE w * max(CASE WHEN cap > level * w THEN level END) OVER () END AS target
            FROM f
        ), q AS (
            SELECT d.*, g.source_size, g.target,
                   sum(size) OVER (PARTITION BY d.source ORDER BY slot, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), i AS (
            SELECT doc_id, source, size, slot, (e * source_size + upto) / target AS finish
            FROM q, (VALUES (0), (1)) AS t(e) WHERE size > 0
        ), o AS (
            SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, slot, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM i
        ), t AS (
            SELECT doc_id, sum(size) AS taken FROM o
            WHERE ahead < (SELECT floor(sum(source_size) * 1.5 + 0.5) FROM g) GROUP BY doc_id
        )
        SELECT q.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN t ON q.doc_id = t.doc_id
    """,
    "op11_conversation_repair": sql.CONVERSATION_REPAIR,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
}
