"""Operator 6: exact dedup by progressive refinement.

Rows are grouped by byte length, then by length and the hash of a prefix, then by the
SHA-256 of the whole text; each step keeps only groups of two or more, so the full
hash is taken only of rows that still have a possible twin.  Groups are counted by
``groupBy`` (partial counts before the shuffle) and only narrow keys are shuffled.

Rows: a null text counts as empty.  Every input row is returned once, repeated rows
and rows with a null or repeated ``doc_id`` too.  The row with the largest doc_id of a
group stays (a null id is the smallest); among rows with that same id one stays.
Only ``doc_id`` and ``text`` are read, other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.llm.common import BROADCAST_KEYS, boxed, keys_join, materialise

PREFIX_BYTES = 256


def exact_duplicates(docs: DataFrame, prefix_bytes: int = PREFIX_BYTES, digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    ``text_sha256`` is null for rows that no twin survived to the last step, unless
    ``digest_all``.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        raw.alias("_raw"),
        F.octet_length(raw).alias("_len"),
        F.xxhash64(F.substring(raw, 1, prefix_bytes)).alias("_head"),
    )
    # lengths met once are over; prefixes are hashed only of the others
    lengths = materialise(rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"), "exact-lengths")
    heads = keys_join(rows.select("_len", "_head"), lengths, ["_len"]).groupBy("_len", "_head").agg(F.count("*").alias("_n"))
    twins = materialise(heads.where("_n > 1").select("_len", "_head", F.lit(True).alias("_twin")), "exact-twins")
    full = F.sha2("_raw", 256)
    hashed = keys_join(rows, twins, ["_len", "_head"], "left").select(
        "doc_id",
        F.coalesce("_twin", F.lit(False)).alias("_twin"),
        (full if digest_all else F.when(F.col("_twin"), full)).alias("text_sha256"),
    )
    hashed = materialise(hashed, "exact-hashes")
    # one row stays: the largest id, and among rows that share it the first by an arbitrary fixed number
    numbered = hashed.where("_twin").select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("_row"))
    numbered = materialise(numbered, "exact-rows")
    group = numbered.groupBy("text_sha256").agg(
        F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row")).alias("_top"), F.count("*").alias("group_size")
    )
    group = group.select("text_sha256", "group_size", F.col("_top.doc_id").alias("keep_id"), F.col("_top._row").alias("_keep"))
    # stored first, so that the join is a stage of its own and a hot group of copies can be split
    group = materialise(group.where("group_size > 1"), "exact-groups")
    shared = keys_join(numbered, group, ["text_sha256"], "left", limit=200_000).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep").isNull() | (F.col("_keep") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
    single = hashed.where("not _twin").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return shared.unionByName(single)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    One row of each group of equal texts, the one with the largest doc_id.  A row goes by its
    id and the digest of its whole text; the digest is taken only of rows whose id is to go.
    """
    out = materialise(exact_duplicates(docs).where("not kept").select("doc_id", "keep_id", "text_sha256"), "exact-out")
    named = [F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")]
    other = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = materialise(out.where(~other).select(*named).distinct(), "exact-gone")
    same = materialise(out.where(other).select(*named).distinct(), "exact-same")
    digest = F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)

    def by_digest(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = keys.limit(BROADCAST_KEYS // 8 + 1).count() <= BROADCAST_KEYS // 8
        # not an equality, so that it is looked at only for rows of that id
        same_text = F.array_contains(F.array("gone_text"), digest)
        return rows.join(F.broadcast(keys) if few else keys.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & same_text, how)

    left = by_digest(boxed(docs, id=F.col("doc_id")), gone, "left_anti")
    if same.isEmpty():
        return left.select("row.*")
    # rows that share the id that stays: the one of the smallest hash of all its columns
    again = by_digest(left, same, "left_semi").groupBy("id", digest.alias("digest")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return by_digest(left, same, "left_anti").select("row.*").unionByName(again.select("row.*"))
