"""The corpus pipeline: toxicity filter, exact dedup, near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of documents; the last returns one row per document with its tokens' digests.
A document that the mix takes twice is two rows from there on.

Rows: columns of any name pass through unchanged; only doc_id, text and source are looked
at.  A null text counts as empty: it gets the prior toxicity, is a copy of every other empty
text, has no near copies, size 0 and so no place in the mix.  Whole texts are read.  Null
and repeated ids are rows like any other: of equal texts the row with the largest id stays
(null is the smallest) and of rows that agree in both one.  Among near copies the smallest
id stays (null is the largest).  A null source is the last one.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.llm import exact, jaccard, mixing, queries, toxicity
from matchfold.llm.common import fold, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, learned as in the operator's query."""
    labels = table(spark, sf_dir, "labels")
    index, ids = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    score = toxicity.toxicity(F.col("text"), index, ids, spark).getField("score")
    return docs.where(score < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text."""
    return queries.bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Toxicity scores and byte-level BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
