"""Structured Streaming driver for incremental updates.

The result of an update depends on batch boundaries (a batch and the same rows as a
sequence can differ), so a batch is declared by its producer: the files below
``source_dir/batch=<n>/`` are batch n, however many files that is and whichever
micro-batches deliver them together.  Batches of one micro-batch are folded in ascending order.

The store's ledger keeps, for each source folder, the files that were folded.  A file seen
before is a replay (at-least-once delivery, a new checkpoint over the same folder) and is
skipped.  A file not seen before is folded whenever it comes: a file that joins a batch
folded earlier, the rest of a folder that was still being written, or a batch of a lower
number are arrivals of their own, folded after what was there.  To have a batch folded as one,
a producer moves its finished folder into place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.functions.normalise import normalise_descriptions
from matchfold.operators.materialise import materialise
from matchfold.operators.validate import split_valid
from matchfold.sources.payload import parse_description_text
from matchfold.sources.store import StateStore


def description_stream(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    """Streaming DataFrame of raw descriptions from JSON-lines files, with their ``batch`` and ``_file``."""
    reader = spark.readStream.schema("value string, batch long").format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(source_dir).select("*", F.col("_metadata.file_path").alias("_file"))
    return parse_description_text(lines, type_errors=True)


def stream_updates(
    spark: SparkSession,
    source_dir: str,
    store: StateStore,
    checkpoint_location: str,
    rejects_dir: str | None = None,
    available_now: bool = True,
    max_files: int | None = None,
):
    """Run (or start) the update stream.  With ``available_now`` the call returns
    after everything present at start has been folded in.  ``max_files`` bounds a micro-batch."""

    def apply(micro_batch: DataFrame, micro_batch_id: int) -> None:
        files = micro_batch.select("batch", F.col("_file").alias("arrival")).distinct()
        files = materialise(files.join(store.folded(files.select("arrival"), source_dir), "arrival", "left_anti"), "arrivals")
        # one number per batch folder of the micro-batch, each with a digest of its new files
        names = F.md5(F.array_join(F.sort_array(F.collect_list("arrival")), "\n"))
        found = files.groupBy("batch").agg(names.alias("name")).orderBy("batch").collect()
        if found and found[0].batch is None:
            raise ValueError(f"files outside a batch=<n> folder below {source_dir}")
        for n, name in found:
            arrivals = files.where(F.col("batch") == n).select("arrival")
            rows = micro_batch.where(F.col("batch") == n).join(arrivals, F.col("_file") == F.col("arrival"), "left_semi").drop("_file")
            valid, rejected = split_valid(rows, "update")
            if rejects_dir:  # a replay writes the same folder again
                rejected.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{rejects_dir}/arrival={name}")
            store.update(normalise_descriptions(valid), batch_id=n, stream=source_dir, arrivals=arrivals)

    writer = (
        description_stream(spark, source_dir, max_files)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.start()
