"""Incremental corpus build with Structured Streaming.

The batch path (read blobs -> extract functions -> exact dedup -> tokens
-> folds -> write splits) as one streaming query: new blob files in a
folder are picked up, processed and appended to the fold folders. Exact
dedup keeps the first function seen per code digest across all batches, in
order of arrival, where the batch build keeps the smallest (repo, path,
line); the batch build also removes near duplicates, which needs all rows.
The state of ``dropDuplicates`` holds one digest per distinct function, so
use the RocksDB state store for large corpora. Folds are a
pure function of (repo, path), so a file lands in the same fold whichever
batch brings it. Run with ``availableNow`` to drain what is there and stop,
or with a processing-time trigger to keep following the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import docstring_tokens
from quarry.operators.extract import code_tokens, extract_functions
from quarry.operators.split import label_folds
from quarry.sources.io import BLOB_CSV_SCHEMA, CSV_OPTIONS


def corpus_stream(spark: SparkSession, blob_dir: str, *, dedup: bool = True,
                  max_files_per_trigger: int | None = None,
                  ratios: tuple[float, float, float, float] = (0.6, 0.15, 0.15, 0.1)) -> DataFrame:
    """Streaming DataFrame of corpus rows (functions with tokens and fold)."""
    reader = spark.readStream.schema(BLOB_CSV_SCHEMA).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(blob_dir)
    parts = F.split(F.trim(F.col("repo_path")), r"\s+")
    blobs = raw.select(parts.getItem(0).alias("repo"), parts.getItem(1).alias("path"), "content")
    funcs = extract_functions(blobs)
    if dedup:
        funcs = (funcs.withColumn("code_digest", F.sha2("code", 256))
                 .dropDuplicates(["code_digest"]).drop("code_digest"))
    tokens = code_tokens("code")
    out = (funcs.withColumn("t", tokens)
           .select("repo", "path", "lineno", "func_name", "language", "code",
                   F.col("t.code_tokens").alias("code_tokens"),
                   F.col("t.comment_tokens").alias("comment_tokens"),
                   "docstring", docstring_tokens("docstring").alias("docstring_tokens"))
           .dropna(subset=["code_tokens", "comment_tokens", "docstring_tokens"]))
    return label_folds(out, *ratios)


def start_corpus_stream(spark: SparkSession, blob_dir: str, out_dir: str, checkpoint_dir: str, *,
                        available_now: bool = True, processing_time: str | None = None,
                        dedup: bool = True) -> StreamingQuery:
    """Start the stream writing JSON lines under ``out_dir/partition=<fold>``."""
    writer = (corpus_stream(spark, blob_dir, dedup=dedup).writeStream
              .format("json").partitionBy("partition")
              .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
