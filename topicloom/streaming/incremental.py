"""Incremental extraction; only new texts are read, results stay merged.

Every micro-batch writes its facts to a folder of its own, with at least one row
per file. Readers take, per path, the rows of its newest batch, so a file that
comes again replaces its old facts, also when it has none any more. A repeated
batch overwrites its own folder: the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.functions import catalogue as cat
from topicloom.operators.extraction import topic_facts

STORE = "path string, analyzer string, pattern string, role string, token string, topic string, line int, col int, batch bigint"


def start_extract(
    files: DataFrame,
    store: str,
    checkpoint: str,
    patterns: Iterable[cat.Pattern] = cat.CATALOGUE,
    locate: bool = True,
) -> StreamingQuery:
    """Extract from all files that have arrived, then stop.

    ``files`` is a streaming (path, content); one text per path and batch. Run it
    again with the same folders to go on where the last run ended. Both folders
    belong on storage that all executors share.
    """
    patterns = tuple(patterns)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = topic_facts(batch, patterns, locate, keep_files=True)
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_facts(spark: SparkSession, store: str) -> DataFrame:
    """Merged facts: per path those of its newest batch."""
    rows = spark.read.schema(STORE).parquet(store)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return (
        rows.join(newest, ["path", "batch"], "left_semi")
        .where(F.col("topic").isNotNull())
        .drop("batch")
    )


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the newest rows of every path as one batch of a fresh store, keeping
    the batch number so that later batches still replace them."""
    rows = spark.read.schema(STORE).parquet(store)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    kept = rows.join(newest, ["path", "batch"], "left_semi")
    kept.write.mode("overwrite").partitionBy("batch").parquet(target)
