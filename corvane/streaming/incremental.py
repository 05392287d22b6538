"""Incremental upkeep of a fact snapshot by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.extract import extract_facts


def snapshot_of(files: DataFrame) -> DataFrame:
    """Facts with the sha1 of the content that they come from."""
    hashes = files.select("path", F.sha1("content").alias("sha1"))
    return extract_facts(files).join(hashes, "path")


def watch(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follows Parquet batches of (path, content) in `source`: every batch writes the facts of its new or
    changed files to target/batch=<id>; a batch that is replayed overwrites itself. The state of a file
    is its rows in the greatest batch that has it (latest)."""
    stream = spark.readStream.schema("path string, content string").parquet(source)

    def apply(batch: DataFrame, batch_id: int) -> None:
        snapshot_of(batch.dropDuplicates(["path"])).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The facts of each path's last batch."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").drop("batch")
