"""Reading the input tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir

_KEPT: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit of a batch that goes to Python. An executor holds several copies of it for each task, and
#: 10,000 long texts (the other limit) are 20 MB and more.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES for the queries that start inside, unless the session sets their size."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: the lineage is cut, and
    they outlive the executors that made them. The shuffle files of the write go when it ends; the table
    goes when the driver ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        with small_batches(spark):
            df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _KEPT[path] = spark
    kept = spark.read.schema(df.schema).parquet(path)
    kept._corvane_path = path
    return kept


def drop(kept: DataFrame | None) -> None:
    """Removes a kept table that nothing reads any more."""
    path = getattr(kept, "_corvane_path", None)
    if path and _KEPT.pop(path, None) is not None:
        _remove(kept.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (one bigint column, doc_id). Up to BROADCAST_IDS
    ids, counted first, go to every executor and docs isn't shuffled; beyond, it is a shuffled join."""
    gone = keep(ids.select(F.col("doc_id").alias("_gone")), "ids")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")


@atexit.register
def _clean() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            _remove(spark, path)
        except Exception:  # the JVM has gone; its folder goes with the cluster's
            return
