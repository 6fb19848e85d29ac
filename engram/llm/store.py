"""Tables, and intermediate results on storage that every executor reaches."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of at most ``rows`` rows, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(rows, int(spark.conf.get(key))) if int(spark.conf.get(key)) > 0 else rows)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode with nothing set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/llm-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it again: lineage ends, and a lost executor costs nothing before it.

    The write's shuffle files go when it has ended, instead of when the driver next collects garbage. Who names the folder
    (see :func:`shared_folder`) may remove it when nothing reads it any more.
    """
    path = path or shared_folder(df.sparkSession)
    _write(df, lambda: df.write.parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, column: str, path: str) -> str:
    """As :func:`save`, bucketed by ``column`` so that joins on it shuffle only the other side; the name of the table, which the caller drops."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(df, lambda: df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name))
    return name


def _write(df: DataFrame, write) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        write()
    finally:
        spark.conf.set(_CLEANUP, before)


class Shared:
    """An object of bounded size, broadcast once; its classes travel with it."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._sent.value)
