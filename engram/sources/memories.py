"""Memory sources: typed scans, predicates, presets, snapshots and batch payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram import schemas
from engram.functions import metadata as md
from engram.operators.ranking import top_per_group

DEEP_TYPES = ("pinned", "insight")
PERIOD_TYPES = ("session",)
PROFILE_TYPES = ("fact", "insight", "pinned")
SNAPSHOT_FILE_ROWS = 50_000


def with_defaults(df: DataFrame) -> DataFrame:
    """Absent tags become an empty list; absent metadata stays null."""
    return df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_memories(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Typed memories; columns missing from the files read as null."""
    return with_defaults(spark.read.schema(schemas.MEMORY).format(fmt).load(path))


def in_source(
    types: tuple[str, ...], after: Column | None = None, before: Column | None = None
) -> Column:
    """Active rows of the given types inside [after, before]; reaches the Parquet scan as pushed filters."""
    test = (F.col("state") == "active") & F.col("memory_type").isin(*types)
    if after is not None:
        test &= F.col("created_at") >= after
    if before is not None:
        test &= F.col("created_at") <= before
    return test


def deep_memories(df: DataFrame) -> DataFrame:
    return df.filter(in_source(DEEP_TYPES))


def period_memories(df: DataFrame, after: Column, before: Column) -> DataFrame:
    return df.filter(in_source(PERIOD_TYPES, after, before)).filter(~reviewed_incorrect())


def profile_memories(df: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` profile memories per owner."""
    return top_per_group(
        df.filter(in_source(PROFILE_TYPES)), ["owner_id"], [F.desc("created_at"), F.asc("id")], limit
    )


def reviewed_incorrect() -> Column:
    """Session memories a reviewer marked as incorrect. Never null."""
    mark = F.get_json_object("metadata_json", "$.correctness")
    return F.coalesce((F.col("memory_type") == "session") & (mark == "incorrect"), F.lit(False))


def source_counts(df: DataFrame, types: tuple[str, ...], after=None, before=None) -> DataFrame:
    return df.filter(in_source(types, after, before)).groupBy("owner_id").agg(F.count(F.lit(1)).alias("count"))


def page_per_owner(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """The same page for every owner at once, with each owner's total."""
    totals = df.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_per_group(df, ["owner_id"], order, limit + offset, rank="place")
    # the page is bounded per owner, so the join moves little
    return ranked.filter(F.col("place") > offset).join(totals, "owner_id")


def write_listing(df: DataFrame, path: str, parts: int = 64) -> None:
    """Memories newest first (created_at, then id) in ``parts`` folders by range, and what each folder holds."""
    rows = df.repartitionByRange(parts, F.desc("created_at"), F.asc("id")).sortWithinPartitions(F.desc("created_at"), F.asc("id"))
    rows.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    held = df.sparkSession.read.parquet(f"{path}/rows").groupBy("part")
    # of the oldest time the largest id comes last
    held.agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(-F.unix_micros("created_at"), "id")).alias("last")).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/parts")


def page_after(spark: SparkSession, path: str, cursor: tuple | None, limit: int) -> DataFrame:
    """The ``limit`` memories of a listing that follow the cursor (created_at, id) of the page before, newest first.

    Only folders that can hold them are read: none that ends before the cursor, and of the others as many as fill a page. A page costs the
    same however deep it lies. ``cursor``: None for the first page.
    """
    parts = spark.read.parquet(f"{path}/parts")
    if cursor is not None:
        at, id_ = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1]).cast(parts.schema["last"].dataType["id"].dataType)
        parts = parts.filter(F.col("last") > F.struct(-F.unix_micros(at), id_))
    # one row for each folder; the first one left may hold only rows before the cursor's page, the next ones count in full
    order = Window.orderBy("part")
    full = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.first("rows").over(order.rowsBetween(Window.unboundedPreceding, 0))
    wanted = [r["part"] for r in parts.withColumn("full", full).filter(F.col("full").isNull() | (F.col("full") < limit)).select("part").collect()]
    if not wanted:
        return spark.read.parquet(f"{path}/rows").drop("part").limit(0)
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/part={p}" for p in wanted]).drop("part")
    if cursor is not None:
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > id_)))
    return rows.orderBy(F.desc("created_at"), F.asc("id")).limit(limit)


def write_snapshot(df: DataFrame, path: str) -> None:
    """gzip JSON lines, one folder for each day; files stay small because gzip cannot be split."""
    rows = df.select(*[f.name for f in schemas.MEMORY.fields]).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    writer = rows.write.mode("overwrite").partitionBy("day").option("compression", "gzip")
    writer.option("maxRecordsPerFile", SNAPSHOT_FILE_ROWS).json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots written as lines, or as documents ``{fetchedAt, memoryCount, memories: [...]}``."""
    return with_defaults(spark.read.schema(schemas.MEMORY).json(path)).select(*[f.name for f in schemas.MEMORY.fields])


def read_snapshot_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.SNAPSHOT_DOCUMENT).json(path)
    return docs.select("fetchedAt", "memoryCount", F.explode("memories").alias("m")).select(
        "fetchedAt", "memoryCount", "m.*"
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded batches, one row per batch."""
    return spark.read.schema(schemas.BATCH).json(path)


def batch_memories(batches: DataFrame) -> DataFrame:
    """One row per uploaded memory, with its place in the batch."""
    return batches.select("job_id", "batch_index", F.posexplode("memories").alias("position", "m")).select(
        "job_id",
        "batch_index",
        F.col("position").cast("bigint").alias("position"),
        F.col("m.id").alias("id"),
        F.col("m.content").alias("content"),
        F.col("m.created_at").alias("created_at"),
        F.col("m.metadata_json").alias("metadata_json"),
    )


def reviews(df: DataFrame) -> DataFrame:
    return df.withColumn("review", md.review_of(md.parsed(F.col("metadata_json"))))
