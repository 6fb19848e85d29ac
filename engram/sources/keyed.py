"""State tables on storage, upserted by the parts that changes fall into, and an audit table that takes each transaction once.

A keyed table is a folder for each ``part``, a hash bucket of the key or what the caller names, such as the day. An upsert finds the
parts of its changes, reads and rewrites those alone, and leaves all other files where they are. New parts are written aside first; when all are
complete they are moved in one by one. A run that stops on the way is finished by the next one with the same token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import jobs as jb
from engram.session import materialize
from engram.sources import folders

BUCKETS = 64


def bucket(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    """The part of a key; null keys have one too."""
    return F.format_string("b%05d", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def _staged(path: str, token: str) -> str:
    return f"{path}_staged/{token}"


def _move_in(spark: SparkSession, path: str, token: str) -> None:
    staged = _staged(path, token)
    for name in folders.names(spark, staged):
        if name.startswith("part="):
            folders.move(spark, f"{staged}/{name}", f"{path}/{name}")
    folders.remove(spark, staged)


def read(spark: SparkSession, path: str, schema, parts: Sequence[str] | None = None) -> DataFrame:
    """Rows of a keyed table, or of some of its parts; empty where nothing was written yet."""
    there = {n.split("=", 1)[1] for n in folders.names(spark, path) if n.startswith("part=")}
    wanted = sorted(there if parts is None else there & set(parts))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/part={p}" for p in wanted])


def upsert(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], version: Sequence[str], token: str, part: Column | None = None
) -> list[str]:
    """Apply ``changes`` (all columns of the table) to the table at ``path``; a change wins over a row of the same version.

    ``token`` names these changes: the same token again, after a stop or not, leaves the same table. ``part`` must follow from the keys, and
    hold names for folders (letters, digits, - and _). Returns the parts that were rewritten.
    """
    if folders.is_complete(spark, _staged(path, token)):
        parts = [n.split("=", 1)[1] for n in folders.names(spark, _staged(path, token)) if n.startswith("part=")]
        _move_in(spark, path, token)
        return parts
    part = bucket(keys) if part is None else part
    changed = materialize(changes.withColumn("part", part))
    # at most as many names as the table has parts
    parts = [r["part"] for r in changed.select("part").distinct().collect()]
    if not parts:
        return []
    current = read(spark, path, changes.schema, parts).withColumn("part", part)
    merged = jb.upsert(current, changed, list(keys), list(version))
    merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(_staged(path, token))
    _move_in(spark, path, token)
    return sorted(parts)


# --- audit ------------------------------------------------------------------------


def append_audit(requests: DataFrame, path: str, transaction: str) -> bool:
    """Add the audit rows of answered requests, once for each ``transaction`` however often it is tried.

    The rows go to the transaction's own folder, by day; the entry in the manifest, written last, makes them count. An error is
    reported by False and never stops the caller.
    """
    spark = requests.sparkSession
    try:
        if folders.is_complete(spark, f"{path}/manifest/transaction={transaction}"):
            return True
        rows = jb.audit_rows(requests).withColumn("day", F.to_date("ts"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/transaction={transaction}")
        spark.range(1).select(F.current_timestamp().alias("committed_at")).write.mode("overwrite").parquet(f"{path}/manifest/transaction={transaction}")
    except Exception as error:  # noqa: BLE001 - auditing must not fail a request
        print(f"audit append of {transaction} failed: {error}")
        return False
    return True


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of the transactions in the manifest, with transaction and day."""
    committed = spark.read.parquet(f"{path}/manifest").select(F.col("transaction").cast("string").alias("transaction"))
    return spark.read.parquet(f"{path}/rows").withColumn("transaction", F.col("transaction").cast("string")).join(committed, "transaction", "left_semi")
