"""Counts written by micro-batch and folded into one table now and then, so that readers meet few files.

``path``/epoch=N holds what micro-batch N adds, ``path``_folded/upto=N the sums up to it. A folder counts once it is complete. Folding reads
what is complete and writes a new folder, so it can be repeated; folders that it replaces go one folding later, when
no reader should hold them any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources.folders import numbered, remove


def _rows(spark: SparkSession, path: str, upto: int | None, keys: Sequence[str], value: str) -> tuple[DataFrame | None, int]:
    """(rows whose sums are the totals, micro-batch that the folded table reaches), up to a micro-batch or of all."""
    done = [n for n in numbered(spark, f"{path}_folded", "upto") if upto is None or n <= upto]
    base = done[-1] if done else -1
    epochs = [n for n in numbered(spark, path, "epoch") if n > base and (upto is None or n <= upto)]
    folders = [f"{path}_folded/upto={base}"] * bool(done) + [f"{path}/epoch={n}" for n in epochs]
    return (spark.read.parquet(*folders).select(*keys, value) if folders else None), base


def total(spark: SparkSession, path: str, keys: Sequence[str], value: str, upto: int | None = None) -> DataFrame | None:
    """Sums over all micro-batches, or those up to one; None where nothing was written yet."""
    rows, _ = _rows(spark, path, upto, keys, value)
    return None if rows is None else rows.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))


def fold(spark: SparkSession, path: str, epoch: int, keys: Sequence[str], value: str, keep: Column | None = None) -> None:
    """Fold the micro-batches up to ``epoch``, of the rows that ``keep`` holds for; drop what the folding before had replaced already."""
    rows, base = _rows(spark, path, epoch - 1, keys, value)
    last = spark.read.parquet(f"{path}/epoch={epoch}").select(*keys, value)
    rows = last if rows is None else rows.unionByName(last)
    rows = rows if keep is None else rows.filter(keep)
    rows.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value)).write.mode("overwrite").parquet(f"{path}_folded/upto={epoch}")
    for n in numbered(spark, path, "epoch"):
        if n <= base:
            remove(spark, f"{path}/epoch={n}")
    for n in numbered(spark, f"{path}_folded", "upto"):
        if n < base:
            remove(spark, f"{path}_folded/upto={n}")
