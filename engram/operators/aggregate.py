"""Batch results, facets and the running totals of a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators.ranking import top_per_group


def _rank(category: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in lx.CATEGORY_PRIORITY]), category)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(lx.CATEGORY_PRIORITY)))


def category_counts(classified: DataFrame, keys: Sequence[str], universe: Sequence[str]) -> DataFrame:
    """Counts per (keys, category); categories of ``universe`` that did not occur count 0.

    The memories are read once: their counts meet in one small map per group, which the universe is looked up in.
    """
    counted = classified.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))
    per_group = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    names = F.array_union(F.array(*[F.lit(c) for c in universe]), F.map_keys("m"))
    return per_group.select(*keys, "m", F.explode(names).alias("category")).select(
        *keys, "category", F.coalesce(F.try_element_at("m", F.col("category")), F.lit(0)).cast("bigint").alias("count")
    )


def cards(counts: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
    """Category cards: count, share of all memories of the group, place by count and priority."""
    # a group holds one row per category
    group = Window.partitionBy(*keys)
    order = [F.desc("count"), _rank(F.col("category")), F.asc("category")]
    placed = counts.withColumns(
        {
            "share": tx.ratio2(F.col("count"), F.sum("count").over(group)),
            "place": F.row_number().over(group.orderBy(*order)).cast("bigint"),
        }
    )
    return placed if top is None else placed.filter(F.col("place") <= top)


def tag_counts(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tag counts; topic counts are the same numbers by definition."""
    listed = classified.select(*keys, F.explode_outer("tags").alias("tag"))
    return listed.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("count")).filter(F.col("tag").isNotNull())


def facet_stats(counts: DataFrame, keys: Sequence[str], value: str, limit: int = 50) -> DataFrame:
    order = [F.desc("count"), F.asc(value)]
    return top_per_group(counts.filter("count > 0"), keys, order, limit, rank="place")


def top_tags(counts: DataFrame, keys: Sequence[str], limit: int = 5) -> DataFrame:
    ranked = top_per_group(counts, keys, [F.desc("count"), F.asc("tag")], limit, rank="place")
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]), " ").alias(
            "top_tags"
        )
    )


def summary_strings(top_cards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``category:count`` of the listed cards that are not empty, in card order."""
    text = F.concat_ws(":", "category", "count")
    listed = F.sort_array(F.collect_list(F.struct("place", text.alias("s"))))
    return (
        top_cards.filter("count > 0").groupBy(*keys).agg(F.transform(listed, lambda x: x["s"]).alias("summary"))
    )


def merge_job(batches: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running job state after all batches.

    ``batches``: job_id, batch_index, version, processed, summary; ``deltas``: job_id, kind, key, count.
    Returns progress (completed, processed, version, summary of the last merge) and counts.
    """
    progress = batches.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("completed_batches"),
        F.sum("processed").cast("bigint").alias("processed_memories"),
        F.count(F.lit(1)).alias("result_version"),
        F.max_by("summary", "version").alias("summary"),
    )
    counts = deltas.groupBy("job_id", "kind", "key").agg(F.sum("count").cast("bigint").alias("count"))
    return progress, counts


def progress_rollup(cached: DataFrame, stored: DataFrame) -> DataFrame:
    """Field by field the greater of the cached and the stored progress."""
    fields = ["uploaded_batches", "completed_batches", "failed_batches", "processed_memories"]
    joined = stored.join(
        cached.select("job_id", *[F.col(f).alias(f"c_{f}") for f in fields]), "job_id", "left"
    )
    return joined.select(
        "job_id", *[F.greatest(F.col(f), F.coalesce(F.col(f"c_{f}"), F.lit(0))).alias(f) for f in fields]
    )
