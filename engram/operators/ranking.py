"""Ordered work inside groups that stays distributed when one group is huge.

* :func:`top_per_group` - Spark cuts each group to ``k`` rows on the map side before it shuffles them.
* :func:`running` - row numbers, prefix sums and previous values inside a group.  Small groups use a plain
  window.  When a group is larger than ``max_group_rows`` the rows are range-partitioned by (group, order)
  instead, every slice is scanned on its own, and the totals of the earlier slices are added.  Only groups
  that cross a slice border need those totals: at most two per slice, so their table is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import materialize

MAX_GROUP_ROWS = 2_000_000


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of every group; ``rank`` keeps the 1-based position as BIGINT."""
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return df.withColumn(name, F.col(name).cast("bigint")) if rank else df.drop(name)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    sized_by: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add per-group running columns in ascending ``order`` (which must be total inside a group).

    ``number``  name of a 1-based row number;
    ``sums``    {new column: BIGINT column} inclusive prefix sums;
    ``previous`` {new column: column} value of the row before, null on the first row;
    ``sized_by`` a cheaper frame with the same keys and at least as many rows, to measure group sizes on;
    ``group_rows`` the largest group, where the caller has measured it already.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    if group_rows is None:
        group_rows = largest_group(sized_by or df, keys)
    if group_rows <= max_group_rows:
        return _scan(df, keys, order, number, sums, previous)
    return _sliced(df, keys, order, number, sums, previous)


def _scan(df, keys, order, number, sums, previous) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {new: F.sum(old).over(upto) for new, old in sums.items()}
    columns |= {new: F.lag(old).over(window) for new, old in previous.items()}
    if number:
        columns[number] = F.row_number().over(window).cast("bigint")
    return df.withColumns(columns)


def _sliced(df, keys, order, number, sums, previous) -> DataFrame:
    spark = df.sparkSession
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    position = number or "__position"
    # Materialised, so that a row keeps its slice however often the plan below reads it.
    sliced = materialize(
        df.repartitionByRange(slices, *keys, *order).withColumn("__slice", F.spark_partition_id())
    )
    local = _scan(sliced, [*keys, "__slice"], order, position, sums, previous)

    last = F.struct(*order)
    totals = sliced.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(old).alias(f"__sum_{new}") for new, old in sums.items()],
        *[F.max_by(F.struct(F.col(old).alias("v")), last).alias(f"__last_{new}") for new, old in previous.items()],
    )
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    # A group with rows in several slices is the first or last group of each: at most two rows per slice.
    crossing = totals.withColumn(
        "__slices", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    carried = crossing.select(
        *keys,
        "__slice",
        "__slices",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before_n"),
        *[F.coalesce(F.sum(f"__sum_{new}").over(before), F.lit(0)).alias(f"__before_{new}") for new in sums],
        *[F.lag(f"__last_{new}").over(by_slice).alias(f"__prev_{new}") for new in previous],
    ).filter("__slices > 1")
    joined = local.join(F.broadcast(carried), [*keys, "__slice"], "left")
    first_here = F.col(position) == 1
    columns = {new: F.col(new) + F.coalesce(F.col(f"__before_{new}"), F.lit(0)) for new in sums}
    columns |= {
        new: F.when(first_here, F.col(f"__prev_{new}")["v"]).otherwise(F.col(new)) for new in previous
    }
    columns[position] = F.col(position) + F.coalesce(F.col("__before_n"), F.lit(0))
    keep = [*df.columns, *sums, *previous, *([number] if number else [])]
    return joined.withColumns(columns).select(*keep)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
