"""Mixing sources to target weights by the cube method.

A document is taken ``floor(ratio)`` times for sure, ratio being its source's target over its source's size, and once more with
the fractional part as inclusion probability. The flight phase moves the probabilities of few documents at a time along a
direction that keeps both balanced totals (words and documents) until one of them reaches 0 or 1. Each source is dealt into
blocks by hash; a block ends with at most two open documents, the open ones of all blocks meet again in fewer blocks, and so
on until one block is left for each source. There its last open documents are landed.
"""

from __future__ import annotations

from functools import reduce
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.store import save

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one block of the flight phase.
BLOCK_ROWS = 5000
LANDING_SWAPS = 8
_EPS = 1e-9


def flight(chance: list[float], size: list[float], seed: int) -> list[float]:
    """Probabilities moved to 0 or 1, all but at most two, with their sum and their sum weighted by size unchanged."""
    out, draw = list(chance), Random(seed)
    open_: list[int] = []
    for k in range(len(out)):
        open_.append(k)
        open_ = [j for j in open_ if _EPS < out[j] < 1 - _EPS]
        while len(open_) > 2:
            step(out, size, open_, draw.random())
            open_ = [j for j in open_ if _EPS < out[j] < 1 - _EPS]
    return [float(round(c)) if not _EPS < c < 1 - _EPS else c for c in out]


def step(out: list[float], size: list[float], at: list[int], draw: float) -> None:
    """Move three probabilities along the null space of (1, 1, 1) and their sizes until one is 0 or 1.

    Each of the two ends is chosen with the chance that leaves the expected probabilities as they are.
    """
    i, j, k = at[:3]
    move = (size[j] - size[k], size[k] - size[i], size[i] - size[j])
    if move == (0, 0, 0):
        move = (1.0, -1.0, 0.0)
    forth = min((1 - out[n] if m > 0 else out[n]) / abs(m) for n, m in zip((i, j, k), move) if m)
    back = min((out[n] if m > 0 else 1 - out[n]) / abs(m) for n, m in zip((i, j, k), move) if m)
    by = forth if draw * (forth + back) < back else -back
    for n, m in zip((i, j, k), move):
        moved = out[n] + by * m
        out[n] = 0.0 if moved < _EPS else 1.0 if moved > 1 - _EPS else moved


def _fly(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "size"], kind="stable").reset_index(drop=True)
    rows["chance"] = flight(rows["chance"].tolist(), rows["size"].astype(float).tolist(), int(rows["draw"].iloc[0]))
    return rows


def land(rows: pd.DataFrame) -> pd.DataFrame:
    """The last block of a source: its open documents are rounded, the longest first, so that the words taken stay near what is due;
    then single documents of the block change sides while that brings the words nearer, at most LANDING_SWAPS times.
    """
    rows = _fly(rows).sort_values(["size", "draw"], ascending=[False, True], kind="stable").reset_index(drop=True)
    chance, size = rows["chance"].tolist(), rows["size"].tolist()
    over = 0.0
    for k, c in enumerate(chance):
        if _EPS < c < 1 - _EPS:
            taken = 1.0 if abs(over + (1 - c) * size[k]) <= abs(over - c * size[k]) else 0.0
            over += (taken - c) * size[k]
            chance[k] = taken
    for _ in range(LANDING_SWAPS):
        change = [size[k] if chance[k] == 0 else -size[k] for k in range(len(size))]
        best = min(range(len(size)), key=lambda k: abs(over + change[k]))
        if abs(over + change[best]) >= abs(over):
            break
        over += change[best]
        chance[best] = 1 - chance[best]
    rows["chance"] = chance
    return rows


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size, one row for a source.

    Sources weigh 1, 2, 3, 1, ... by code point, null last. Targets share all sizes by weight; what goes beyond ``cap`` times
    a source's size is shared again by weight among the others until none is beyond. In order of cap over weight the capped
    sources come first, so one pass over running sums finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = (F.row_number().over(order) - 1) % 3 + 1
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    # the share of this source and all later ones if all earlier ones are at their cap
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - spent) / F.sum("weight").over(rest))
    free = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.least("most", F.coalesce(free, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "source_size", "target"
    )


def mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted).

    Size: runs of anything but ASCII white space; a null text has none. Every row counts as a document of its own; rows
    that agree in all three columns may swap their results. No document is taken more than ``cap`` times, rounded up.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"))
    units = save(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    goals = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    goals = save(goals).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # of n equal rows, sure rows take one copy more than each, and one row more may
    units = units.withColumn("each", F.floor(ratio + _EPS)).withColumn("due", F.greatest(ratio - F.col("each"), F.lit(0.0)) * F.col("n"))
    units = units.withColumn("sure", F.floor(F.col("due") + _EPS)).withColumn("chance", F.greatest(F.col("due") - F.col("sure"), F.lit(0.0)))
    units = units.drop("due").withColumn("draw", F.xxhash64("doc_id", "source", "size", F.lit(1)))
    settled = []
    while True:
        counts = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        counts = counts.withColumnRenamed("source", "of")
        last = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        block = F.pmod(F.xxhash64("draw", F.lit(len(settled))), F.col("blocks")).cast("int")
        dealt = units.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", block).drop("blocks")
        flown = dealt.groupBy("source", "block").applyInPandas(land if last else _fly, dealt.schema).drop("block")
        flown = save(flown)
        is_open = (F.col("chance") > _EPS) & (F.col("chance") < 1 - _EPS)
        settled.append(flown.filter(~is_open))
        if last:
            break
        units = flown.filter(is_open)
    every = reduce(DataFrame.union, settled)
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    times = F.col("each") + F.when(F.col("copy") <= F.col("sure") + F.round("chance"), 1).otherwise(0)
    return every.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
