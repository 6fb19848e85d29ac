"""Links between rows: star pairs, pairs across components, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.store import save

#: Rows of a group that are compared in one block.
BLOCK_ROWS = 256


def active_rows(rows: DataFrame, counted: DataFrame, test, columns: list[str]) -> DataFrame:
    """(key, id) of the rows that share their key with a row of another component that passes ``test(left, right)``.

    ``rows``: key, id, comp, rank and ``columns``. ``counted``: key, n (rows of that key), top, for the keys to compare. Rows whose
    rank is the top of their key (over 0) are partners only: one large component in a key is not listed. A group
    of more than BLOCK_ROWS rows is cut into blocks by hash; each pair of blocks is a join key of its own, so one
    task never meets more than two blocks of a group. A semi join stops at the first partner: pairs are not listed.
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    spread = rows.join(counted, "key").select(
        "key", "id", "comp", *columns, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"), blocks.alias("of"),
        ((F.col("rank") > 0) & (F.col("rank") == F.col("top"))).alias("is_top"),
    )
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    spread = spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    left = spread.filter(~F.col("is_top")).select(*[F.col(c).alias(f"a_{c}") for c in ("key", "id", "comp", *columns, "low", "high")])
    right = spread.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "id", "comp", *columns, "low", "high")])
    condition: Column = F.col("a_comp") != F.col("b_comp")
    for c in ("key", "low", "high"):
        condition = condition & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    condition = condition & test(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    return left.join(right, condition, "left_semi").select(F.col("a_key").alias("key"), F.col("a_id").alias("id"))


def blocks_to_compare(rows: DataFrame) -> DataFrame:
    """(block, id, comp, side) so that every two rows of one ``group`` with different ``comp`` meet in some block.

    ``rows``: id, comp, group, one row for an id. Groups are cut by hash into chunks of about BLOCK_ROWS rows; a component
    that fills chunks of its own is not compared with itself. A block is two chunks (side 0 and 1), or one (side 0).
    """
    sizes = rows.groupBy("group", "comp").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") > BLOCK_ROWS, F.col("comp"))
    sizes = sizes.select("group", "comp", label.alias("label"), "n")
    parts = sizes.groupBy("group", "label").agg(F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("parts"))
    parts = parts.select(F.col("group").alias("within"), F.col("label").alias("of"), "parts")
    plan = save(
        sizes.join(parts, (F.col("group") == F.col("within")) & F.col("label").eqNullSafe(F.col("of"))).select(
            "group", "comp", "label", "parts"
        )
    )
    chunk = lambda k: F.xxhash64("group", F.coalesce("label", F.lit(0)), F.col("label").isNull(), k)
    chunks = plan.select("group", "label", "parts").distinct()
    chunks = chunks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    chunks = chunks.select("group", "label", chunk(F.col("k")).alias("chunk"))
    a, b = chunks.alias("a"), chunks.alias("b")
    alike = F.coalesce(F.col("a.label") == F.col("b.label"), F.lit(False))
    pairs = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.chunk") <= F.col("b.chunk")) & ~alike)
    pairs = pairs.select(F.xxhash64("a.chunk", "b.chunk").alias("block"), F.col("a.chunk").alias("x"), F.col("b.chunk").alias("y"))
    first = pairs.select("block", F.col("x").alias("chunk"), F.lit(0).alias("side"))
    second = pairs.filter("x < y").select("block", F.col("y").alias("chunk"), F.lit(1).alias("side"))
    placed = rows.join(plan, ["group", "comp"])
    placed = placed.select("id", "comp", chunk(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("chunk"))
    return first.union(second).join(placed, "chunk").select("block", "id", "comp", "side")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): comp is the smallest id that can be reached.

    Alternates the large-star and small-star steps until nothing changes; the rounds grow with the logarithm of the
    longest path. Every step is an aggregate by id and a join, and its result is written before the next.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, before = save(edges), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.filter("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", "m").union(met.select("v", "m")).toDF("u", "v").filter("u > v").distinct()
        edges = save(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return found.union(found.select("comp", "comp").distinct())
