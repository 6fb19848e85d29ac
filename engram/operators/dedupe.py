"""First-seen dedupe, duplicate clusters and clean-up bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators.ranking import MAX_GROUP_ROWS, running, top_per_group
from engram.session import written


def first_seen(
    df: DataFrame,
    scope: Sequence[str],
    id_col: str,
    hash_col: str,
    order: Sequence[str],
) -> DataFrame:
    """Rows whose id *and* hash are both new inside ``scope``, rejected rows counting as seen.

    A row survives when it is the earliest of its id and the earliest of its hash.  Both minima are partial
    aggregates over keys only; they meet on the row position, which is unique, so neither a popular id nor a
    text copied into a third of the table loads one task.  ``order`` must be unique inside ``scope``.
    """

    keys = df.select(*dict.fromkeys([*scope, id_col, hash_col, *order]))

    def firsts(key: str) -> DataFrame:
        if len(order) == 1:  # a plain minimum is a hash aggregate, one of structs has to sort
            return keys.groupBy(*scope, key).agg(F.min(order[0]).alias(order[0])).drop(key)
        first = keys.groupBy(*scope, key).agg(F.min(F.struct(*order)).alias("f"))
        return first.select(*scope, "f.*")

    position = [*scope, *order]
    both = firsts(id_col).join(firsts(hash_col), position, "left_semi")
    return df.join(both, position, "left_semi")


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return top_per_group(df, keys, order, 1)


def copies(df: DataFrame) -> DataFrame:
    """Per (owner, content hash): the earliest memory and the number of copies."""
    return (
        df.groupBy("owner_id", "content_hash")
        .agg(F.min(F.struct("created_at", "id")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(
            "owner_id",
            "content_hash",
            F.col("first.created_at").alias("canonical_at"),
            F.col("first.id").alias("canonical_id"),
            "copies",
        )
    )


def unique_memories(df: DataFrame) -> DataFrame:
    """The earliest memory of every distinct text per owner.

    Copies are cut to one per task before they are shuffled, so a text copied a million times stays cheap.
    """
    return top_per_group(df, ["owner_id", "content_hash"], [F.asc("created_at"), F.asc("id")], 1)


def memory_keys(memories: DataFrame) -> DataFrame:
    """(owner_id, id, created_at, content_hash) of every memory, written down: texts are normalised and hashed once."""
    return written(memories.select("owner_id", "id", "created_at", tx.content_hash(tx.normalized(F.col("content"))).alias("content_hash")))


def with_texts(kept: DataFrame, memories: DataFrame) -> DataFrame:
    """The memories that ``kept`` names (owner_id, id, created_at), with all their columns and the others of kept.

    Kept rows are few and small, so they go to the texts where they can be broadcast; otherwise both are dealt by owner and id,
    and no text is ever sorted or gathered by its owner.
    """
    names = {c: f"__{c}" for c in ("owner_id", "id", "created_at")}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return memories.join(kept.withColumnsRenamed(names), same).drop(*names.values())


def distinct_texts(memories: DataFrame) -> DataFrame:
    """The earliest memory of every distinct text per owner, found on hashes alone. ``id`` must be unique inside ``owner_id``."""
    first = unique_memories(memory_keys(memories)).select("owner_id", "id", "created_at")
    return with_texts(written(first), memories)


def chunked_texts(memories: DataFrame, size: int = lx.CHUNK_SIZE, max_group_rows: int = MAX_GROUP_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Distinct memories with the chunk that they fall into, numbered on hashes alone."""
    keys = memory_keys(memories) if keys is None else keys
    first = unique_memories(keys).select("owner_id", "id", "created_at")
    return with_texts(written(chunk_of(first, size, max_group_rows, sized_by=keys).drop("position")), memories)


def first_copy(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """``values`` of the earliest memory per owner and text, where the texts themselves are not needed any more.

    A plain aggregate: rows shrink to key and values before the shuffle.
    """
    earliest = F.min_by(F.struct(*values), F.struct("created_at", "id"))
    return df.groupBy("owner_id", "content_hash").agg(earliest.alias("v")).select("owner_id", "content_hash", "v.*")


def duplicate_clusters(df: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Clusters per owner, largest first: cluster_index, canonical, number of duplicates."""
    clusters = (
        copies(df)
        .filter("copies > 1")
        .withColumn("duplicates", F.col("copies") - 1)
    )
    order = [F.desc("duplicates"), F.asc("canonical_at"), F.asc("canonical_id")]
    if top_n is None:
        clusters = clusters.withColumn("minus", -F.col("duplicates"))
        return running(
            clusters, ["owner_id"], ["minus", "canonical_at", "canonical_id"], number="cluster_index"
        ).drop("minus")
    return top_per_group(clusters, ["owner_id"], order, top_n, rank="cluster_index")


def cluster_members(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per duplicate of a cluster, the canonical memory itself left out."""
    keyed = clusters.select("owner_id", "content_hash", "cluster_index", "canonical_id", "copies")
    members = df.join(keyed, ["owner_id", "content_hash"])  # adaptive skew join splits a large cluster
    return members.filter(F.col("id") != F.col("canonical_id"))


def duplicate_export(
    clusters_long: DataFrame, memories: DataFrame, preview_chars: int = 180
) -> DataFrame:
    """Clean-up list: previews of canonical and duplicate, empty where the memory is gone.

    ``clusters_long``: owner_id, cluster_index, canonical_id, duplicate_id.
    """
    previews = memories.select("owner_id", "id", tx.preview(F.col("content"), preview_chars).alias("p"))
    # Few canonicals carry many rows, so their previews are attached to the cluster list (one row each)
    # before it fans out to the duplicates, which are unique.
    canonical = (
        clusters_long.select("owner_id", "canonical_id")
        .distinct()
        .join(previews.withColumnRenamed("id", "canonical_id"), ["owner_id", "canonical_id"], "left")
        .select("owner_id", "canonical_id", F.coalesce("p", F.lit("")).alias("canonical_preview"))
    )
    return (
        clusters_long.join(canonical, ["owner_id", "canonical_id"])
        .join(previews.withColumnRenamed("id", "duplicate_id"), ["owner_id", "duplicate_id"], "left")
        .select(
            "owner_id",
            F.col("duplicate_id").alias("duplicate_memory_id"),
            "cluster_index",
            "canonical_preview",
            F.coalesce("p", F.lit("")).alias("duplicate_preview"),
            F.lit(lx.DUPLICATE_REASON).alias("reason"),
        )
    )


def duplicate_quality(df: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Per owner: memories, distinct texts, duplicates (of the ``top_n`` largest clusters) and their share."""
    totals = copies(df).groupBy("owner_id").agg(
        F.sum("copies").alias("memory_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.sum(F.col("copies") - 1).alias("all_duplicates"),
    )
    if top_n is None:
        counted = totals.withColumn("duplicate_count", F.col("all_duplicates"))
    else:
        listed = duplicate_clusters(df, top_n).groupBy("owner_id").agg(F.sum("duplicates").alias("d"))
        counted = totals.join(listed, "owner_id", "left").withColumn(
            "duplicate_count", F.coalesce("d", F.lit(0))
        )
    return counted.select(
        "owner_id",
        "memory_count",
        "unique_count",
        "all_duplicates",
        "duplicate_count",
        tx.ratio2(F.col("duplicate_count"), F.col("memory_count")).alias("duplicate_ratio"),
    )


def duplicates_to_delete(duplicates: DataFrame, deleted: DataFrame) -> DataFrame:
    """Distinct (owner_id, id) still to delete."""
    return duplicates.select("owner_id", "id").distinct().join(deleted, ["owner_id", "id"], "left_anti")


def deletion_outcome(requested: DataFrame, results: DataFrame, history: DataFrame) -> DataFrame:
    """Per owner: requested, deleted and failed now, and everything deleted so far.

    ``requested``: owner_id, id; ``results``: owner_id, id, ok; ``history``: owner_id, id deleted before.
    """
    requested = requested.distinct()
    done = requested.join(results, ["owner_id", "id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    now = done.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("ok").alias("deleted_count"),
        F.count_if(~F.col("ok")).alias("failed_count"),
    )
    ever = (
        history.select("owner_id", "id")
        .union(done.filter("ok").select("owner_id", "id"))
        .distinct()
        .groupBy("owner_id")
        .agg(F.count(F.lit(1)).alias("deleted_total"))
    )
    return now.join(ever, "owner_id", "left").withColumn("deleted_total", F.coalesce("deleted_total", F.lit(0)))


def upload_outcome(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Idempotent upload: ``new``, ``requeued`` (same hash) or ``conflict`` (another hash) per (job, batch)."""
    held = existing.select("job_id", "batch_index", F.col("payload_hash").alias("held_hash"))
    return uploads.join(held, ["job_id", "batch_index"], "left").withColumn(
        "outcome",
        F.when(F.col("held_hash").isNull(), "new")
        .when(F.col("held_hash") == F.col("payload_hash"), "requeued")
        .otherwise("conflict"),
    ).drop("held_hash")


def chunk_of(df: DataFrame, size: int = lx.CHUNK_SIZE, max_group_rows: int = MAX_GROUP_ROWS,
             sized_by: DataFrame | None = None) -> DataFrame:
    """0-based chunk of ``size`` rows per owner in time order."""
    numbered = running(
        df, ["owner_id"], ["created_at", "id"], number="position", max_group_rows=max_group_rows, sized_by=sized_by
    )
    return numbered.withColumn("chunk", F.floor((F.col("position") - 1) / size).cast("bigint"))
