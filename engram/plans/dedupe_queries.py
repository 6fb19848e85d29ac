"""Dedupe, duplicate clusters and clean-up over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import dedupe as dd
from engram.plans import tables as tb
from engram.plans.registry import query
from engram.session import materialize

# owner = language here: few owners, one of them holding most rows
HASHED = f"{tb.MEM}, h AS (SELECT * REPLACE (tags[2] AS owner_id), sha256({tb.sql_norm('content')}) AS hash FROM mem)"
CLUSTERS = f"""{HASHED}, g AS (SELECT owner_id, hash, count(*) AS copies, min(created_at) AS first_at FROM h GROUP BY ALL),
canon AS (SELECT g.*, h.id AS canonical_id FROM g JOIN h ON h.owner_id = g.owner_id AND h.hash = g.hash AND h.created_at = g.first_at),
allc AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY copies DESC, first_at, canonical_id) AS cluster_index
  FROM canon WHERE copies > 1)"""


def hashed(spark, sf):
    return tb.documents(spark, sf).withColumns(
        {"owner_id": F.get("tags", F.lit(1)), "content_hash": tx.content_hash(tx.normalized(F.col("content")))}
    )


@query(
    "dual_key_dedupe",
    f"""WITH {HASHED}, n AS (SELECT doc_id, tags[2] AS job_id, doc_id // 2 AS memory_id, hash,
        row_number() OVER (PARTITION BY tags[2], doc_id // 2 ORDER BY doc_id) AS a,
        row_number() OVER (PARTITION BY tags[2], hash ORDER BY doc_id) AS b FROM h)
    SELECT job_id, memory_id, doc_id, hash AS content_hash FROM n WHERE a = 1 AND b = 1""",
)
def dual_key_dedupe(spark, sf):
    df = hashed(spark, sf).select(
        F.get("tags", F.lit(1)).alias("job_id"),
        F.floor(F.col("doc_id") / 2).cast("bigint").alias("memory_id"),
        "doc_id",
        "content_hash",
    )
    return dd.first_seen(df, ["job_id"], "memory_id", "content_hash", ["doc_id"])


@query("duplicate_clusters", f"""WITH {CLUSTERS} SELECT owner_id, cluster_index, canonical_id, hash AS content_hash,
   copies - 1 AS duplicates FROM allc WHERE cluster_index <= 10""")
def duplicate_clusters(spark, sf):
    return dd.duplicate_clusters(hashed(spark, sf)).select(
        "owner_id", "cluster_index", "canonical_id", "content_hash", "duplicates"
    )


@query("duplicate_clusters_all", f"""WITH {CLUSTERS} SELECT owner_id, cluster_index, canonical_id, copies - 1 AS duplicates FROM allc""")
def duplicate_clusters_all(spark, sf):
    return dd.duplicate_clusters(_keys(spark, sf), top_n=None).select(
        "owner_id", "cluster_index", "canonical_id", "duplicates"
    )


def _keys(spark, sf):
    """Ids and hashes without the texts, written down once: clusters and members read them repeatedly."""
    return materialize(hashed(spark, sf).select("owner_id", "id", "doc_id", "created_at", "content_hash"))


def _export(spark, sf):
    df, keys = hashed(spark, sf), _keys(spark, sf)
    members = dd.cluster_members(keys, dd.duplicate_clusters(keys)).select(
        "owner_id", "cluster_index", "canonical_id", F.col("id").alias("duplicate_id")
    )
    # memories of every seventh minute are gone from the snapshot
    return dd.duplicate_export(members, df.filter(F.col("doc_id") % 7 != 0))


@query(
    "duplicate_export",
    f"""WITH {CLUSTERS}, m AS (SELECT c.owner_id, c.cluster_index, c.canonical_id, h.id AS dup FROM allc c JOIN h USING (owner_id, hash)
        WHERE c.cluster_index <= 10 AND h.id <> c.canonical_id),
      s AS (SELECT owner_id, id, {tb.sql_preview('content', 180)} AS p FROM h WHERE doc_id % 7 <> 0)
    SELECT m.owner_id, m.dup AS duplicate_memory_id, m.cluster_index, coalesce(a.p, '') AS canonical_preview,
      coalesce(b.p, '') AS duplicate_preview, 'Duplicate content matched the canonical memory in this cluster.' AS reason
    FROM m LEFT JOIN s a ON a.owner_id = m.owner_id AND a.id = m.canonical_id LEFT JOIN s b ON b.owner_id = m.owner_id AND b.id = m.dup""",
)
def duplicate_export(spark, sf):
    return _export(spark, sf)


@query(
    "duplicate_quality",
    f"""WITH {CLUSTERS}, t AS (SELECT owner_id, CAST(sum(copies) AS BIGINT) AS memory_count, count(*) AS unique_count,
        CAST(sum(copies - 1) AS BIGINT) AS all_duplicates FROM g GROUP BY 1),
      d AS (SELECT owner_id, CAST(sum(copies - 1) AS BIGINT) AS d FROM allc WHERE cluster_index <= 10 GROUP BY 1)
    SELECT owner_id, memory_count, unique_count, all_duplicates, coalesce(d, 0) AS duplicate_count,
      {tb.sql_ratio2('coalesce(d, 0)', 'memory_count')} AS duplicate_ratio FROM t LEFT JOIN d USING (owner_id)""",
)
def duplicate_quality(spark, sf):
    return dd.duplicate_quality(hashed(spark, sf))


@query(
    "duplicate_cleanup",
    f"""WITH {CLUSTERS}, m AS (SELECT c.owner_id, h.id, h.doc_id FROM allc c JOIN h USING (owner_id, hash) WHERE h.id <> c.canonical_id),
      todo AS (SELECT * FROM m WHERE doc_id % 6 <> 0)
    SELECT owner_id, count(*) AS total_count, count_if(doc_id % 4 <> 0) AS deleted_count, count_if(doc_id % 4 = 0) AS failed_count,
      count_if(doc_id % 4 <> 0) + (SELECT count(*) FROM m x WHERE x.owner_id = todo.owner_id AND x.doc_id % 6 = 0) AS deleted_total
    FROM todo GROUP BY owner_id""",
)
def duplicate_cleanup(spark, sf):
    df = _keys(spark, sf)
    clusters = dd.duplicate_clusters(df, top_n=None)
    members = dd.cluster_members(df, clusters).select("owner_id", "id", "doc_id")
    history = members.filter(F.col("doc_id") % 6 == 0).select("owner_id", "id")
    todo = dd.duplicates_to_delete(members, history)
    results = members.select("owner_id", "id", (F.col("doc_id") % 4 != 0).alias("ok"))
    return dd.deletion_outcome(todo, results, history)


@query(
    "upload_outcome",
    f"""WITH {HASHED} SELECT h.owner_id AS job_id, h.doc_id AS batch_index, h.hash AS payload_hash,
      CASE WHEN h.doc_id % 3 = 0 THEN 'new' WHEN h.doc_id % 3 = 1 THEN 'requeued' ELSE 'conflict' END AS outcome FROM h""",
)
def upload_outcome(spark, sf):
    uploads = hashed(spark, sf).select(
        F.col("owner_id").alias("job_id"), F.col("doc_id").alias("batch_index"), F.col("content_hash").alias("payload_hash")
    )
    held = uploads.filter(F.col("batch_index") % 3 != 0).withColumn(
        "payload_hash", F.when(F.col("batch_index") % 3 == 1, F.col("payload_hash")).otherwise(F.lit("other"))
    )
    return dd.upload_outcome(uploads, held)


@query(
    "chunk_plan",
    f"""WITH {HASHED}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, hash ORDER BY created_at, id) AS r FROM h) WHERE r = 1),
      n AS (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, id) - 1 AS pos FROM u),
      t AS (SELECT owner_id, count(*) AS n FROM n GROUP BY 1)
    SELECT owner_id, pos // 18 AS chunk, count(*) AS memories, CAST((t.n + 17) // 18 AS BIGINT) AS chunk_count,
      CAST(least(59, 35 + ((pos // 18 + 1) * 24) // ((t.n + 17) // 18)) AS BIGINT) AS progress
    FROM n JOIN t USING (owner_id) GROUP BY owner_id, pos // 18, t.n""",
)
def chunk_plan(spark, sf):
    size = 18
    memories = tb.documents(spark, sf)
    unique = dd.unique_memories(hashed(spark, sf)).select("owner_id", "id", "created_at")
    chunks = dd.chunk_of(unique, size, sized_by=memories.withColumn("owner_id", F.get("tags", F.lit(1)))).groupBy("owner_id", "chunk").agg(F.count(F.lit(1)).alias("memories"))
    # the number of chunks is one row per chunk already, so this join is small per owner
    counts = chunks.groupBy("owner_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return chunks.join(counts, "owner_id").withColumn(
        "progress", tx.progress_percent(F.col("chunk") + 1, F.col("chunk_count"))
    )


@query(
    "distinct_by_key",
    f"""WITH {tb.MEM}, k AS (SELECT owner_id, id, lower({tb.sql_trim('tags[3]')}) AS key, created_at FROM mem)
    SELECT owner_id, key, id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, key ORDER BY created_at, id) AS r FROM k) WHERE r = 1""",
)
def distinct_by_key(spark, sf):
    df = tb.documents(spark, sf).select("owner_id", "id", tx.token_key(F.get("tags", F.lit(2))).alias("key"), "created_at")
    return dd.distinct_first(df, ["owner_id", "key"], [F.asc("created_at"), F.asc("id")]).drop("created_at")
