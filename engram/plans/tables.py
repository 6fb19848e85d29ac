"""Views of the driver tables as memories, sessions, batches and requests - for Spark and for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.operators.rules import Rule
from engram.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where every executor can see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over the cores where it comes in fewer splits than there are cores; else it stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: owner = source, one minute apart, four types in turn."""
    d = F.col("doc_id")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("source").alias("owner_id"),
        d.cast("string").alias("id"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("created_at"),
        F.when(d % 4 == 0, "pinned")
        .when(d % 4 == 1, "insight")
        .when(d % 4 == 2, "fact")
        .otherwise("session")
        .alias("memory_type"),
        F.when(d % 11 == 0, "archived").otherwise("active").alias("state"),
        F.array(F.col("source"), F.col("lang"), F.concat(F.lit("#lane-"), (d % 7).cast("string"))).alias("tags"),
        F.concat(
            F.lit('{"correctness":"'),
            F.when(d % 5 == 0, "incorrect").otherwise("correct"),
            F.lit('","confidence":0.'),
            (d % 10).cast("string"),
            F.lit(',"evidenceCount":"'),
            (d % 7).cast("string"),
            F.lit('","title":"'),
            F.when(d % 3 == 0, F.concat(F.lit(" Topic  "), (d % 9).cast("string"))).otherwise(""),
            F.lit('","edited":'),
            F.when(d % 2 == 0, "true").otherwise("false"),
            F.lit(',"edit_version":'),
            (d % 4).cast("string"),
            F.lit("}"),
        ).alias("metadata_json"),
    )


MEM = """mem AS (
  SELECT doc_id, source AS owner_id, CAST(doc_id AS VARCHAR) AS id, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS created_at,
         CASE doc_id % 4 WHEN 0 THEN 'pinned' WHEN 1 THEN 'insight' WHEN 2 THEN 'fact' ELSE 'session' END AS memory_type,
         CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS state,
         [source, lang, '#lane-' || CAST(doc_id % 7 AS VARCHAR)] AS tags,
         '{"correctness":"' || CASE WHEN doc_id % 5 = 0 THEN 'incorrect' ELSE 'correct' END
           || '","confidence":0.' || CAST(doc_id % 10 AS VARCHAR)
           || ',"evidenceCount":"' || CAST(doc_id % 7 AS VARCHAR)
           || '","title":"' || CASE WHEN doc_id % 3 = 0 THEN ' Topic  ' || CAST(doc_id % 9 AS VARCHAR) ELSE '' END
           || '","edited":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
           || ',"edit_version":' || CAST(doc_id % 4 AS VARCHAR) || '}' AS metadata_json
  FROM documents)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as session memories: eight conversations per owner, one day each."""
    c, t = F.col("conv_id"), F.col("turn")
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit("u"), F.floor(c / 8).cast("bigint").cast("string")).alias("owner_id"),
        F.concat_ws(":", c.cast("string"), t.cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + (c % 8) * 86400 + t * 60).alias("created_at"),
        F.lit("session").alias("memory_type"),
        F.lit("active").alias("state"),
        F.array().cast("array<string>").alias("tags"),
        F.when(
            t % 3 == 1,
            F.concat(
                F.lit('{"correctness":"'),
                F.when(c % 4 == 0, "incorrect").when(c % 4 == 1, "unknown").otherwise("correct"),
                F.lit('","edited":'),
                F.when(c % 2 == 0, "true").otherwise("false"),
                F.lit(',"edit_version":'),
                F.when(c % 3 == 0, F.concat(F.lit('"'), t.cast("string"), F.lit('"'))).otherwise(t.cast("string")),
                F.lit("}"),
            ),
        ).alias("metadata_json"),
    )


SES = """ses AS (
  SELECT conv_id, turn, role, 'u' || CAST(conv_id // 8 AS VARCHAR) AS owner_id,
         CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 8 AS INTEGER)) + to_minutes(CAST(turn AS BIGINT)) AS created_at,
         CASE WHEN turn % 3 = 1 THEN
           '{"correctness":"' || CASE conv_id % 4 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'unknown' ELSE 'correct' END
           || '","edited":' || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END
           || ',"edit_version":' || CASE WHEN conv_id % 3 = 0 THEN '"' || CAST(turn AS VARCHAR) || '"'
                                        ELSE CAST(turn AS VARCHAR) END || '}' END AS metadata_json
  FROM conversations)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Rules for the driver texts: keyword, phrase and regex, several of them known to fire.
RULES = [
    Rule("health_wellbeing", "keyword", "rest", 5),
    Rule("learning", "keyword", "lean", 3),
    Rule("environment_runtime", "keyword", "SSH", 5),
    Rule("status_metric", "keyword", "stat", 5),
    Rule("system_config", "keyword", "env", 5),
    Rule("communication", "keyword", "tell", 5),
    Rule("preference", "keyword", "tone", 3),
    Rule("emotion", "keyword", "sad", 4),
    Rule("automation", "keyword", "queue", 5),
    Rule("artifact", "keyword", "path", 5),
    Rule("project", "keyword", "data", 5),
    Rule("privacy_safety", "keyword", "token", 5),
    Rule("deployment", "keyword", "release", 5),
    Rule("task", "keyword", "work", 5),
    Rule("policy", "phrase", "the this", 7),
    Rule("plan", "phrase", "of the", 7),
    Rule("health_wellbeing", "regex", r"\b(tired|rest|sleep)\b", 7),
    Rule("status_metric", "regex", r"\b(status|version|result)\b", 7),
    Rule("system_config", "regex", r"\b(config|setting|token)\b", 7),
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RULES_SQL = "rules(rid, category, match_type, pattern, weight) AS (VALUES " + ", ".join(
    f"({i}, {_q(r.category)}, {_q(r.match_type)}, {_q(r.pattern)}, {r.weight})" for i, r in enumerate(RULES)
) + ")"
PRIORITY_SQL = "prio(category, p) AS (VALUES " + ", ".join(
    f"({_q(c)}, {i})" for i, c in enumerate(lx.CATEGORY_PRIORITY)
) + ")"


def sql_list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


_WS = "'[" + lx.WS_CLASS + "]+'"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {_WS}, ' ', 'g'), ' ')"


def sql_norm(x: str) -> str:
    return f"lower({sql_collapse(x)})"


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{lx.WS_CLASS}]+', ''), '[{lx.WS_CLASS}]+$', '')"


def sql_preview(x: str, n: int = 220) -> str:
    return f"substring({sql_collapse(x)}, 1, {n})"


def sql_ratio2(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE CAST(((200 * ({n}) + ({d})) // (2 * ({d}))) AS DOUBLE) / 100.0 END)"
