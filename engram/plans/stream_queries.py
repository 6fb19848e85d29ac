"""Streams over the driver tables, run to their end with ``availableNow`` and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import jobs as jb
from engram.operators import periods as pd
from engram.operators import ranking as rk
from engram.plans import tables as tb
from engram.plans.classify_queries import CLASSIFIED
from engram.plans.dedupe_queries import HASHED
from engram.plans.registry import query
from engram.sources import keyed
from engram.streaming import jobs as st


def _stream(spark, sf, name: str):
    path = f"{sf}/{name}*.parquet"
    return st.files(spark, path, tb.table(spark, sf, name).schema)


def _spread_stream(spark, sf, name: str):
    """As :func:`_stream`, dealt out over the cores where the table comes in fewer splits than there are cores."""
    cores, stream = spark.sparkContext.defaultParallelism, _stream(spark, sf, name)
    return stream if tb.table(spark, sf, name).rdd.getNumPartitions() >= cores else stream.repartition(cores)


@query(
    "stream_dedupe",
    f"""WITH {HASHED}, n AS (SELECT doc_id, tags[2] AS job_id, doc_id // 2 AS memory_id, hash,
        row_number() OVER (PARTITION BY tags[2], doc_id // 2 ORDER BY doc_id) AS a,
        row_number() OVER (PARTITION BY tags[2], hash ORDER BY doc_id) AS b FROM h)
    SELECT job_id, memory_id, doc_id, hash AS content_hash FROM n WHERE a = 1 AND b = 1""",
)
def stream_dedupe(spark, sf):
    rows = _stream(spark, sf, "documents").select(
        F.col("lang").alias("job_id"),
        F.floor(F.col("doc_id") / 2).cast("bigint").alias("memory_id"),
        "doc_id",
        tx.content_hash(tx.normalized(F.col("text"))).alias("content_hash"),
    )
    out = tb.fresh_folder(spark, "dedupe")
    st.dedupe_stream(rows, out, ["job_id"], "memory_id", "content_hash", ["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("epoch")


@query(
    "stream_dedupe_expiry",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, CAST(floor(value) AS BIGINT) % 5 AS h,
        ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOURS AS ended FROM events),
      s AS (SELECT *, sum(CASE WHEN ended THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e),
      n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session, event_type ORDER BY ts, event_id) AS a,
        row_number() OVER (PARTITION BY user_id, session, h ORDER BY ts, event_id) AS b FROM s)
    SELECT user_id AS job_id, event_type AS memory_id, h AS content_hash, event_id FROM n WHERE a = 1 AND b = 1""",
)
def stream_dedupe_expiry(spark, sf):
    """Keys that a silent job forgets, and that an active one keeps however long ago it wrote them."""
    rows = _stream(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("memory_id"),
        (F.floor("value") % 5).cast("bigint").alias("content_hash"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    out = tb.fresh_folder(spark, "dedupe-expiry")
    st.dedupe_stream(rows, out, ["job_id"], "memory_id", "content_hash", ["event_id"], time=F.col("ts")).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("job_id", "memory_id", "content_hash", "event_id")


@query(
    "stream_merge",
    f"""WITH {CLASSIFIED}, k AS (SELECT owner_id AS job_id, 'category' AS kind, category AS key, count(*) AS c FROM classified GROUP BY ALL
        UNION ALL SELECT owner_id, 'tag', tag, count(*) FROM tags JOIN mem USING (id) GROUP BY ALL)
    SELECT job_id, kind, key, c AS "count" FROM k""",
)
def stream_merge(spark, sf):
    rows = _spread_stream(spark, sf, "documents").select(
        F.col("source").alias("job_id"),
        F.floor(F.col("doc_id") / 100).cast("bigint").alias("batch_index"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
    )
    out = tb.fresh_folder(spark, "merge")
    st.merge_stream(rows, out, tb.RULES).awaitTermination()
    return st.job_totals(spark, out).filter("count > 0")


@query(
    "stream_rate_counts",
    """SELECT user_id AS owner_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END) AS BIGINT) AS used
    FROM events GROUP BY ALL""",
)
def stream_rate_counts(spark, sf):
    requests = _stream(spark, sf, "events").select(
        F.col("user_id").alias("owner_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", 3).otherwise(1).alias("cost"),
    )
    out = tb.fresh_folder(spark, "rates")
    counts = st.rate_counts(requests, "1 day")

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(st.epoch_folder(f"{out}/rows", epoch))

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = jb.latest(rows, ["owner_id", "window_start"], [F.desc("epoch")])
    return last.select("owner_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "used")


@query(
    "stream_rate_verdicts",
    """WITH q AS (SELECT event_id AS request_id, user_id AS owner_id, ts, CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END AS cost FROM events),
      w AS (SELECT *, sum(cost) OVER (PARTITION BY owner_id, date_trunc('minute', ts) ORDER BY ts, request_id) AS m,
        sum(cost) OVER (PARTITION BY owner_id, date_trunc('day', ts) ORDER BY ts, request_id) AS d FROM q)
    SELECT request_id, owner_id, CAST(m AS BIGINT) AS minute_count, CAST(d AS BIGINT) AS day_count, m > 2 OR d > 5 AS rejected FROM w""",
)
def stream_rate_verdicts(spark, sf):
    requests = _stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("owner_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", 3).otherwise(1).cast("bigint").alias("cost"),
        F.lit(2).alias("rpm_limit"),
        F.lit(5).alias("daily_limit"),
    )
    out = tb.fresh_folder(spark, "verdicts")
    st.verdict_stream(requests, out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("request_id", "owner_id", "minute_count", "day_count", "rejected")


@query(
    "stream_event_log",
    """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('purchase', 'error') AS bump FROM events)
    SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, CAST(sum(CASE WHEN bump THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM e""",
)
def stream_event_log(spark, sf):
    kind = F.col("event_type")
    log = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "batch_completed").when(kind == "error", "batch_failed").otherwise("batch_started").alias("type"),
    )
    out = tb.fresh_folder(spark, "log")
    st.log_stream(log, out).awaitTermination()
    return spark.read.parquet(f"{out}/events").select("job_id", "event_id", "version")


@query(
    "stream_invalidation",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS owner_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error'",
)
def stream_invalidation(spark, sf):
    changes = _stream(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("owner_id"), F.col("ts").cast("timestamp").alias("created_at")
    )
    out = tb.fresh_folder(spark, "invalid")
    st.invalidation_stream(changes, out).awaitTermination()
    return spark.read.parquet(f"{out}/days").select("owner_id", "day").distinct()


@query(
    "stream_day_cache",
    f"""WITH {tb.SES} SELECT owner_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS messages,
      count(*) FILTER (turn % 3 = 1 AND conv_id % 4 > 1) AS correct, count(*) FILTER (turn % 3 = 1 AND conv_id % 4 = 0) AS incorrect,
      count(*) FILTER (turn % 3 = 1) AS edited, CAST(sum(length(content)) AS BIGINT) AS characters FROM ses GROUP BY ALL""",
)
def stream_day_cache(spark, sf):
    """Day summaries of all messages, kept up to date with a stream of reviews: only reviewed days are computed again."""
    said = tb.sessions(spark, sf).select("owner_id", "id", "created_at", "content")
    path, turn, conv = tb.fresh_folder(spark, "days"), F.col("turn"), F.col("conv_id")
    reviews = tb.table(spark, sf, "conversations").filter(turn % 3 == 1).select(
        F.concat_ws(":", conv.cast("string"), turn.cast("string")).alias("id"),
        F.when(conv % 4 == 0, "incorrect").when(conv % 4 == 1, "unknown").otherwise("correct").alias("correctness"),
        turn.cast("int").alias("edit_version"),
    )
    before = said.withColumns({"correctness": F.lit(None).cast("string"), "edit_version": F.lit(None).cast("int")})
    st.recompute_batch(before, -1, path, lambda: before)
    changed = said.join(reviews, "id").select("owner_id", "created_at")
    changed.write.parquet(f"{path}-changes")
    stream = st.files(spark, f"{path}-changes", changed.schema)
    st.recompute_stream(stream, path, f"{path}-checkpoint", lambda: said.join(reviews, "id", "left")).awaitTermination()
    columns = ["owner_id", "day", "messages", "correct", "incorrect", "edited", "characters"]
    schema = before.withColumn("day", F.lit("")).transform(pd.day_overview).withColumn("computed", F.lit(0).cast("bigint")).schema
    return keyed.read(spark, path, schema).select(columns)


@query(
    "stream_ordered_results",
    """SELECT user_id AS report_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, false AS late FROM events""",
)
def stream_ordered_results(spark, sf):
    """Results that come in three scrambled deliveries, released in index order."""
    events = tb.events(spark, sf).select(F.col("user_id").alias("report_id"), "ts", "event_id")
    numbered = rk.running(events, ["report_id"], ["ts", "event_id"], number="idx").select("report_id", "event_id", "idx")
    out = tb.fresh_folder(spark, "ordered")
    numbered.repartition(3, F.xxhash64("event_id")).write.parquet(f"{out}/in")
    results = st.files(spark, f"{out}/in", numbered.schema, per_trigger=1)
    st.ordered_stream(results, out).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("row.report_id", "row.event_id", "idx", "place", "late")


@query(
    "stream_expiry",
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%d') AS report_id, ts, event_id,
        CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'running' ELSE 'queued' END AS status FROM events),
      d AS (SELECT *, CASE status WHEN 'queued' THEN ts + INTERVAL 10 MINUTES WHEN 'running' THEN ts + INTERVAL 60 MINUTES END AS deadline,
        lead(ts) OVER (PARTITION BY report_id ORDER BY ts, event_id) AS next, row_number() OVER (PARTITION BY report_id ORDER BY ts, event_id) AS n FROM c),
      s AS (SELECT *, deadline IS NULL AS ended, CASE WHEN next IS NULL THEN epoch_ms(deadline) < (SELECT epoch_ms(max(ts)) FROM events)
        ELSE deadline < next END AS stale FROM d),
      f AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n) AS k FROM s WHERE ended OR stale)
    SELECT report_id, 'fail' AS render_status, 'failed' AS report_stage, deadline AS completed_at FROM f WHERE k = 1 AND stale""",
)
def stream_expiry(spark, sf):
    """Each report that stays queued or running too long, failed once at its deadline."""
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    changes = _stream(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(ts, "dd")).alias("report_id"),
        F.when(kind == "purchase", "success").when(kind == "error", "fail").when(kind == "click", "running").otherwise("queued").alias("render_status"),
        ts.alias("generated_at"),
        F.when(kind == "click", ts).alias("started_at"),
        ts.alias("ts"),
    )
    out = tb.fresh_folder(spark, "expiry")
    st.expiry_stream(changes, out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("report_id", "render_status", "report_stage", "completed_at")
