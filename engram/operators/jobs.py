"""State tables: upserts, status rules, expiry, snapshots, cursors, edits, audit."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.operators.ranking import MAX_GROUP_ROWS, running, top_per_group


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Current rows with the newest change per key applied; a change wins a tie."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return top_per_group(both, keys, [*[F.desc(v) for v in version], F.desc("__new")], 1).drop("__new")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def allowed_pairs(transitions: dict[str, str]) -> list[str]:
    return [f"{a}>{b}" for a, bs in transitions.items() for b in bs]


def transition_violations(
    log: DataFrame, transitions: dict[str, str], order: Sequence[str] = ("ts", "event_id"), max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Status changes that the state machine does not allow. ``log``: entity_id, status and the order columns."""
    stepped = running(log, ["entity_id"], list(order), previous={"from_status": "status"}, max_group_rows=max_group_rows)
    pair = F.concat_ws(">", "from_status", "status")
    return stepped.filter(F.col("from_status").isNotNull() & ~pair.isin(allowed_pairs(transitions)))


def derived_statuses(
    outcomes: DataFrame, max_receives: int = 3, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Batch and job status after every outcome, and how long the batch took.

    ``outcomes``: job_id, batch_index, ts, event_id, ok, receive_count, started_at, expected_total_batches.
    """
    counted = running(
        outcomes.withColumn("done", F.col("ok").cast("bigint")),
        ["job_id"],
        ["ts", "event_id"],
        sums={"completed_batches": "done"},
        max_group_rows=max_group_rows,
        sized_by=outcomes,
    )
    retry = F.col("receive_count") < max_receives
    return counted.withColumns(
        {
            "batch_status": F.when(F.col("ok"), "SUCCEEDED").when(retry, "RETRYING").otherwise("FAILED"),
            "job_status": F.when(
                F.col("ok"),
                F.when(F.col("completed_batches") >= F.col("expected_total_batches"), "COMPLETED").otherwise("PARTIAL"),
            )
            .when(retry, "PARTIAL")
            .otherwise("PARTIAL_FAILED"),
            "duration_ms": F.floor((F.unix_micros("ts") - F.unix_micros("started_at")) / 1000).cast("bigint"),
        }
    ).drop("done")


def is_stale(now: Column, queued_minutes: int = 10, running_minutes: int = 60) -> Column:
    """Queued too long by creation time, or running too long by start (else creation) time."""
    queued_before = now - F.make_dt_interval(mins=F.lit(queued_minutes))
    running_before = now - F.make_dt_interval(mins=F.lit(running_minutes))
    return (
        F.when(F.col("render_status") == "queued", F.col("generated_at") < queued_before)
        .when(F.col("render_status") == "running", F.coalesce("started_at", "generated_at") < running_before)
        .otherwise(F.lit(False))
    )


def expire_stale(reports: DataFrame, now: Column) -> DataFrame:
    """Reports with the stale ones failed."""
    stale = is_stale(now)

    def changed(value: Column, column: str) -> Column:
        return F.when(stale, value).otherwise(F.col(column))

    return reports.select(
        *[c for c in reports.columns if c not in ("render_status", "report_stage", "completed_at", "fail_code", "fail_reason")],
        changed(F.lit("fail"), "render_status").alias("render_status"),
        changed(F.lit("failed"), "report_stage").alias("report_stage"),
        changed(now, "completed_at").alias("completed_at"),
        changed(F.lit(lx.EXPIRED_CODE), "fail_code").alias("fail_code"),
        changed(F.lit(lx.EXPIRED_REASON), "fail_reason").alias("fail_reason"),
    )


def cleanup_is_fresh(status: Column, started: Column, requested: Column, now: Column, minutes: int = 30) -> Column:
    """An active clean-up that started (else was requested) recently enough to be left alone."""
    since = F.coalesce(started, requested)
    fresh = since.isNotNull() & (since >= now - F.make_dt_interval(mins=F.lit(minutes)))
    return F.coalesce(status.isin("QUEUED", "RUNNING") & fresh, F.lit(False))


def deletion_refusal(report_status: Column, cleanup_fresh: Column) -> Column:
    return F.when(~report_status.isin(*lx.TERMINAL_REPORT_STATUSES), "DEEP_ANALYSIS_REPORT_RUNNING").when(
        cleanup_fresh, "DEEP_ANALYSIS_DUPLICATE_CLEANUP_RUNNING"
    )


def report_view(reports: DataFrame) -> DataFrame:
    """Stored status and stage mapped to the published ones; content only when successful."""
    raw = F.col("render_status")
    status = F.when(raw.isin(*lx.RENDER_STATUSES), raw).when(raw == "failed", "fail").otherwise("success")
    stage = F.when(F.col("report_stage").isin(*lx.REPORT_STAGES), F.col("report_stage")).otherwise("complete")
    return reports.withColumns(
        {
            "report_content": F.when(status == "success", F.col("report_content")),
            "render_status": status,
            "report_stage": stage,
        }
    )


def batch_snapshot(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Batches with their cached result; without one, all memories count as processed once it succeeded."""
    held = results.select(
        "job_id",
        "batch_index",
        F.col("processed").alias("r_processed"),
        "top_categories",
        "top_tags",
        F.lit(True).alias("cached"),
    )
    joined = batches.join(held, ["job_id", "batch_index"], "left")
    default = F.when(F.col("status") == "SUCCEEDED", F.col("memory_count")).otherwise(F.lit(0))
    empty = F.lit("")
    return joined.select(
        *batches.columns,
        F.when(F.col("cached"), F.col("r_processed")).otherwise(default).cast("bigint").alias("processed_memories"),
        F.coalesce("top_categories", empty).alias("top_categories"),
        F.coalesce("top_tags", empty).alias("top_tags"),
    )


def job_progress(batches: DataFrame) -> DataFrame:
    """Stored progress: uploaded counts as the largest batch index."""
    return batches.groupBy("job_id").agg(
        F.max("batch_index").cast("bigint").alias("uploaded_batches"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("completed_batches"),
        F.count_if(F.col("status") == "FAILED").alias("failed_batches"),
        F.sum(F.when(F.col("status") == "SUCCEEDED", F.col("memory_count")).otherwise(0)).cast("bigint").alias("processed_memories"),
    )


def event_versions(events: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Version of every event: completed and failed batches raise it, the others reuse the current one."""
    bumps = F.col("type").isin("batch_completed", "batch_failed").cast("bigint")
    return running(
        events.withColumn("bump", bumps),
        ["job_id"],
        ["ts", "event_id"],
        sums={"version": "bump"},
        max_group_rows=max_group_rows,
        sized_by=events,
    ).drop("bump")


def changes_since(versioned: DataFrame, cursors: DataFrame, results: DataFrame) -> DataFrame:
    """Events newer than each job's cursor, the batch result behind completed ones, and the next cursor."""
    current = versioned.groupBy("job_id").agg(F.max("version").alias("next_cursor"))
    # adaptive skew join splits a job that holds many events
    newer = versioned.join(cursors.join(current, "job_id"), "job_id").filter(F.col("version") > F.col("cursor"))
    done = results.select("job_id", "batch_index", F.col("processed").alias("batch_processed"))
    return newer.join(
        done.withColumn("type", F.lit("batch_completed")), ["job_id", "batch_index", "type"], "left"
    )


def with_edits(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages with the latest edit applied: content, tags and correctness.

    ``edits``: id, version, correctness, edited_content, edited_tags.
    """
    last = latest(edits, ["id"], [F.desc("version")]).select(
        "id", F.col("version").alias("edit_version"), "correctness", "edited_content", "edited_tags"
    )
    return messages.join(last, "id", "left").withColumns(
        {
            "content": F.coalesce("edited_content", "content"),
            "tags": F.coalesce("edited_tags", "tags"),
            "correctness": F.when(F.col("correctness").isin("correct", "incorrect"), F.col("correctness")),
        }
    ).drop("edited_content", "edited_tags")


def audit_rows(requests: DataFrame) -> DataFrame:
    """One audit row per answered request; counters of 0 are stored as null."""
    return requests.select(
        "request_id",
        "owner_id",
        "ts",
        "route",
        "job_id",
        F.nullif("batch_index", F.lit(0)).alias("batch_index"),
        F.nullif("memory_count", F.lit(0)).alias("memory_count"),
        "status_code",
        "latency_ms",
    )


def owner_activity(audit: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    seen = audit.groupBy("owner_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    if owners is None:
        return seen.withColumn("plan_code", F.lit("default"))
    return seen.join(owners.select("owner_id", "plan_code"), "owner_id", "left").withColumn(
        "plan_code", F.coalesce("plan_code", F.lit("default"))
    )


RETENTION = {"payload": "7 days", "result": "24 hours", "period": "30 days"}


def retained(df: DataFrame, column: str, now: Column, kind: str) -> DataFrame:
    return df.filter(F.col(column) > now - F.expr(f"INTERVAL {RETENTION[kind]}"))


# --- model and source calls ---------------------------------------------------


def retryable_status(status: Column) -> Column:
    return F.coalesce((status == 408) | (status == 429) | (status >= 500), F.lit(False))


def retryable_call(code: Column, status: Column) -> Column:
    """Errors without a code are unexpected and retried; HTTP errors by status."""
    transport = (
        "DEEP_ANALYSIS_SOURCE_FETCH_FAILED",
        "QWEN_REQUEST_FAILED",
        "QWEN_REQUEST_TIMEOUT",
        "QWEN_EMPTY_RESPONSE",
    )
    return (
        F.when(code.isNull() | code.isin(*transport), F.lit(True))
        .when(code == "QWEN_HTTP_ERROR", retryable_status(status))
        .otherwise(F.lit(False))
    )


# --- fixed values: texts shown for failed calls ------------------------------
FAILURE_TEXTS = {
    "DEEP_ANALYSIS_SOURCE_FETCH_FAILED": "Memory source API is unavailable or timed out. Please retry later.",
    "QWEN_REQUEST_TIMEOUT": "Qwen request timed out. Please retry later.",
    "QWEN_REQUEST_FAILED": "Qwen service is unavailable. Please retry later.",
    "QWEN_NOT_CONFIGURED": "Qwen API key or model is not configured.",
    "QWEN_EMPTY_RESPONSE": "Qwen returned an invalid response. Please retry later.",
    "QWEN_JSON_PARSE_FAILED": "Qwen returned an invalid response. Please retry later.",
}
FAILURE_UNEXPECTED = "Memory analysis failed because of an unexpected server error. Please retry later."
FAILURE_OTHER = "Memory analysis generation failed. Please retry later."
FAILURE_AUTH = "Qwen authentication failed. Please check the configured API key."
FAILURE_RATE = "Qwen rate limit was reached. Please retry later."
FAILURE_SERVER = "Qwen service returned a server error. Please retry later."


def failure_reason(code: Column, status: Column) -> Column:
    http = (
        F.when(status.isin(401, 403), FAILURE_AUTH)
        .when(status == 429, FAILURE_RATE)
        .when(status >= 500, FAILURE_SERVER)
        .otherwise(
            F.concat(
                F.lit("Qwen request was rejected with HTTP "), F.coalesce(status.cast("string"), F.lit("error")), F.lit(".")
            )
        )
    )
    chain = F.when(code.isNull(), FAILURE_UNEXPECTED).when(code == "QWEN_HTTP_ERROR", http)
    for name, text in FAILURE_TEXTS.items():
        chain = chain.when(code == name, text)
    return chain.otherwise(FAILURE_OTHER)


def backoff_plan(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], base_ms: int, max_attempts: int = 3,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Attempt number, whether another follows, and the linear wait before it. ``attempts`` carries retryable."""
    numbered = running(attempts, keys, order, number="attempt", max_group_rows=max_group_rows)
    will_retry = F.col("retryable") & (F.col("attempt") < max_attempts)
    return numbered.withColumns(
        {
            "will_retry": will_retry,
            "wait_ms": F.when(will_retry, F.col("attempt") * base_ms).cast("bigint"),
            "final_attempt": F.col("attempt") >= max_attempts,
        }
    )


def usage_rollup(calls: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Requests, successes, failures and tokens; missing token counts are 0."""

    def total(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)

    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        total("prompt_tokens"),
        total("completion_tokens"),
        total("total_tokens"),
    )


def ordered_calls(calls: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Calls of a report in listing order: chunk calls, then the synthesis; by index and time."""
    stage = F.when(F.col("stage") == "chunk_analysis", 0).otherwise(1)
    return running(
        calls.withColumn("stage_rank", stage),
        ["report_id"],
        ["stage_rank", "idx", "requested_at", "call_id"],
        number="place",
        max_group_rows=max_group_rows,
        sized_by=calls,
    ).drop("stage_rank")


def hmac_keys(pepper: str) -> tuple[str, str]:
    """The 64-byte inner and outer key of HMAC-SHA256, as hex; a longer pepper is hashed first."""
    secret = pepper.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in secret).hex(), bytes(b ^ 0x5C for b in secret).hex()


def hashed_owner(column: str, pepper: str) -> Column:
    """HMAC-SHA256 of a key column as hex: two rounds of SHA-256 behind constant keys. Null stays null."""
    inner, outer = hmac_keys(pepper)
    message = F.encode(F.col(column), "utf-8")
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)
