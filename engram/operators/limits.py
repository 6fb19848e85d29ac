"""Request costs, rate windows, daily slots and admission checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators.ranking import MAX_GROUP_ROWS, largest_group, running


def request_cost(method: Column, url: Column) -> Column:
    return (
        F.when((method == "PUT") & F.contains(url, F.lit("/batches/")), 3)
        .when((method == "POST") & F.endswith(url, F.lit("/analysis-jobs")), 2)
        .otherwise(1)
        .cast("bigint")
    )


def with_policy(requests: DataFrame, owners: DataFrame, policies: DataFrame) -> DataFrame:
    """owner -> plan -> enabled policy. The tables are small; Spark broadcasts them when their size allows."""
    enabled = policies.filter("enabled").drop("enabled")
    plan = owners.select("owner_id", "plan_code")
    return requests.join(plan, "owner_id", "left").withColumn(
        "plan_code", F.coalesce("plan_code", F.lit("default"))
    ).join(enabled, "plan_code", "left")


def rate_windows(requests: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Cost used so far in the UTC minute and day of every request, and the verdict.

    ``requests``: owner_id, request_id, ts, cost, rpm_limit, daily_limit. Rejected requests use budget too.
    """
    marked = requests.withColumns(
        {"minute": F.date_trunc("minute", "ts"), "day": F.date_trunc("day", "ts")}
    )
    order, day = ["ts", "request_id"], ["owner_id", "day"]
    bounds = {"max_group_rows": max_group_rows, "group_rows": largest_group(marked, day)}
    by_day = running(marked, day, order, sums={"day_count": "cost"}, **bounds)
    # a minute lies inside its day: rows grouped by (owner, day) need no second shuffle
    by_minute = running(by_day, [*day, "minute"], order, sums={"minute_count": "cost"}, **bounds)
    over = (F.col("minute_count") > F.col("rpm_limit")) | (F.col("day_count") > F.col("daily_limit"))
    return by_minute.withColumn("rejected", F.coalesce(over, F.lit(True))).drop("minute", "day")


def daily_slots(
    requests: DataFrame,
    limit: int = 3,
    max_memories: int = lx.MAX_REPORT_MEMORIES,
    running_statuses: tuple[str, ...] = lx.RUNNING_REPORT_STATUSES,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Slot or refusal of every report request of a local day.

    ``requests``: owner_id, report_id, requested_at, day_key, status, memory_count, allow_listed.  A request
    that is too large is refused and takes no slot, so the accepted ones before a request are the first
    ``limit`` of the others, up to the first that is still running.
    """
    keys, order = ["owner_id", "day_key"], ["requested_at", "report_id"]
    bounds = {"max_group_rows": max_group_rows, "group_rows": largest_group(requests, keys)}
    fits = (F.col("memory_count") <= max_memories).cast("bigint")
    counted = running(requests.withColumn("fits", fits), keys, order, sums={"upto": "fits"}, **bounds)
    before = F.col("upto") - F.col("fits")
    open_slot = F.col("allow_listed") | (before < limit)
    blocks = (F.col("fits") == 1) & open_slot & F.col("status").isin(*running_statuses)
    blocked = running(
        counted.withColumns({"before": before, "blocks": blocks.cast("bigint")}),
        keys,
        order,
        sums={"blocks_upto": "blocks"},
        **bounds,
    )
    code = (
        F.when(F.col("blocks_upto") - F.col("blocks") > 0, "DEEP_ANALYSIS_ALREADY_RUNNING")
        .when(~F.col("allow_listed") & (F.col("before") >= limit), "DEEP_ANALYSIS_DAILY_LIMIT")
        .when(F.col("fits") == 0, "DEEP_ANALYSIS_TOO_MANY_MEMORIES")
    )
    slot = (F.col("before") + 1).cast("string")
    key = (
        F.when(F.col("allow_listed"), F.concat(F.col("day_key"), F.lit("#rerun-"), slot))
        .when(F.col("before") == 0, F.col("day_key"))
        .otherwise(F.concat(F.col("day_key"), F.lit("#"), slot))
    )
    return blocked.withColumn("code", code).select(
        *requests.columns, "code", F.when(F.col("code").isNull(), key).alias("slot_key")
    )


def date_range_error(after: Column, before: Column, max_days: int = lx.MAX_RANGE_DAYS) -> Column:
    """First failing check of a requested range of ISO strings, null when it is valid."""
    a, b = tx.blank_to_null(after), tx.blank_to_null(before)
    start, end = a.try_cast("timestamp"), b.try_cast("timestamp")
    span = F.unix_micros(end) - F.unix_micros(start)
    return (
        F.when(a.isNull() | b.isNull(), "MEMORY_ANALYSIS_DATE_RANGE_REQUIRED")
        .when(start.isNull() | end.isNull() | (start >= end), "MEMORY_ANALYSIS_INVALID_DATE_RANGE")
        .when(span > max_days * 86_400_000_000, "MEMORY_ANALYSIS_DATE_RANGE_TOO_LARGE")
    )


def json_string(c: Column) -> Column:
    """``c`` as a quoted JSON string."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def canonical_payload(memory_count: Column, memories: Column) -> Column:
    """Canonical text of a batch: array<struct<id, content, created_at, metadata_json>> in upload order."""

    def one(m: Column) -> Column:
        return F.concat(
            F.lit('{"id":'),
            json_string(m["id"]),
            F.lit(',"content":'),
            json_string(m["content"]),
            F.lit(',"createdAt":'),
            json_string(m["created_at"]),
            F.lit(',"metadata":'),
            F.coalesce(m["metadata_json"], F.lit("{}")),
            F.lit("}"),
        )

    return F.concat(
        F.lit('{"memoryCount":'),
        memory_count.cast("string"),
        F.lit(',"memories":['),
        F.array_join(F.transform(memories, one), ","),
        F.lit("]}"),
    )


def batch_admission(
    batches: DataFrame, max_memories: int = lx.MAX_BATCH_MEMORIES, max_bytes: int = lx.MAX_BATCH_BYTES
) -> DataFrame:
    """Payload hash and size, and the first failing check. ``batches`` carries expected_total_batches."""
    canonical = canonical_payload(F.col("memory_count"), F.col("memories"))
    sized = batches.withColumn("__canonical", canonical).withColumns(
        {"computed_hash": F.sha2("__canonical", 256), "payload_bytes": F.octet_length("__canonical").cast("bigint")}
    )
    code = (
        F.when(~F.col("batch_index").between(1, F.col("expected_total_batches")), "BATCH_INDEX_OUT_OF_RANGE")
        .when(F.col("memory_count") != F.size("memories"), "MEMORY_COUNT_MISMATCH")
        .when(F.col("memory_count") > max_memories, "MAX_BATCH_MEMORIES_EXCEEDED")
        .when(F.col("payload_bytes") > max_bytes, "MAX_BATCH_BYTES_EXCEEDED")
        .when(F.col("payload_hash") != F.col("computed_hash"), "BATCH_HASH_VALIDATION_FAILED")
    )
    return sized.withColumn("code", code).drop("__canonical")


def job_admission(
    requests: DataFrame, active: DataFrame, default_batch_size: int = 100, max_memories: int = lx.MAX_BATCH_MEMORIES
) -> DataFrame:
    """First failing check of a new job. ``requests`` carries its policy; ``active``: owner_id, active_jobs."""
    joined = requests.join(active, "owner_id", "left")
    code = (
        F.when(F.col("max_batches_per_job").isNull(), "RATE_LIMIT_POLICY_NOT_FOUND")
        .when(F.col("expected_total_batches") > F.col("max_batches_per_job"), "MAX_BATCHES_EXCEEDED")
        .when(F.coalesce("active_jobs", F.lit(0)) >= F.col("max_active_jobs"), "MAX_ACTIVE_JOBS_EXCEEDED")
        .when(
            (F.col("batch_size") > default_batch_size) & (F.col("batch_size") > max_memories), "BATCH_SIZE_EXCEEDED"
        )
    )
    return joined.withColumn("code", code)


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*lx.ACTIVE_JOB_STATUSES)).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("active_jobs")
    )


def reports_per_day(reports: DataFrame) -> DataFrame:
    return reports.groupBy("owner_id", F.date_format("generated_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("reports")
    )
