"""Structured Streaming versions of the job operators.

Every sink is a folder with one sub-folder per micro-batch, written in overwrite mode: a replayed micro-batch
replaces its own output, so results are exactly-once without locks.  Keyed state (seen keys, results that wait, deadlines) is
Spark's own, see :mod:`engram.streaming.stateful`; a large job is many keys there, so that it spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from engram import lexicons as lx
from engram import schemas
from engram.functions import text as tx
from engram.operators import aggregate as ag
from engram.operators import classify as cl
from engram.operators import jobs as jb
from engram.operators import limits as lm
from engram.operators import periods as pd
from engram.operators.rules import Rule, category_order
from engram.sources import keyed
from engram.streaming import folded
from engram.streaming import stateful as sf


def files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A folder of arriving files as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def epoch_folder(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def run(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# --- first-seen dedupe --------------------------------------------------------


def arrival() -> Column:
    """When a micro-batch began: the same for all its rows, and the same again in a replay."""
    return F.current_timestamp()


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def first_seen_stream(
    stream: DataFrame, scope: Sequence[str], id_col: str, hash_col: str, order: Sequence[str],
    ttl_hours: float = 24, time: Column | None = None, delay: str = "0 seconds", buckets: int = 16, clock: str = "EventTime",
) -> DataFrame:
    """The first rows of ids and of hashes: (job, kind 0 or 1, ref, row of ids). A row is new where both name it.

    Seen keys live in state by (job, kind, bucket), so a job of any size spreads over the tasks, and a micro-batch writes only keys that it
    brings. They are forgotten together, ``ttl_hours`` after the job's last write of any key: every write moves the one timer of its job,
    and the job tells its buckets. ``order`` names a row. ``time`` is the arrival unless given; rows that are later than ``delay``
    are judged all the same but do not renew their job. ``clock`` ProcessingTime fires timers without new rows, and
    needs arrival times and a continuous trigger.
    """
    ttl = round(ttl_hours * 3600 * 1_000_000)
    at = F.unix_micros(arrival() if time is None else time)
    both = F.array(
        F.struct(F.lit(0).alias("kind"), _key(id_col).alias("key"), F.struct(*stream.columns).alias("row")),
        F.struct(F.lit(1).alias("kind"), _key(hash_col).alias("key"), F.lit(None).cast(stream.schema).alias("row")),
    )
    # one name for a job, null fields and all
    job = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"})
    keys = stream.select(job.alias("job"), at.alias("at"), F.struct(*order).alias("ref"), F.inline(both))
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("job", "kind", "key"), F.lit(buckets)).cast("int"))
    spans = stream.select(job.alias("job"), at.alias("at")).mapInPandas(sf.activity_spans(ttl), "job string, start long, end long")
    spans = spans.withColumn("written", F.timestamp_micros("end")).withWatermark("written", delay)
    ended = spans.groupBy("job").transformWithState(
        sf.Activity(ttl, buckets), "job string, kind int, bucket int, forget_at array<long>", "Append", clock
    )
    events = keys.withColumn("forget_at", F.lit(None).cast("array<long>")).unionByName(ended, allowMissingColumns=True)
    out = f"job string, kind int, ref {keys.schema['ref'].dataType.simpleString()}, row {stream.schema.simpleString()}"
    return events.groupBy("job", "kind", "bucket").transformWithState(sf.SeenKeys(), out, "Append", "None")


def dedupe_batch(df: DataFrame, epoch: int, out: str) -> None:
    """Write the rows of a micro-batch whose id and hash are both new. ``df``: as :func:`first_seen_stream` gives it."""
    df = df.persist()
    hashes = df.filter("kind = 1").select(F.struct("job", "ref").alias("name"))
    ids = df.filter("kind = 0").withColumn("id_name", F.struct("job", "ref"))
    fresh = ids.join(hashes, F.col("id_name").eqNullSafe(F.col("name")), "left_semi")
    fresh.select("row.*").write.mode("overwrite").parquet(epoch_folder(f"{out}/rows", epoch))
    df.unpersist()


def dedupe_stream(
    stream: DataFrame, out: str, scope: Sequence[str], id_col: str, hash_col: str, order: Sequence[str],
    ttl_hours: float = 24, time: Column | None = None, delay: str = "0 seconds", buckets: int = 16, clock: str = "EventTime", **trigger,
) -> StreamingQuery:
    """Write the rows whose id and hash the job has not seen, see :func:`first_seen_stream`."""
    with sf.started_with(stream.sparkSession, sf.ROCKSDB | sf.ROWS_ONLY):
        firsts = first_seen_stream(stream, scope, id_col, hash_col, order, ttl_hours, time, delay, buckets, clock)
        return run(firsts, lambda df, epoch: dedupe_batch(df, epoch, out), f"{out}/checkpoint", **trigger)


# --- incremental aggregates ---------------------------------------------------

BATCH_ROW = ["job_id", "batch_index", "id"]
COUNT_KEYS = ["job_id", "kind", "key"]


def count_batch(classified: DataFrame, epoch: int, out: str, rules: Sequence[Rule]) -> None:
    """Write the counts of a micro-batch of distinct classified rows (job_id, batch_index, category, tags)."""
    keys = ["job_id", "batch_index"]
    classified = classified.select(*keys, "category", "tags").persist()
    universe = category_order([r.category for r in rules])
    counts = ag.category_counts(classified, keys, universe).select(
        *keys, F.lit("category").alias("kind"), F.col("category").alias("key"), "count"
    ).unionByName(
        ag.tag_counts(classified, keys).select(*keys, F.lit("tag").alias("kind"), F.col("tag").alias("key"), "count")
    )
    counts.write.mode("overwrite").parquet(epoch_folder(f"{out}/counts", epoch))
    processed = classified.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"))
    processed.write.mode("overwrite").parquet(epoch_folder(f"{out}/batches", epoch))
    classified.unpersist()


def merge_batch(df: DataFrame, epoch: int, out: str, rules: Sequence[Rule]) -> None:
    """Classify the rows of a micro-batch and write their counts; totals are summed when read.

    ``df``: job_id, batch_index, id, content. Rows that came in earlier micro-batches must be gone.
    """
    classified = cl.classify(df, rules).select(*BATCH_ROW, "category", "tags")
    count_batch(classified.dropDuplicates(BATCH_ROW), epoch, out, rules)


def merge_stream(
    stream: DataFrame, out: str, rules: Sequence[Rule], time: Column | None = None, keep: str = "24 hours", fold_every: int = 20, **trigger
) -> StreamingQuery:
    """Every (job, batch, id) counts once, whichever micro-batch brings it and however many files a batch comes in.

    The rows seen are Spark's own streaming state, and go when they are ``keep`` older than the newest arrival; what is delivered again after that
    counts again. ``time`` is the arrival unless given. Every ``fold_every`` micro-batches their counts are folded into one table.
    Rows are classified as they are read, so that no text reaches the state's shuffle or what is kept of a micro-batch.
    """
    arrived = stream.withColumn("__arrived", arrival() if time is None else time)
    classified = cl.classify(arrived, rules).select(*BATCH_ROW, "category", "tags", "__arrived")
    fresh = classified.withWatermark("__arrived", keep).dropDuplicatesWithinWatermark(BATCH_ROW).drop("__arrived")

    def process(df: DataFrame, epoch: int) -> None:
        count_batch(df, epoch, out, rules)
        if (epoch + 1) % fold_every == 0:
            folded.fold(df.sparkSession, f"{out}/counts", epoch, COUNT_KEYS, "count")
            folded.fold(df.sparkSession, f"{out}/batches", epoch, ["job_id", "batch_index"], "processed")

    with sf.started_with(stream.sparkSession, sf.ROCKSDB | sf.ROWS_ONLY):
        return run(fresh, process, f"{out}/checkpoint", **trigger)


def job_totals(spark: SparkSession, out: str) -> DataFrame:
    """Running counts of every job."""
    return folded.total(spark, f"{out}/counts", COUNT_KEYS, "count")


def job_progress(spark: SparkSession, out: str) -> DataFrame:
    """Batches met and rows counted for each job. A batch may have come in several micro-batches."""
    met = folded.total(spark, f"{out}/batches", ["job_id", "batch_index"], "processed")
    return met.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("completed_batches"), F.sum("processed").cast("bigint").alias("processed_memories")
    )


def running_counts(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same merge as a plain streaming aggregate, for sources that never deliver twice (update mode)."""
    return stream.groupBy(*keys).agg(F.sum(value).cast("bigint").alias("count"))


# --- rate windows, event log, sweeps -----------------------------------------


def rate_counts(requests: DataFrame, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Cost per owner and fixed UTC window. ``delay`` is how long late requests still count - an option of ours."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy("owner_id", F.window("ts", length).alias("w"))
        .agg(F.sum("cost").cast("bigint").alias("used"))
        .select("owner_id", F.col("w.start").alias("window_start"), "used")
    )


USED_KEYS = ["owner_id", "length", "start"]


def verdict_batch(df: DataFrame, epoch: int, out: str, keep_hours: int = 48, fold_every: int = 20) -> None:
    """Write the verdict of every request, counting what its minute and day have used in this and earlier micro-batches.

    ``df``: owner_id, request_id, ts, cost, rpm_limit, daily_limit. Inside a micro-batch requests count by time, between them
    by arrival. A micro-batch writes what its own windows use; folding every ``fold_every`` drops windows ``keep_hours`` older
    than the newest request.
    """
    df = df.persist()
    used = folded.total(df.sparkSession, f"{out}/used", USED_KEYS, "base", epoch - 1)
    if used is None:
        schema = StructType([df.schema["owner_id"]]).add("length", schemas.TEXT).add("start", schemas.TIME).add("base", schemas.LONG)
        used = df.sparkSession.createDataFrame([], schema)
    rows = lm.rate_windows(df).drop("rejected")
    for length in ("minute", "day"):
        base = used.filter(F.col("length") == length).select(F.col("owner_id").alias("__owner"), F.col("start").alias("__start"), F.col("base").alias("__base"))
        rows = rows.join(base, (F.col("owner_id") == F.col("__owner")) & (F.date_trunc(length, "ts") == F.col("__start")), "left")
        count = F.col(f"{length}_count") + F.coalesce("__base", F.lit(0))
        rows = rows.withColumn(f"{length}_count", count).drop("__owner", "__start", "__base")
    over = (F.col("minute_count") > F.col("rpm_limit")) | (F.col("day_count") > F.col("daily_limit"))
    rows.withColumn("rejected", F.coalesce(over, F.lit(True))).write.mode("overwrite").parquet(epoch_folder(f"{out}/rows", epoch))
    spent = [
        df.select("owner_id", F.lit(length).alias("length"), F.date_trunc(length, "ts").alias("start"), F.col("cost").cast("bigint").alias("base"))
        for length in ("minute", "day")
    ]
    now_used = spent[0].unionByName(spent[1]).groupBy(*USED_KEYS).agg(F.sum("base").alias("base"))
    now_used.write.mode("overwrite").parquet(epoch_folder(f"{out}/used", epoch))
    if (epoch + 1) % fold_every == 0:
        newest = df.agg(F.max("ts")).first()[0]
        keep = None if newest is None else F.col("start") > F.lit(newest) - F.make_dt_interval(hours=F.lit(keep_hours))
        folded.fold(df.sparkSession, f"{out}/used", epoch, USED_KEYS, "base", keep)
    df.unpersist()


def verdict_stream(requests: DataFrame, out: str, **trigger) -> StreamingQuery:
    return run(requests, lambda df, epoch: verdict_batch(df, epoch, out), f"{out}/checkpoint", **trigger)


def log_batch(df: DataFrame, epoch: int, out: str, fold_every: int = 20) -> None:
    """Append job events with their versions, continuing each job's own count. A micro-batch writes the steps of its own jobs."""
    base = folded.total(df.sparkSession, f"{out}/versions", ["job_id"], "version", epoch - 1)
    base = (df.sparkSession.createDataFrame([], schemas.JOB_VERSION) if base is None else base).withColumnRenamed("version", "base")
    versioned = jb.event_versions(df.persist())
    continued = versioned.join(base, "job_id", "left").withColumn("version", F.col("version") + F.coalesce("base", F.lit(0)))
    continued.drop("base").write.mode("overwrite").parquet(epoch_folder(f"{out}/events", epoch))
    steps = versioned.groupBy("job_id").agg(F.max("version").alias("version"))
    steps.write.mode("overwrite").parquet(epoch_folder(f"{out}/versions", epoch))
    if (epoch + 1) % fold_every == 0:
        folded.fold(df.sparkSession, f"{out}/versions", epoch, ["job_id"], "version")
    df.unpersist()


def log_stream(stream: DataFrame, out: str, **trigger) -> StreamingQuery:
    return run(stream, lambda df, epoch: log_batch(df, epoch, out), f"{out}/checkpoint", **trigger)


def invalidation_batch(df: DataFrame, epoch: int, out: str) -> None:
    """Days to recompute because one of their messages was marked, edited or reverted."""
    pd.invalidated_days(df).write.mode("overwrite").parquet(epoch_folder(f"{out}/days", epoch))


def invalidation_stream(stream: DataFrame, out: str, **trigger) -> StreamingQuery:
    return run(stream, lambda df, epoch: invalidation_batch(df, epoch, out), f"{out}/checkpoint", **trigger)


def day_part(day: Column, owner: Column, slices: int = 8) -> Column:
    """Where a day of an owner lies in a table of days."""
    return F.concat_ws("-", day, F.pmod(F.xxhash64(owner), F.lit(slices)).cast("string"))


def recompute_batch(
    df: DataFrame, epoch: int, path: str, messages: Callable[[], DataFrame], summarise: Callable[[DataFrame], DataFrame] = pd.day_overview
) -> list[str]:
    """Summarise again the days of the changed messages in ``df``, and put them into the table at ``path``; no other part is read or written.

    ``messages`` gives all messages as they are now (owner_id, created_at and what ``summarise`` reads); those of other days do not
    reach it. A day of which nothing is left gets a summary of no messages. Returns the parts that were rewritten.
    """
    days = pd.invalidated_days(df)
    now = messages().withColumn("day", tx.day_key(F.col("created_at"))).join(days, ["owner_id", "day"], "left_semi")
    fresh = summarise(now)
    rest = days.join(fresh.select("owner_id", "day"), ["owner_id", "day"], "left_anti")
    rows = fresh.unionByName(rest, allowMissingColumns=True).na.fill(0).withColumn("computed", F.lit(epoch).cast("bigint"))
    part = day_part(F.col("day"), F.col("owner_id"))
    return keyed.upsert(df.sparkSession, path, rows, ["owner_id", "day"], ["computed"], f"epoch-{epoch}", part)


def recompute_stream(changes: DataFrame, path: str, checkpoint: str, messages: Callable[[], DataFrame], **trigger) -> StreamingQuery:
    """Keep a table of day summaries up to date with a stream of changed messages (owner_id, created_at)."""
    return run(changes, lambda df, epoch: recompute_batch(df, epoch, path, messages), checkpoint, **trigger)


def stale_reports(
    changes: DataFrame, delay: str = "0 seconds", queued_minutes: int = 10, running_minutes: int = 60, clock: str = "EventTime", groups: int = 1 << 14
) -> DataFrame:
    """Reports that stay queued or running too long, each once, as the rows that fail them.

    ``changes``: report_id, render_status, generated_at, started_at, ts, one row for each status a report gets. Reports are kept in ``groups``
    by hash, and a group has one timer, at its first deadline: calls of the state do not grow with the reports. Deadlines are due when a
    change later than ``delay`` after them arrives, or with ``clock`` ProcessingTime by the clock. Changes that arrive later than
    ``delay`` are too late to count.
    """
    queued = F.col("generated_at") + F.make_dt_interval(mins=F.lit(queued_minutes))
    running = F.coalesce("started_at", "generated_at") + F.make_dt_interval(mins=F.lit(running_minutes))
    status = F.col("render_status")
    deadline = F.unix_micros(F.when(status == "queued", queued).when(status == "running", running))
    # of two changes at one time the last status comes last
    rank = F.when(status == "queued", 0).when(status == "running", 1).otherwise(2)
    rows = changes.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("report_id"), F.lit(groups)).alias("group"),
        "report_id", "ts", F.unix_micros("ts").alias("at"), F.struct(rank.alias("rank"), deadline.alias("deadline")).alias("ref"), deadline.alias("deadline"),
    )
    report_id = changes.schema["report_id"].dataType.simpleString()
    stale = sf.StaleReports(report_id, clock == "EventTime")
    failed = rows.groupBy("group").transformWithState(stale, f"report_id {report_id}, failed_at long", "Append", clock)
    return failed.select(
        "report_id",
        F.lit("fail").alias("render_status"),
        F.lit("failed").alias("report_stage"),
        F.timestamp_micros("failed_at").alias("completed_at"),
        F.lit(lx.EXPIRED_CODE).alias("fail_code"),
        F.lit(lx.EXPIRED_REASON).alias("fail_reason"),
    )


def _write_epochs(rows: DataFrame, out: str, **trigger) -> StreamingQuery:
    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(epoch_folder(f"{out}/rows", epoch))

    with sf.started_with(rows.sparkSession, sf.ROCKSDB):
        return run(rows, write, f"{out}/checkpoint", **trigger)


def expiry_stream(changes: DataFrame, out: str, delay: str = "0 seconds", clock: str = "EventTime", **trigger) -> StreamingQuery:
    """Write the rows that fail stale reports, see :func:`stale_reports`."""
    return _write_epochs(stale_reports(changes, delay, clock=clock), out, **trigger)


# --- results in index order -----------------------------------------------------


def in_index_order(
    results: DataFrame, report: str = "report_id", index: str = "idx", limit_minutes: float = 10, time: Column | None = None,
    first: int = 1, clock: str = "EventTime",
) -> DataFrame:
    """Results as they can be released: (report, idx, place, late, row), a report's in order of ``index``, counted by place.

    A result waits for the ones before it, ``limit_minutes`` at most from its arrival; then those that wait go in order, and an index passed over
    goes late when it comes. An index that comes again is not released again. Results without an index never are.
    """
    row = results.schema.simpleString()
    id_type = results.schema[report].dataType.simpleString()
    arrived = results.withColumn("arrived", arrival() if time is None else time).withWatermark("arrived", "0 seconds")
    rows = arrived.filter(F.col(index).isNotNull()).select(
        F.col(report).alias("report"), F.col(index).cast("long").alias("idx"), "arrived", F.unix_micros("arrived").alias("at"),
        F.struct(*results.columns).alias("row"),
    )
    buffer = sf.Reorder(round(limit_minutes * 60_000_000), row, first)
    return rows.groupBy("report").transformWithState(buffer, f"report {id_type}, idx long, place long, late boolean, row {row}", "Append", clock)


def ordered_stream(results: DataFrame, out: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Write results in index order, see :func:`in_index_order`."""
    return _write_epochs(in_index_order(results, **options), out, **(trigger or {}))
