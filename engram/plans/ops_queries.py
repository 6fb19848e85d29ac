"""Sources, limits, state tables and call logs over events, orders, customers and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators import aggregate as ag
from engram.operators import jobs as jb
from engram.operators import ranking as rk
from engram.operators import limits as lm
from engram.plans import tables as tb
from engram.plans.registry import query
from engram.sources import keyed
from engram.session import ensure_checkpoint_dir
from engram.sources import memories as src

ISO = "'%Y-%m-%d %H:%M:%S.%f'"


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# --- sources ------------------------------------------------------------------


@query(
    "deep_scan",
    f"WITH {tb.MEM} SELECT id, owner_id, memory_type FROM mem WHERE state = 'active' AND memory_type IN ('pinned', 'insight')",
)
def deep_scan(spark, sf):
    return src.deep_memories(tb.documents(spark, sf)).select("id", "owner_id", "memory_type")


@query(
    "period_scan",
    f"""WITH {tb.SES} SELECT id, owner_id FROM ses WHERE created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-06 00:03:00'
      AND NOT coalesce(metadata_json LIKE '%"correctness":"incorrect"%', false)""",
)
def period_scan(spark, sf):
    after, before = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-06 00:03:00").cast("timestamp")
    return src.period_memories(tb.sessions(spark, sf), after, before).select("id", "owner_id")


@query(
    "profile_scan",
    f"""WITH {tb.MEM}, r AS (SELECT id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id) AS n FROM mem
      WHERE state = 'active' AND memory_type IN ('fact', 'insight', 'pinned')) SELECT id, owner_id FROM r WHERE n <= 25""",
)
def profile_scan(spark, sf):
    return src.profile_memories(tb.documents(spark, sf), 25).select("id", "owner_id")


@query(
    "source_counts",
    f"""WITH {tb.MEM} SELECT owner_id, count(*) AS "count" FROM mem WHERE state = 'active' AND memory_type IN ('session')
      AND created_at >= TIMESTAMP '2024-01-01 02:00:00' GROUP BY 1""",
)
def source_counts(spark, sf):
    return src.source_counts(tb.documents(spark, sf), ("session",), F.lit("2024-01-01 02:00:00").cast("timestamp"))


@query(
    "reviewed_filter",
    f"""WITH {tb.MEM} SELECT id FROM mem WHERE NOT (memory_type = 'session' AND doc_id % 5 = 0)""",
)
def reviewed_filter(spark, sf):
    return tb.documents(spark, sf).filter(~src.reviewed_incorrect()).select("id")


@query(
    "pages_with_total",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place,
        count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT user_id AS owner_id, event_id, place, total FROM r WHERE place > 10 AND place <= 15""",
)
def pages_with_total(spark, sf):
    df = tb.events(spark, sf).select(F.col("user_id").alias("owner_id"), "event_id", "ts")
    return src.page_per_owner(df, [F.desc("ts"), F.desc("event_id")], 5, 10).drop("ts")


@query(
    "listing_pages",
    """WITH r AS (SELECT event_id AS id, user_id AS owner_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events)
    SELECT id, owner_id, (place - 1) // 40 AS page FROM r WHERE place <= 160""",
)
def listing_pages(spark, sf):
    """Four pages of a listing, each from the cursor of the one before."""
    path = tb.fresh_folder(spark, "listing")
    memories = tb.events(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at"))
    src.write_listing(memories, path, 16)
    pages, cursor = [], None
    for number in range(4):
        page = src.page_after(spark, path, cursor, 40)
        pages.append(page.select("id", "owner_id", F.lit(number).cast("bigint").alias("page")))
        last = page.orderBy("created_at", F.desc("id")).first()
        cursor = (last["created_at"], last["id"])
    return rk.union_all(pages)


@query(
    "owner_activity",
    f"""SELECT user_id AS owner_id, strftime(min(ts), {ISO}) AS first_seen, strftime(max(ts), {ISO}) AS last_seen,
      CASE WHEN user_id % 4 = 0 THEN 'pro' ELSE 'default' END AS plan_code FROM events GROUP BY user_id""",
)
def owner_activity(spark, sf):
    audit = tb.events(spark, sf).select(F.col("user_id").alias("owner_id"), "ts")
    owners = audit.select("owner_id").distinct().filter(F.col("owner_id") % 4 == 0).withColumn("plan_code", F.lit("pro"))
    return jb.owner_activity(audit, owners).select("owner_id", _ts("first_seen"), _ts("last_seen"), "plan_code")


_INNER, _OUTER = jb.hmac_keys("pepper")


@query(
    "owner_hashes",
    f"""SELECT c_custkey, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(c_custkey AS VARCHAR))))) AS owner_hash FROM customer""",
)
def owner_hashes(spark, sf):
    customers = tb.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    return customers.select("c_custkey", jb.hashed_owner("k", "pepper").alias("owner_hash"))


@query(
    "audit_rows",
    """SELECT event_id AS request_id, user_id AS owner_id, nullif(event_id % 4, 0) AS batch_index,
      nullif(CAST(floor(value) AS BIGINT), 0) AS memory_count, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code FROM events""",
)
def audit_rows(spark, sf):
    return jb.audit_rows(_requests(spark, sf)).select("request_id", "owner_id", "batch_index", "memory_count", "status_code")


@query(
    "audit_table",
    """SELECT event_id AS request_id, user_id AS owner_id, nullif(event_id % 4, 0) AS batch_index, nullif(CAST(floor(value) AS BIGINT), 0) AS memory_count,
      CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code, 't' || CAST(event_id % 2 AS VARCHAR) AS transaction, CAST(ts AS DATE) AS day FROM events""",
)
def audit_table(spark, sf):
    """Requests appended in two transactions, each tried twice, and the rows that count read back."""
    path = tb.fresh_folder(spark, "audit")
    e = _requests(spark, sf)
    for k in (0, 1, 0, 1):
        keyed.append_audit(e.filter(F.col("request_id") % 2 == k), path, f"t{k}")
    return keyed.read_audit(spark, path).select("request_id", "owner_id", "batch_index", "memory_count", "status_code", "transaction", "day")


def _requests(spark, sf):
    return tb.events(spark, sf).select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("owner_id"),
        "ts",
        F.lit("/jobs").alias("route"),
        F.lit(None).cast("string").alias("job_id"),
        (F.col("event_id") % 4).alias("batch_index"),
        F.floor("value").cast("bigint").alias("memory_count"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.lit(1).alias("latency_ms"),
    )


# --- limits -------------------------------------------------------------------

_REQ = """req AS (SELECT event_id AS request_id, user_id AS owner_id, ts,
  CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS cost,
  CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 4 = 0 THEN 5 ELSE 2 END AS rpm,
  CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 4 = 0 THEN 9 ELSE 6 END AS daily FROM events)"""


def _policies(spark):
    rows = [("default", 2, 6, 30, 5, 12, True), ("pro", 5, 9, 30, 8, 20, True), ("closed", 1, 1, 1, 1, 1, False)]
    schema = (
        "plan_code string, rpm_limit int, daily_limit int, burst_limit int, max_active_jobs int, max_batches_per_job int, "
        "enabled boolean"
    )
    return spark.createDataFrame(rows, schema)


def _plan(owner):
    return F.when(owner % 10 == 9, "closed").when(owner % 4 == 0, "pro").otherwise("default")


@query(
    "rate_limit_windows",
    f"""WITH {_REQ}, w AS (SELECT *, sum(cost) OVER (PARTITION BY owner_id, date_trunc('minute', ts) ORDER BY ts, request_id) AS m,
        sum(cost) OVER (PARTITION BY owner_id, date_trunc('day', ts) ORDER BY ts, request_id) AS d FROM req)
    SELECT request_id, owner_id, CAST(m AS BIGINT) AS minute_count, CAST(d AS BIGINT) AS day_count, coalesce(m > rpm OR d > daily, true) AS rejected FROM w""",
)
def rate_limit_windows(spark, sf):
    kind = F.col("event_type")
    method = F.when(kind == "purchase", "PUT").when(kind == "signup", "POST").otherwise("GET")
    url = F.when(kind == "purchase", "/v1/analysis-jobs/j/batches/1").otherwise("/v1/analysis-jobs")
    requests = tb.events(spark, sf).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("owner_id"), "ts", lm.request_cost(method, url).alias("cost")
    )
    owners = requests.select("owner_id").distinct().withColumn("plan_code", _plan(F.col("owner_id")))
    priced = lm.with_policy(requests, owners, _policies(spark))
    return lm.rate_windows(priced).select("request_id", "owner_id", "minute_count", "day_count", "rejected")


_SLOT_REQ = """q AS (SELECT event_id AS report_id, user_id AS owner_id, ts, CAST(floor(value * 100) AS BIGINT) AS memory_count, user_id % 13 = 0 AS allow,
  strftime(ts, '%Y-%m-%d') || '@UTC' AS day_key,
  CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'ANALYZING' WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events),
f AS (SELECT *, CASE WHEN memory_count <= 20000 THEN 1 ELSE 0 END AS fits FROM q),
b AS (SELECT *, sum(fits) OVER (PARTITION BY owner_id, day_key ORDER BY ts, report_id) - fits AS before FROM f),
k AS (SELECT *, CASE WHEN fits = 1 AND (allow OR before < 2) AND status = 'ANALYZING' THEN 1 ELSE 0 END AS blocks FROM b),
v AS (SELECT *, sum(blocks) OVER (PARTITION BY owner_id, day_key ORDER BY ts, report_id) - blocks AS blocked FROM k),
c AS (SELECT *, CASE WHEN blocked > 0 THEN 'DEEP_ANALYSIS_ALREADY_RUNNING' WHEN NOT allow AND before >= 2 THEN 'DEEP_ANALYSIS_DAILY_LIMIT'
   WHEN fits = 0 THEN 'DEEP_ANALYSIS_TOO_MANY_MEMORIES' END AS code FROM v)"""


@query(
    "daily_slots",
    f"""WITH {_SLOT_REQ} SELECT report_id, owner_id, code, CASE WHEN code IS NOT NULL THEN NULL
      WHEN allow THEN day_key || '#rerun-' || CAST(before + 1 AS VARCHAR) WHEN before = 0 THEN day_key
      ELSE day_key || '#' || CAST(before + 1 AS VARCHAR) END AS slot_key FROM c""",
)
def daily_slots(spark, sf):
    kind = F.col("event_type")
    requests = tb.events(spark, sf).select(
        F.col("event_id").alias("report_id"),
        F.col("user_id").alias("owner_id"),
        F.col("ts").alias("requested_at"),
        tx.request_day_key(F.col("ts"), F.lit("UTC")).alias("day_key"),
        F.when((kind == "view") & (F.col("event_id") % 5 == 0), "ANALYZING")
        .when(kind == "error", "FAILED")
        .otherwise("COMPLETED")
        .alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("memory_count"),
        (F.col("user_id") % 13 == 0).alias("allow_listed"),
    )
    return lm.daily_slots(requests, limit=2).select("report_id", "owner_id", "code", "slot_key")


_PAIRS = """d AS (SELECT o_orderkey AS id,
   CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'someday' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a,
   CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE strftime(o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER) - 2), '%Y-%m-%d') END AS b FROM orders)"""


@query(
    "date_range_checks",
    f"""WITH {_PAIRS} SELECT id, CASE WHEN trim(a) = '' OR b IS NULL THEN 'MEMORY_ANALYSIS_DATE_RANGE_REQUIRED'
      WHEN a = 'someday' OR CAST(a AS DATE) >= CAST(b AS DATE) THEN 'MEMORY_ANALYSIS_INVALID_DATE_RANGE'
      WHEN CAST(b AS DATE) - CAST(a AS DATE) > 14 THEN 'MEMORY_ANALYSIS_DATE_RANGE_TOO_LARGE' END AS code FROM d""",
)
def date_range_checks(spark, sf):
    key, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    after = F.when(key % 7 == 0, "").when(key % 7 == 1, "someday").otherwise(date.cast("string"))
    before = F.when(key % 5 != 0, F.date_add(date, (key % 20 - 2).cast("int")).cast("string"))
    return tb.table(spark, sf, "orders").select(key.alias("id"), lm.date_range_error(after, before).alias("code"))


_BATCHES = f"""{tb.SES}, b AS (SELECT conv_id, turn // 100 + 1 AS batch_index, count(*) AS n,
   '[' || string_agg('{{"id":' || CAST(to_json(id) AS VARCHAR) || ',"content":' || CAST(to_json(content) AS VARCHAR) || ',"createdAt":"'
     || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","metadata":' || coalesce(metadata_json, '{{}}') || '}}', ',' ORDER BY turn) || ']' AS arr
   FROM ses GROUP BY ALL),
c AS (SELECT conv_id, batch_index, n, n + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS memory_count, arr FROM b),
p AS (SELECT *, '{{"memoryCount":' || CAST(memory_count AS VARCHAR) || ',"memories":' || arr || '}}' AS payload FROM c)"""


@query(
    "batch_admission",
    f"""WITH {_BATCHES} SELECT conv_id, batch_index, sha256(payload) AS computed_hash, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
      CASE WHEN batch_index NOT BETWEEN 1 AND CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 9 END THEN 'BATCH_INDEX_OUT_OF_RANGE'
        WHEN memory_count <> n THEN 'MEMORY_COUNT_MISMATCH' WHEN memory_count > 7 THEN 'MAX_BATCH_MEMORIES_EXCEEDED'
        WHEN strlen(payload) > 3000 THEN 'MAX_BATCH_BYTES_EXCEEDED' WHEN conv_id % 11 = 0 THEN 'BATCH_HASH_VALIDATION_FAILED' END AS code FROM p""",
)
def batch_admission(spark, sf):
    conv = F.col("conv_id")
    memory = F.struct("turn", "id", "content", tx.iso(F.col("created_at")).alias("created_at"), "metadata_json")
    # a batch is at most 100 turns of one conversation, so the list is bounded
    batches = (
        tb.sessions(spark, sf)
        .groupBy("conv_id", (F.floor(F.col("turn") / 100) + 1).cast("bigint").alias("batch_index"))
        .agg(F.sort_array(F.collect_list(memory)).alias("memories"))
        .withColumns(
            {
                "memory_count": F.size("memories") + F.when(conv % 7 == 0, 1).otherwise(0),
                "expected_total_batches": F.when(conv % 5 == 0, 0).otherwise(9),
                "payload_hash": F.when(conv % 11 == 0, "bad"),
            }
        )
    )
    admitted = lm.batch_admission(batches, max_memories=7, max_bytes=3000)
    return admitted.select("conv_id", "batch_index", "computed_hash", "payload_bytes", "code")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'PARTIAL' END"


@query(
    "job_admission",
    f"""WITH j AS (SELECT o_custkey AS owner_id, {_STATUS} AS status FROM orders),
      a AS (SELECT owner_id, count(*) AS n FROM j WHERE status IN ('UPLOADING', 'PROCESSING', 'PARTIAL') GROUP BY 1),
      r AS (SELECT c_custkey AS owner_id, c_nationkey AS batches, CASE WHEN c_custkey % 3 = 0 THEN 150 ELSE 50 END AS size,
        CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 4 = 0 THEN 20 ELSE 12 END AS mb,
        CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 4 = 0 THEN 8 ELSE 5 END AS mj FROM customer)
    SELECT owner_id, coalesce(n, 0) AS active_jobs, CASE WHEN mb IS NULL THEN 'RATE_LIMIT_POLICY_NOT_FOUND' WHEN batches > mb THEN 'MAX_BATCHES_EXCEEDED'
      WHEN coalesce(n, 0) >= mj THEN 'MAX_ACTIVE_JOBS_EXCEEDED' WHEN size > 100 THEN 'BATCH_SIZE_EXCEEDED' END AS code
    FROM r LEFT JOIN a USING (owner_id)""",
)
def job_admission(spark, sf):
    status = F.col("o_orderstatus")
    jobs = tb.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("owner_id"),
        F.when(status == "F", "COMPLETED").when(status == "O", "PROCESSING").otherwise("PARTIAL").alias("status"),
    )
    requests = tb.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("owner_id"),
        F.col("c_nationkey").alias("expected_total_batches"),
        F.when(F.col("c_custkey") % 3 == 0, 150).otherwise(50).alias("batch_size"),
    )
    owners = requests.select("owner_id", _plan(F.col("owner_id")).alias("plan_code"))
    admitted = lm.job_admission(lm.with_policy(requests, owners, _policies(spark)), lm.active_jobs(jobs))
    return admitted.select("owner_id", F.coalesce("active_jobs", F.lit(0)).alias("active_jobs"), "code")


@query(
    "reports_per_day",
    "SELECT user_id AS owner_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS reports FROM events GROUP BY ALL",
)
def reports_per_day(spark, sf):
    return lm.reports_per_day(
        tb.events(spark, sf).select(F.col("user_id").alias("owner_id"), F.col("ts").alias("generated_at"))
    )


# --- state tables -------------------------------------------------------------

_LOG_STATUS = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'COMPLETED' WHEN o_orderstatus = 'F' THEN 'PROCESSING'
   WHEN o_orderstatus = 'O' THEN 'UPLOADING' ELSE 'PARTIAL' END"""


@query(
    "transition_audit",
    f"""WITH l AS (SELECT o_orderkey, o_custkey, {_LOG_STATUS} AS status, o_orderdate FROM orders),
      s AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_status FROM l),
      ok(f, t) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in lx.JOB_TRANSITIONS.items() for b in bs)})
    SELECT o_custkey AS entity_id, o_orderkey AS event_id, from_status, status FROM s
    WHERE from_status IS NOT NULL AND (from_status, status) NOT IN (SELECT (f, t) FROM ok)""",
)
def transition_audit(spark, sf):
    status = F.col("o_orderstatus")
    log = tb.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "COMPLETED")
        .when(status == "F", "PROCESSING")
        .when(status == "O", "UPLOADING")
        .otherwise("PARTIAL")
        .alias("status"),
    )
    return jb.transition_violations(log, lx.JOB_TRANSITIONS).drop("ts")


@query(
    "status_derivation",
    """WITH o AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok, event_id % 5 + 1 AS rc,
        CAST(floor(value) AS BIGINT) AS secs FROM events),
      c AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM o)
    SELECT user_id AS job_id, event_id, CAST(done AS BIGINT) AS completed_batches, CASE WHEN ok THEN 'SUCCEEDED' WHEN rc < 3 THEN 'RETRYING' ELSE 'FAILED' END AS batch_status,
      CASE WHEN ok AND done >= 20 THEN 'COMPLETED' WHEN ok OR rc < 3 THEN 'PARTIAL' ELSE 'PARTIAL_FAILED' END AS job_status, secs * 1000 AS duration_ms FROM c""",
)
def status_derivation(spark, sf):
    outcomes = tb.events(spark, sf).select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("batch_index"),
        "ts",
        "event_id",
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 5 + 1).alias("receive_count"),
        (F.col("ts") - F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias("started_at"),
        F.lit(20).alias("expected_total_batches"),
    )
    return jb.derived_statuses(outcomes).select(
        "job_id", "event_id", "completed_batches", "batch_status", "job_status", "duration_ms"
    )


_REPORTS = """r AS (SELECT event_id AS report_id, ts AS generated_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 50 MINUTE END AS started_at,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'odd' ELSE 'success' END AS rs,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'aggregation' ELSE 'what' END AS stage FROM events)"""


def _reports(spark, sf):
    kind = F.col("event_type")
    return tb.events(spark, sf).select(
        F.col("event_id").alias("report_id"),
        F.col("ts").alias("generated_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 50 MINUTES")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.when(kind == "click", "queued").when(kind == "view", "running").when(kind == "error", "failed").when(kind == "signup", "odd")
        .otherwise("success").alias("render_status"),
        F.when(kind == "click", "queued").when(kind == "view", "aggregation").otherwise("what").alias("report_stage"),
        F.lit(None).cast("string").alias("fail_code"),
        F.lit(None).cast("string").alias("fail_reason"),
        F.col("props").alias("report_content"),
    )


@query(
    "stale_expiry",
    f"""WITH {_REPORTS}, s AS (SELECT *, CASE rs WHEN 'queued' THEN generated_at < TIMESTAMP '2024-01-14 23:50:00'
        WHEN 'running' THEN coalesce(started_at, generated_at) < TIMESTAMP '2024-01-14 23:00:00' ELSE false END AS stale FROM r)
    SELECT report_id, CASE WHEN stale THEN 'fail' ELSE rs END AS render_status, CASE WHEN stale THEN 'failed' ELSE stage END AS report_stage,
      CASE WHEN stale THEN 'MEMORY_ANALYSIS_REPORT_EXPIRED' END AS fail_code FROM s""",
)
def stale_expiry(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return jb.expire_stale(_reports(spark, sf), now).select("report_id", "render_status", "report_stage", "fail_code")


@query(
    "report_view",
    f"""WITH {_REPORTS} SELECT report_id, CASE WHEN rs IN ('queued', 'running', 'success') THEN rs WHEN rs = 'failed' THEN 'fail' ELSE 'success' END AS render_status,
      CASE WHEN stage = 'what' THEN 'complete' ELSE stage END AS report_stage, CASE WHEN rs IN ('success', 'odd') THEN props END AS report_content
    FROM r JOIN events e ON e.event_id = r.report_id""",
)
def report_view(spark, sf):
    return jb.report_view(_reports(spark, sf)).select("report_id", "render_status", "report_stage", "report_content")


@query(
    "deletable_reports",
    """SELECT event_id AS report_id, CASE WHEN event_type IN ('click', 'view') THEN 'DEEP_ANALYSIS_REPORT_RUNNING'
      WHEN event_id % 2 = 0 AND coalesce(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 50 MINUTE END, ts) >= TIMESTAMP '2024-01-14 23:30:00'
      THEN 'DEEP_ANALYSIS_DUPLICATE_CLEANUP_RUNNING' END AS code FROM events""",
)
def deletable_reports(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    status = F.when(F.col("render_status").isin("queued", "running"), "ANALYZING").otherwise("COMPLETED")
    cleanup = F.when(F.col("report_id") % 2 == 0, "RUNNING").otherwise("COMPLETED")
    fresh = jb.cleanup_is_fresh(cleanup, F.col("started_at"), F.col("generated_at"), now)
    return _reports(spark, sf).select("report_id", jb.deletion_refusal(status, fresh).alias("code"))


@query(
    "latest_reports",
    """SELECT user_id AS owner_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
      FROM events) WHERE r = 1""",
)
def latest_reports(spark, sf):
    e = tb.events(spark, sf).select(F.col("user_id").alias("owner_id"), "event_type", "event_id", "ts")
    return jb.latest(e, ["owner_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "state_upsert",
    """SELECT user_id AS key, event_id AS version, CAST(floor(value) AS BIGINT) AS v FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def state_upsert(spark, sf):
    e = tb.events(spark, sf).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.floor("value").cast("bigint").alias("v")
    )
    old, new = e.filter(F.col("version") % 2 == 0), e.filter(F.col("version") % 2 == 1)
    return jb.upsert(old, new, ["key"], ["version"])


@query(
    "keyed_upsert",
    """SELECT user_id AS key, event_id AS version, CAST(floor(value) AS BIGINT) AS v FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def keyed_upsert(spark, sf):
    """Three rounds of changes to a table on storage, the last one tried twice, and the table read back."""
    e = tb.events(spark, sf).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.floor("value").cast("bigint").alias("v")
    )
    path = tb.fresh_folder(spark, "keyed")
    for token in (0, 1, 2, 2):
        keyed.upsert(spark, path, e.filter(F.col("version") % 3 == token), ["key"], ["version"], f"round-{token}")
    return keyed.read(spark, path, e.schema)


@query(
    "retention",
    """SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR THEN 'result' WHEN ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY THEN 'payload'
       ELSE 'period' END AS kept_by FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 30 DAY""",
)
def retention(spark, sf):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    e = tb.events(spark, sf).select("event_id", "ts")
    kept = jb.retained(e, "ts", now, "period")
    result = jb.retained(e, "ts", now, "result").select("event_id", F.lit("result").alias("r"))
    payload = jb.retained(e, "ts", now, "payload").select("event_id", F.lit("payload").alias("p"))
    return (
        kept.join(result, "event_id", "left")
        .join(payload, "event_id", "left")
        .select("event_id", F.coalesce("r", "p", F.lit("period")).alias("kept_by"))
    )


_BATCH_SQL = """b AS (SELECT o_custkey AS job_id, o_orderkey AS batch_index, CAST(floor(o_totalprice / 1000) AS BIGINT) AS memory_count,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'QUEUED' ELSE 'FAILED' END AS status FROM orders)"""


def _job_batches(spark, sf):
    status = F.col("o_orderstatus")
    return tb.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"),
        F.col("o_orderkey").alias("batch_index"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("memory_count"),
        F.when(status == "F", "SUCCEEDED").when(status == "O", "QUEUED").otherwise("FAILED").alias("status"),
    )


@query(
    "job_snapshot",
    f"""WITH {_BATCH_SQL} SELECT job_id, batch_index, memory_count, status, CASE WHEN batch_index % 3 = 0 THEN memory_count - 1
       WHEN status = 'SUCCEEDED' THEN memory_count ELSE 0 END AS processed_memories,
       CASE WHEN batch_index % 3 = 0 THEN 'plan:1' ELSE '' END AS top_categories FROM b""",
)
def job_snapshot(spark, sf):
    batches = _job_batches(spark, sf)
    results = batches.filter(F.col("batch_index") % 3 == 0).select(
        "job_id",
        "batch_index",
        (F.col("memory_count") - 1).alias("processed"),
        F.lit("plan:1").alias("top_categories"),
        F.lit("x").alias("top_tags"),
    )
    return jb.batch_snapshot(batches, results).drop("top_tags")


@query(
    "progress_rollup",
    f"""WITH {_BATCH_SQL}, s AS (SELECT job_id, max(batch_index) AS u, count_if(status = 'SUCCEEDED') AS c, count_if(status = 'FAILED') AS f,
        CAST(sum(CASE WHEN status = 'SUCCEEDED' THEN memory_count ELSE 0 END) AS BIGINT) AS p FROM b GROUP BY 1),
      k AS (SELECT c_custkey AS job_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS x FROM customer WHERE c_custkey % 2 = 0)
    SELECT job_id, greatest(u, coalesce(x, 0)) AS uploaded_batches, greatest(c, coalesce(x, 0) % 7) AS completed_batches,
      greatest(f, coalesce(x, 0) % 5) AS failed_batches, greatest(p, coalesce(x, 0)) AS processed_memories FROM s LEFT JOIN k USING (job_id)""",
)
def progress_rollup(spark, sf):
    x = F.floor(F.abs("c_acctbal")).cast("bigint")
    cached = tb.table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("job_id"),
        x.alias("uploaded_batches"),
        (x % 7).alias("completed_batches"),
        (x % 5).alias("failed_batches"),
        x.alias("processed_memories"),
    )
    return ag.progress_rollup(cached, jb.job_progress(_job_batches(spark, sf)))


@query(
    "cursor_updates",
    """WITH e AS (SELECT user_id AS job_id, event_id, ts, value, CASE event_type WHEN 'click' THEN 'batch_uploaded' WHEN 'view' THEN 'batch_started'
         WHEN 'purchase' THEN 'batch_completed' WHEN 'error' THEN 'batch_failed' ELSE 'job_created' END AS type FROM events),
      v AS (SELECT *, sum(CASE WHEN type IN ('batch_completed', 'batch_failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS version FROM e),
      n AS (SELECT job_id, max(version) AS next_cursor FROM v GROUP BY 1)
    SELECT job_id, event_id, type, CAST(version AS BIGINT) AS version, CAST(next_cursor AS BIGINT) AS next_cursor,
      CASE WHEN type = 'batch_completed' AND event_id % 3 <> 0 THEN CAST(floor(value) AS BIGINT) END AS batch_processed
    FROM v JOIN n USING (job_id) WHERE version > job_id % 5 * 3""",
)
def cursor_updates(spark, sf):
    kind = F.col("event_type")
    log = tb.events(spark, sf).select(
        F.col("user_id").alias("job_id"),
        "event_id",
        F.col("event_id").alias("batch_index"),
        "ts",
        F.when(kind == "click", "batch_uploaded").when(kind == "view", "batch_started").when(kind == "purchase", "batch_completed")
        .when(kind == "error", "batch_failed").otherwise("job_created").alias("type"),
    )
    results = tb.events(spark, sf).filter((kind == "purchase") & (F.col("event_id") % 3 != 0)).select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("batch_index"), F.floor("value").cast("bigint").alias("processed")
    )
    cursors = log.select("job_id").distinct().withColumn("cursor", F.col("job_id") % 5 * 3)
    return jb.changes_since(jb.event_versions(log), cursors, results).select(
        "job_id", "event_id", "type", "version", "next_cursor", "batch_processed"
    )


@query(
    "edit_overlay",
    f"""WITH {tb.MEM}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
    SELECT id, CASE WHEN l.doc_id % 3 = 0 THEN 'edited ' || id ELSE content END AS content,
      CASE WHEN l.doc_id % 3 = 0 THEN 'fixed' ELSE array_to_string(tags, ',') END AS tags,
      CASE WHEN l.doc_id % 3 = 0 THEN NULL WHEN l.quality = 1 THEN 'correct' WHEN l.quality = 0 THEN 'incorrect' END AS correctness,
      CASE WHEN l.doc_id % 3 = 0 THEN 2 WHEN l.doc_id IS NOT NULL THEN 1 END AS edit_version
    FROM mem LEFT JOIN l USING (doc_id)""",
)
def edit_overlay(spark, sf):
    labels = tb.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit(1).alias("version"),
        F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("correctness"),
        F.lit(None).cast("string").alias("edited_content"),
        F.lit(None).cast("array<string>").alias("edited_tags"),
    )
    second = labels.filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit(2).alias("version"),
        F.lit("unknown").alias("correctness"),
        F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("edited_content"),
        F.array(F.lit("fixed")).alias("edited_tags"),
    )
    messages = tb.documents(spark, sf).select("id", "content", "tags")
    return jb.with_edits(messages, first.unionByName(second)).withColumn("tags", F.array_join("tags", ","))


# --- files written and read again ----------------------------------------------


def _folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "snapshot_roundtrip",
    f"""WITH {tb.MEM} SELECT id, owner_id, sha256(content) AS content_hash, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, memory_type, state,
        array_to_string(tags, ',') AS tags, metadata_json FROM mem WHERE state = 'active' AND memory_type IN ('pinned', 'insight')""",
)
def snapshot_roundtrip(spark, sf):
    path = _folder(spark, "snapshot")
    src.write_snapshot(tb.documents(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp")), path)
    back = src.deep_memories(src.read_snapshot(spark, path))
    return back.select(
        "id", "owner_id", F.sha2("content", 256).alias("content_hash"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        "memory_type", "state", F.array_join("tags", ",").alias("tags"), "metadata_json",
    )


@query(
    "table_scan",
    f"""WITH {tb.MEM} SELECT id, memory_type, 0 AS tags, metadata_json FROM mem WHERE state = 'active'""",
)
def table_scan(spark, sf):
    path = _folder(spark, "memories")
    tb.documents(spark, sf).drop("tags", "doc_id").write.parquet(path)  # a source without tags
    back = src.read_memories(spark, path).filter("state = 'active'")
    return back.select("id", "memory_type", F.size("tags").alias("tags"), "metadata_json")


@query(
    "batch_read",
    """SELECT source AS job_id, doc_id // 100 AS batch_index, CAST(row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS BIGINT) AS position,
        CAST(doc_id AS VARCHAR) AS id, sha256(text) AS content_hash FROM documents""",
)
def batch_read(spark, sf):
    path = _folder(spark, "batches")
    memory = F.struct("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    docs = tb.table(spark, sf, "documents").groupBy(F.col("source").alias("job_id"), F.floor(F.col("doc_id") / 100).alias("batch_index"))
    # a batch holds at most a hundred memories
    batches = docs.agg(F.count(F.lit(1)).alias("memory_count"), F.sort_array(F.collect_list(memory)).alias("memories"))
    batches.withColumn("memories", F.transform("memories", lambda m: F.struct(m["id"].alias("id"), m["content"].alias("content")))).write.json(path)
    rows = src.batch_memories(src.read_batches(spark, path))
    return rows.select("job_id", F.col("batch_index").cast("bigint").alias("batch_index"), "position", "id", F.sha2("content", 256).alias("content_hash"))


# --- calls --------------------------------------------------------------------

# fixed values: error codes of calls
_CODES = [
    "QWEN_HTTP_ERROR", "DEEP_ANALYSIS_SOURCE_FETCH_FAILED", "QWEN_REQUEST_FAILED", "QWEN_REQUEST_TIMEOUT",
    "QWEN_EMPTY_RESPONSE", "QWEN_NOT_CONFIGURED", "QWEN_JSON_PARSE_FAILED", "OTHER",
]
_HTTP = (401, 403, 408, 429, 500, 503, 404, 400, 418)
_CALL_SQL = f"""c AS (SELECT event_id, user_id, ts, value, event_type,
   [{", ".join(repr(x) for x in _CODES)}, NULL][event_id % 9 + 1] AS code, [{", ".join(map(str, _HTTP))}][event_id % 17 % 9 + 1] AS http FROM events)"""
_RETRY_SQL = """(code IS NULL OR code IN ('DEEP_ANALYSIS_SOURCE_FETCH_FAILED', 'QWEN_REQUEST_FAILED', 'QWEN_REQUEST_TIMEOUT', 'QWEN_EMPTY_RESPONSE')
   OR (code = 'QWEN_HTTP_ERROR' AND (http IN (408, 429) OR http >= 500)))"""


def _calls(spark, sf):
    key = F.col("event_id")
    codes = F.array(*[F.lit(c) for c in _CODES], F.lit(None).cast("string"))
    return tb.events(spark, sf).withColumns(
        {
            "code": F.get(codes, (key % 9).cast("int")),
            "http": F.get(F.array(*[F.lit(h) for h in _HTTP]), (key % 17 % 9).cast("int")),
        }
    )


@query(
    "retry_classes",
    f"""WITH {_CALL_SQL} SELECT event_id, {_RETRY_SQL} AS retryable, CASE WHEN code IS NULL THEN {tb._q(jb.FAILURE_UNEXPECTED)}
      WHEN code = 'QWEN_HTTP_ERROR' THEN CASE WHEN http IN (401, 403) THEN {tb._q(jb.FAILURE_AUTH)} WHEN http = 429 THEN {tb._q(jb.FAILURE_RATE)}
        WHEN http >= 500 THEN {tb._q(jb.FAILURE_SERVER)} ELSE 'Qwen request was rejected with HTTP ' || CAST(http AS VARCHAR) || '.' END
      {" ".join(f"WHEN code = '{k}' THEN {tb._q(v)}" for k, v in jb.FAILURE_TEXTS.items())} ELSE {tb._q(jb.FAILURE_OTHER)} END AS reason FROM c""",
)
def retry_classes(spark, sf):
    code, http = F.col("code"), F.col("http")
    return _calls(spark, sf).select(
        "event_id", jb.retryable_call(code, http).alias("retryable"), jb.failure_reason(code, http).alias("reason")
    )


@query(
    "backoff_plan",
    f"""WITH {_CALL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS attempt FROM c)
    SELECT event_id, attempt, {_RETRY_SQL} AND attempt < 3 AS will_retry, CASE WHEN {_RETRY_SQL} AND attempt < 3 THEN attempt * 1000 END AS wait_ms,
      attempt >= 3 AS final_attempt FROM n""",
)
def backoff_plan(spark, sf):
    calls = _calls(spark, sf).select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "ts",
        "event_id",
        jb.retryable_call(F.col("code"), F.col("http")).alias("retryable"),
    )
    return jb.backoff_plan(calls, ["user_id", "day"], ["ts", "event_id"], 1000).select(
        "event_id", "attempt", "will_retry", "wait_ms", "final_attempt"
    )


_USAGE = """u AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value) AS BIGINT) END AS pt,
   CAST(floor(value / 2) AS BIGINT) AS ct, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS stage, event_id % 6 AS idx FROM events)"""


def _model_calls(spark, sf):
    tokens = F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("bigint"))
    completion = F.floor(F.col("value") / 2).cast("bigint")
    return tb.events(spark, sf).select(
        F.col("user_id").alias("report_id"),
        F.col("event_id").alias("call_id"),
        F.when(F.col("event_type") == "purchase", "global_synthesis").otherwise("chunk_analysis").alias("stage"),
        (F.col("event_id") % 6).alias("idx"),
        (F.col("event_type") != "error").alias("success"),
        tokens.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (tokens + completion).alias("total_tokens"),
        F.col("ts").alias("requested_at"),
    )


@query(
    "usage_rollup",
    f"""WITH {_USAGE} SELECT user_id AS report_id, count(*) AS request_count, count_if(ok) AS success_count, count_if(NOT ok) AS failure_count,
      CAST(sum(coalesce(pt, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens,
      CAST(sum(coalesce(pt + ct, 0)) AS BIGINT) AS total_tokens FROM u GROUP BY 1""",
)
def usage_rollup(spark, sf):
    return jb.usage_rollup(_model_calls(spark, sf))


@query(
    "ordered_calls",
    f"""WITH {_USAGE} SELECT user_id AS report_id, event_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY stage, idx, ts, event_id) AS place FROM u""",
)
def ordered_calls(spark, sf):
    return jb.ordered_calls(_model_calls(spark, sf)).select("report_id", "call_id", "place")
