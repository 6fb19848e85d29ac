"""Streams in several micro-batches give the batch result; a replay changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators.rules import Rule
from engram.streaming import jobs as st



@pytest.fixture(autouse=True)
def few_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


RULES = [Rule("plan", "keyword", "plan", 5), Rule("task", "keyword", "todo", 5)]


def write_files(df, path, n):
    for i in range(n):
        df.filter(F.col("o") % n == i).coalesce(1).write.mode("append").parquet(path)


def state_rows(query):
    """Keys in state after each micro-batch, by operator."""
    return [[o.numRowsTotal for o in p.stateOperators] for p in query.recentProgress]


def first_seen_loop(rows, ttl=24 * 3600):
    """Positions of the rows that are new, when a job that writes nothing for longer than ttl forgets all its keys."""
    seen, last, out = {}, {}, []
    for job, o, id_, hash_, t in rows:
        if job in last and t - last[job] > ttl:
            seen.pop(job)
        ids, hashes = seen.setdefault(job, (set(), set()))
        if id_ not in ids and hash_ not in hashes:
            out.append(o)
        ids.add(id_)
        hashes.add(hash_)
        last[job] = t
    return out


def dedupe_rows(spark, path, out, rows, deliveries, **options):
    """Run the stream over ``deliveries`` of the rows (job, o, id, h, t), one file for each."""
    df = spark.createDataFrame(rows, "job string, o int, id string, h string, t long").withColumn("ts", F.timestamp_seconds("t"))
    queries = []
    for part in deliveries:
        df.filter(F.col("o").isin(part)).coalesce(1).write.mode("append").parquet(path)
        stream = st.files(spark, path, df.schema, per_trigger=1)
        queries.append(st.dedupe_stream(stream, out, ["job"], "id", "h", ["o"], time=F.col("ts"), **options))
        queries[-1].awaitTermination()
    return sorted(r["o"] for r in spark.read.parquet(f"{out}/rows").collect()), queries


def test_dedupe_over_many_files(spark, tmp_path):
    rnd = random.Random(2)
    rows, t = [], 1704067200
    for i in range(120):
        t += rnd.choice([0, 60, 7200, 50000])
        rows.append((rnd.choice(["j", "k", None]), i, rnd.choice([None, *[f"i{k}" for k in range(14)]]), f"h{rnd.randrange(14)}", t))
    want = first_seen_loop(rows)
    assert want != sorted(first_seen_loop(rows, 10**9))  # some keys expire
    deliveries = [range(0, 50), range(50, 90), range(90, 120)]
    got, _ = dedupe_rows(spark, str(tmp_path / "in"), str(tmp_path / "out"), rows, [list(d) for d in deliveries], buckets=2)
    assert got == want


def test_keys_of_an_active_job_outlive_their_time(spark, tmp_path):
    """Written at 0 h, its job writes at 20 h: at 30 h the key is still known, 25 h after that it is not."""
    hour = 3600
    rows = [("j", 0, "a", "x", 0), ("j", 1, "b", "y", 20 * hour), ("j", 2, "a", "x", 30 * hour), ("j", 3, "a", "x", 55 * hour), ("k", 4, "c", "z", 90 * hour), ("k", 5, "d", "w", 91 * hour)]
    got, queries = dedupe_rows(spark, str(tmp_path / "in"), str(tmp_path / "out"), rows, [[0], [1], [2], [3], [4], [5]], buckets=2)
    assert got == [0, 1, 3, 4, 5]
    # the keys of the silent job are gone for good, only k's two ids, two hashes and its timer are held
    assert state_rows(queries[-1])[-1][0] == 4
    updated = [max(o.numRowsUpdated for o in p.stateOperators) for q in queries for p in q.recentProgress]
    assert max(updated) <= 2  # a micro-batch writes what it brings


def test_merge_of_batches_in_pieces(spark, tmp_path):
    rows = [("j", b, f"{b}-{i}", "plan it" if i % 2 else "todo now", 2 * i + b) for b in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "job_id string, batch_index bigint, id string, content string, o int")
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    for delivery in range(2):  # each batch in several files, one file for a micro-batch; then everything again
        write_files(df, source, 3)
        stream = st.files(spark, source, df.schema, per_trigger=1)
        st.merge_stream(stream, out, RULES).awaitTermination()
        totals = {(r["kind"], r["key"]): r["count"] for r in st.job_totals(spark, out).collect()}
        assert totals["category", "plan"] == 4 and totals["category", "task"] == 4
        progress = st.job_progress(spark, out).first()
        assert (progress["completed_batches"], progress["processed_memories"]) == (2, 8)
    # a micro-batch written again, as after a failure
    before = sorted(map(tuple, st.job_totals(spark, out).collect()))
    epochs = [r["epoch"] for r in spark.read.parquet(f"{out}/batches").filter("batch_index = 2").select("epoch").distinct().collect()]
    assert len(epochs) > 1
    st.merge_batch(df.limit(0), max(epochs) + 50, out, RULES)
    assert sorted(map(tuple, st.job_totals(spark, out).collect())) == before


def test_merge_state_and_files_stay_bounded(spark, tmp_path):
    """Six days, one delivery a day: state holds a day or two, counts are folded, a delivery of yesterday's rows adds nothing."""
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    day = 86400
    schema = "job_id string, batch_index bigint, id string, content string, t long"
    held = []
    for d in range(6):
        rows = [("j", d, f"{d}-{i}", "plan it", 1704067200 + d * day + i) for i in range(5)]
        if d:  # late: the day before again
            rows += [("j", d - 1, f"{d - 1}-{i}", "plan it", 1704067200 + d * day + i) for i in range(5)]
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = st.files(spark, source, df.schema, per_trigger=1)
        query = st.merge_stream(stream, out, RULES, time=F.col("ts"), keep="10 hours", fold_every=2)
        query.awaitTermination()
        held.append(state_rows(query)[-1][0])
        totals = {(r["kind"], r["key"]): r["count"] for r in st.job_totals(spark, out).collect()}
        assert totals["category", "plan"] == 5 * (d + 1)
        assert st.job_progress(spark, out).first()["processed_memories"] == 5 * (d + 1)
    assert max(held[3:]) <= max(held[:3])
    assert len(st.folded.numbered(spark, f"{out}/counts", "epoch")) <= 5
    assert len(st.folded.numbered(spark, f"{out}/counts_folded", "upto")) <= 2


def test_rate_verdicts_continue(spark, tmp_path):
    from engram.operators import limits as lm

    rnd = random.Random(5)
    rows = [(f"o{rnd.randrange(3)}", i, 1704067200 + 7 * i, 1 + i % 3, 8, 90) for i in range(150)]
    df = spark.createDataFrame(rows, "owner_id string, request_id int, t long, cost long, rpm_limit int, daily_limit int")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = str(tmp_path / "out")
    for epoch in (0, 1, 1, 2):  # the second one twice, as after a failure
        st.verdict_batch(df.filter((F.col("request_id") / 50).cast("int") == epoch), epoch, out)
    columns = ["owner_id", "request_id", "minute_count", "day_count", "rejected"]
    got = sorted(map(tuple, spark.read.parquet(f"{out}/rows").select(columns).collect()))
    assert got == sorted(map(tuple, lm.rate_windows(df).select(columns).collect()))
    assert {r[-1] for r in got} == {True, False}


def test_event_versions_continue(spark, tmp_path):
    schema = "job_id string, event_id int, ts int, type string"
    out = str(tmp_path / "log")
    first = [("j", 1, 1, "job_created"), ("j", 2, 2, "batch_completed"), ("j", 3, 3, "batch_started")]
    st.log_batch(spark.createDataFrame(first, schema), 0, out)
    st.log_batch(spark.createDataFrame([("j", 4, 4, "batch_failed"), ("k", 5, 5, "batch_completed")], schema), 1, out)
    got = {r["event_id"]: r["version"] for r in spark.read.parquet(f"{out}/events").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 1}
    st.log_batch(spark.createDataFrame([("j", 4, 4, "batch_failed"), ("k", 5, 5, "batch_completed")], schema), 1, out)  # a replay
    st.log_batch(spark.createDataFrame([("j", 6, 6, "batch_failed")], schema), 2, out)
    got = {r["event_id"]: r["version"] for r in spark.read.parquet(f"{out}/events").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 1, 6: 3}


def test_stale_reports_fail_once(spark, tmp_path):
    rnd = random.Random(7)
    t0, rows = 1704067200, []
    for k in range(150):
        at = t0 + k * 240
        rows.append((rnd.randrange(12), rnd.choice(["queued", "queued", "running", "running", "success", "fail"]), at))
    schema = "report_id int, render_status string, t long"
    df = spark.createDataFrame(rows, schema).select(
        "report_id", "render_status", F.timestamp_seconds("t").alias("generated_at"), F.timestamp_seconds("t").alias("started_at"), F.timestamp_seconds("t").alias("ts")
    )
    out = str(tmp_path / "out")
    for part in range(3):
        low, high = t0 + part * 50 * 240, t0 + (part + 1) * 50 * 240
        df.filter((F.unix_timestamp("ts") >= low) & (F.unix_timestamp("ts") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        st.expiry_stream(st.files(spark, str(tmp_path / "in"), df.schema, per_trigger=1), out).awaitTermination()
    state, want = {}, {}
    end = rows[-1][2]
    for report, status, at in [*rows, *[(r, None, end) for r in range(12)]]:
        deadline = state.get(report)
        if deadline == "done":
            continue
        if deadline is not None and deadline < at:
            want[report], state[report] = deadline, "done"
        elif status is not None:
            state[report] = {"queued": at + 600, "running": at + 3600}.get(status, "done")
    got = [(r["report_id"], int(r["completed_at"].timestamp()), r["render_status"], r["fail_code"]) for r in spark.read.parquet(f"{out}/rows").collect()]
    assert want and sorted(got) == sorted((r, t, "fail", st.lx.EXPIRED_CODE) for r, t in want.items())


def ordered_loop(deliveries, limit):
    """[(report, idx, place, late)] of deliveries [(time, [(report, idx)])], flushed at the first delivery after the limit."""
    out, state = [], {}
    last = None
    for now, rows in deliveries:
        for report in {r for r, _ in rows}:
            s = state.setdefault(report, {"next": 1, "place": 0, "wait": {}, "gone": set()})
            late = sorted(i for r, i in rows if r == report and i < s["next"])
            for i in late:
                if i in s["gone"]:
                    s["gone"].remove(i)
                    s["place"] += 1
                    out.append((report, i, s["place"], True))
            for r, i in rows:
                if r == report and i >= s["next"]:
                    s["wait"].setdefault(i, now)
            while s["next"] in s["wait"]:
                s["wait"].pop(s["next"])
                s["place"] += 1
                out.append((report, s["next"], s["place"], False))
                s["next"] += 1
        # timers that are due by the newest arrival, in the micro-batch after it
        for report, s in state.items():
            if s["wait"] and min(s["wait"].values()) + limit < now:
                for i in sorted(s["wait"]):
                    s["gone"] |= set(range(s["next"], i))
                    s["next"], s["place"] = i + 1, s["place"] + 1
                    out.append((report, i, s["place"], False))
                s["wait"] = {}
        last = now
    assert last is not None
    return out


def test_results_in_index_order(spark, tmp_path):
    rnd = random.Random(11)
    t0, out, source = 1704067200, str(tmp_path / "out"), str(tmp_path / "in")
    ids = [(r, i) for r in range(3) for i in range(1, 16) if (r, i) not in ((0, 4), (1, 1))]
    rnd.shuffle(ids)
    parts = [ids[k::4] for k in range(4)]
    parts[3] = parts[3] + parts[0][:3]  # some come again
    parts += [[(0, 4)], [(1, 1), (2, 15)], [(0, 16)]]
    deliveries = [(t0 + k * 400, p) for k, p in enumerate(parts)]
    schema = "report_id int, idx int, text string, t long"
    for now, part in deliveries:
        df = spark.createDataFrame([(r, i, f"{r}/{i}", now) for r, i in part], schema).withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = st.files(spark, source, df.schema, per_trigger=1)
        st.ordered_stream(stream, out, time=F.col("ts"), limit_minutes=15).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert all(r["row"]["text"] == f"{r['report']}/{r['idx']}" for r in rows)
    got = sorted((r["report"], r["place"], r["idx"], r["late"]) for r in rows)
    assert got == sorted((r, p, i, late) for r, i, p, late in ordered_loop(deliveries, 15 * 60))
    assert any(r[3] for r in got)
    for report in range(3):
        in_time = [i for r, _, i, late in got if r == report and not late]
        assert in_time == sorted(in_time)


def test_merge_stream_sends_no_text_to_its_state(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("j", 0, str(i % 3), f"my debug text {i % 3}") for i in range(9)], "job_id string, batch_index long, id string, content string")
    df.write.parquet(f"{tmp_path}/in")
    columns, whole = [], st.count_batch

    def seen(batch, *args):
        columns.append(set(batch.columns))
        whole(batch, *args)

    monkeypatch.setattr(st, "count_batch", seen)
    st.merge_stream(st.files(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", RULES).awaitTermination()
    assert columns and not any("content" in c for c in columns)
    totals = {(r.kind, r.key): r["count"] for r in st.job_totals(spark, f"{tmp_path}/out").filter("count > 0").collect()}
    assert totals["tag", "debug"] == 3
