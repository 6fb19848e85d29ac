"""Distributed order work equals a plain loop, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.operators import dedupe as dd
from engram.operators import limits as lm
from engram.operators import periods as pd
from engram.operators.ranking import running


def skewed(n=600, seed=1):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}", i, rnd.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("limit", [10_000, 5])
def test_running_matches_loop(spark, limit):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)
    got = running(
        df, ["k"], ["i"], number="n", sums={"s": "v"}, previous={"p": "v"}, max_group_rows=limit
    ).collect()
    state, want = {}, {}
    for k, i, v in rows:
        n, s, p = state.get(k, (0, 0, None))
        want[i] = (k, n + 1, s + v, p)
        state[k] = (n + 1, s + v, v)
    assert {r["i"]: (r["k"], r["n"], r["s"], r["p"]) for r in got} == want


def test_first_seen_records_rejected_rows(spark):
    rows = [("j", 1, "a", "h1"), ("j", 2, "a", "h2"), ("j", 3, "b", "h2"), ("j", 4, "c", "h3"), ("x", 5, "a", "h1")]
    df = spark.createDataFrame(rows, "job string, o int, id string, h string")
    kept = dd.first_seen(df, ["job"], "id", "h", ["o"]).collect()
    assert sorted(r["o"] for r in kept) == [1, 4, 5]


def test_first_seen_matches_loop(spark):
    rnd = random.Random(3)
    rows = [(f"j{rnd.randrange(2)}", i, rnd.randrange(60), rnd.choice([0, 0, rnd.randrange(80)])) for i in range(400)]
    df = spark.createDataFrame(rows, "job string, o int, id int, h int")
    ids, hashes, want = set(), set(), []
    for job, o, id_, h in rows:
        if (job, id_) not in ids and (job, h) not in hashes:
            want.append(o)
        ids.add((job, id_))
        hashes.add((job, h))
    assert sorted(r["o"] for r in dd.first_seen(df, ["job"], "id", "h", ["o"]).collect()) == want


def head_tail(text, limit):
    if len(text) <= limit:
        return text
    head = limit * 6 // 10
    return text[:head] + lx.TRUNCATION_MARK + text[-(limit - head) :]


@pytest.mark.parametrize("limit", [10_000, 3])
def test_content_budget_matches_loop(spark, limit):
    rnd = random.Random(5)
    rows = [(f"o{rnd.randrange(3)}", f"m{i:03}", i, "  " if rnd.random() < 0.1 else "x" * rnd.randrange(1, 90)) for i in range(120)]
    df = spark.createDataFrame(rows, "owner_id string, id string, t int, content string").withColumn(
        "created_at", F.timestamp_seconds("t")
    )
    got = pd.content_budget(df, cap=50, budget=400, max_group_rows=limit).collect()
    want, left = {}, {}
    for owner, id_, _, content in rows:
        text, rest = content.strip(), left.get(owner, 400)
        if rest <= 0 or not text:
            continue
        cut = head_tail(text, min(50, rest))
        want[id_] = cut
        left[owner] = rest - len(cut)
    assert {r["id"]: r["text"] for r in got} == want


@pytest.mark.parametrize("limit", [10_000, 3])
def test_daily_slots_match_loop(spark, limit):
    rnd = random.Random(7)
    rows = [
        (f"o{rnd.randrange(4)}", i, f"d{rnd.randrange(3)}", rnd.choice(["COMPLETED", "COMPLETED", "ANALYZING", "FAILED"]),
         rnd.choice([10, 10, 30000]), rnd.random() < 0.2)
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "owner_id string, report_id int, day_key string, status string, memory_count int, allow_listed boolean"
    ).withColumn("requested_at", F.timestamp_seconds("report_id"))
    got = {r["report_id"]: r["code"] for r in lm.daily_slots(df, max_group_rows=limit).collect()}
    accepted, want = {}, {}
    for owner, i, day, status, count, allowed in rows:
        runs = accepted.setdefault((owner, day), [])
        if any(s in lx.RUNNING_REPORT_STATUSES for s in runs):
            want[i] = "DEEP_ANALYSIS_ALREADY_RUNNING"
        elif not allowed and len(runs) >= 3:
            want[i] = "DEEP_ANALYSIS_DAILY_LIMIT"
        elif count > 20000:
            want[i] = "DEEP_ANALYSIS_TOO_MANY_MEMORIES"
        else:
            want[i] = None
            runs.append(status)
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 4])
def test_rate_windows_match_loop(spark, limit):
    rnd = random.Random(9)
    t, rows = 0, []
    for i in range(300):
        t += rnd.randrange(40)
        rows.append((rnd.choice(["hot", "hot", "a", "b"]), i, t, rnd.choice([1, 1, 2, 3]), 6, 80))
    df = spark.createDataFrame(
        rows, "owner_id string, request_id int, t int, cost bigint, rpm_limit int, daily_limit int"
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = {r["request_id"]: (r["minute_count"], r["day_count"], r["rejected"]) for r in lm.rate_windows(df, limit).collect()}
    minutes, days, want = {}, {}, {}
    for owner, i, at, cost, rpm, daily in rows:
        minutes[owner, at // 60] = minutes.get((owner, at // 60), 0) + cost
        days[owner, at // 86400] = days.get((owner, at // 86400), 0) + cost
        m, d = minutes[owner, at // 60], days[owner, at // 86400]
        want[i] = (m, d, m > rpm or d > daily)
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 3])
def test_range_counts_match_pairs(spark, limit):
    rnd = random.Random(11)
    memories = [(rnd.choice(["a", "a", "b"]), rnd.randrange(200)) for _ in range(150)]
    ranges = []
    for i in range(40):
        start = rnd.randrange(200)
        ranges.append((rnd.choice(["a", "b", "c"]), i, start, start + rnd.randrange(60)))
    m = spark.createDataFrame(memories, "owner_id string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    r = spark.createDataFrame(ranges, "owner_id string, rid int, s int, e int").select(
        "owner_id", "rid", F.timestamp_seconds("s").alias("day_start"), F.timestamp_seconds("e").alias("day_end")
    )
    got = {x["rid"]: x["count"] for x in pd.count_in_ranges(r, m, ["rid"], limit).collect()}
    assert got == {i: sum(o == owner and s <= t <= e for o, t in memories) for owner, i, s, e in ranges}


def test_chunks_are_exact_with_a_large_owner(spark):
    rows = [("hot" if i % 3 else "small", f"{i:04}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "owner_id string, id string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    plain = {r["id"]: r["chunk"] for r in dd.chunk_of(df, 18).collect()}
    assert plain == {r["id"]: r["chunk"] for r in dd.chunk_of(df, 18, max_group_rows=10).collect()}
    assert max(plain.values()) == 11
