"""State tables by part: what an upsert reads and rewrites, stops on the way, audit transactions, day summaries."""

import os
import random

import pytest
from pyspark.sql import functions as F

from engram.operators import periods as pd
from engram.sources import folders, keyed
from engram.streaming import jobs as st


@pytest.fixture(autouse=True)
def few_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_only_the_parts_of_its_changes(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "key string, version int, v int"
    rnd = random.Random(3)
    want, part = {}, keyed.bucket(["key"], 16)
    for k in range(4):
        rows = [(rnd.choice([None, *[f"k{i}" for i in range(60)]]), rnd.randrange(9), k) for _ in range(80 if k == 0 else 3)]
        rows = list({r[0]: r for r in rows}.values())
        for key, version, v in rows:
            if key not in want or version >= want[key][0]:
                want[key] = (version, v)
        before = files_of(path)
        changes = spark.createDataFrame(rows, schema)
        parts = keyed.upsert(spark, path, changes, ["key"], ["version"], f"t{k}", part)
        assert parts == sorted({r["p"] for r in changes.select(part.alias("p")).collect()})
        after = files_of(path)
        kept = {f: t for f, t in before.items() if not any(f"/part={p}/" in f for p in parts)}
        assert all(after[f] == t for f, t in kept.items())
        written = [f for f in after if f not in kept]
        assert {f.split("/part=")[1].split("/")[0] for f in written} == set(parts)
        if k:
            assert len(written) <= 3 and len(kept) >= 12
    got = {r["key"]: (r["version"], r["v"]) for r in keyed.read(spark, path, schema).collect()}
    assert got == want
    read = keyed.read(spark, path, schema, parts).inputFiles()
    assert len(read) == len(parts)


def test_a_stopped_upsert_is_finished_by_its_token(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "key int, version int"
    first = spark.createDataFrame([(k, 1) for k in range(20)], schema)
    keyed.upsert(spark, path, first, ["key"], ["version"], "a", keyed.bucket(["key"], 4))
    moved, move = [], folders.move

    def stop(spark_, source, target):
        if moved:
            raise OSError("stopped")
        moved.append(target)
        move(spark_, source, target)

    second = spark.createDataFrame([(k, 2) for k in range(40)], schema)
    monkeypatch.setattr(folders, "move", stop)
    with pytest.raises(OSError, match="stopped"):
        keyed.upsert(spark, path, second, ["key"], ["version"], "b", keyed.bucket(["key"], 4))
    monkeypatch.setattr(folders, "move", move)
    for _ in range(2):
        keyed.upsert(spark, path, second, ["key"], ["version"], "b", keyed.bucket(["key"], 4))
        assert sorted(map(tuple, keyed.read(spark, path, schema).collect())) == [(k, 2) for k in range(40)]


def requests(spark, ids):
    return spark.createDataFrame([(i, f"o{i % 3}") for i in ids], "request_id int, owner_id string").withColumns(
        {
            "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("request_id") * 7200), "route": F.lit("/r"), "job_id": F.lit("j"),
            "batch_index": F.lit(0), "memory_count": F.lit(3), "status_code": F.lit(200), "latency_ms": F.lit(1),
        }
    )


def test_audit_counts_a_transaction_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    assert keyed.append_audit(requests(spark, range(20)), path, "a")
    assert keyed.append_audit(requests(spark, range(20)), path, "a")
    # rows of a transaction that stopped before its manifest entry do not count, until it is tried again
    keyed.append_audit(requests(spark, range(20, 30)), path, "b")
    folders.remove(spark, f"{path}/manifest/transaction=b")
    assert sorted(r["request_id"] for r in keyed.read_audit(spark, path).collect()) == list(range(20))
    assert keyed.append_audit(requests(spark, range(20, 30)), path, "b")
    rows = keyed.read_audit(spark, path).collect()
    assert sorted(r["request_id"] for r in rows) == list(range(30))
    assert {r["batch_index"] for r in rows} == {None} and {r["transaction"] for r in rows} == {"a", "b"}
    assert keyed.append_audit(requests(spark, [1]).drop("route"), path, "c") is False


def test_only_changed_days_are_computed_again(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"o{rnd.randrange(4)}", k, 1704067200 + rnd.randrange(10) * 86400 + k, "x" * rnd.randrange(30)) for k in range(200)]
    base = spark.createDataFrame(rows, "owner_id string, id int, t long, content string").withColumn("created_at", F.timestamp_seconds("t"))
    base = base.withColumns({"correctness": F.lit(None).cast("string"), "edit_version": F.lit(None).cast("int")})
    path = str(tmp_path / "days")
    st.recompute_batch(base, 0, path, lambda: base)
    before, seen = files_of(path), []

    def summarise(messages):
        seen.append({(r["owner_id"], r["day"]) for r in messages.select("owner_id", "day").distinct().collect()})
        return pd.day_overview(messages)

    hit = F.col("id") % 41 == 0
    after = base.withColumns({"correctness": F.when(hit, "incorrect"), "edit_version": F.when(hit, 2)}).filter("id <> 82")
    changed = base.filter(hit)
    parts = st.recompute_batch(changed, 1, path, lambda: after, summarise)
    days = {(r["owner_id"], r["day"]) for r in pd.invalidated_days(changed).collect()}
    assert seen[0] <= days and 0 < len(days) <= 5
    now = files_of(path)
    assert all(now[f] == t for f, t in before.items() if not any(f"/part={p}/" in f for p in parts))
    schema = "owner_id string, day string, messages long, correct long, incorrect long, edited long, characters long, computed long"
    got = {(r["owner_id"], r["day"]): tuple(r)[2:7] for r in keyed.read(spark, path, schema).collect() if r["messages"]}
    full = pd.day_overview(after.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))).collect()
    assert got == {(r["owner_id"], r["day"]): tuple(r)[2:7] for r in full}


def test_pages_read_no_earlier_files(spark, tmp_path):
    from engram.sources import memories as src

    rnd = random.Random(12)
    rows = [(k, 1704067200 + rnd.randrange(120)) for k in range(600)]  # many ties
    df = spark.createDataFrame(rows, "id int, t long").withColumn("created_at", F.timestamp_seconds("t"))
    path = str(tmp_path / "listing")
    src.write_listing(df, path, 12)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got, cursor, read = [], None, []
    while True:
        page = src.page_after(spark, path, cursor, 70)
        found = page.collect()
        if not found:
            break
        read.append({int(f.split("/part=")[1].split("/")[0]) for f in page.inputFiles()})
        got += [(r["id"], r["t"]) for r in found]
        cursor = (found[-1]["created_at"], found[-1]["id"])
    assert got == want
    assert all(min(b) >= max(a) - 1 and len(b) <= 4 for a, b in zip(read, read[1:]))
    assert src.page_after(spark, path, cursor, 70).collect() == []
