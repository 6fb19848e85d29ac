"""Chunk relations made elsewhere inside the report, and a user's own annotation."""

from pyspark.sql import functions as F

from engram.operators import corpus as cp
from engram.operators import dedupe as dd

MEMORIES = [
    ("o", "m1", "Prefer structured memory capture and work with Alice Johnson on the dashboard roadmap.", 1),
    ("o", "m2", "Prefer structured memory capture and work with Alice Johnson on the dashboard roadmap.", 2),
    ("o", "m3", "Every morning Bosn reviews traffic dashboards for the Platform Team.", 3),
    (None, "m4", "A memory of nobody in particular, long enough to be kept.", 4),
    (None, "m5", "A memory of nobody  in particular, long enough to be KEPT.", 5),
]


def memories(spark):
    df = spark.createDataFrame(MEMORIES, "owner_id string, id string, content string, t long")
    return df.withColumn("created_at", F.timestamp_seconds("t")).withColumn("tags", F.array(F.lit("roadmap"))).drop("t")


def test_distinct_texts(spark):
    got = dd.distinct_texts(memories(spark)).collect()
    assert sorted(r["id"] for r in got) == ["m1", "m3", "m4"]
    got = dd.chunked_texts(memories(spark), 1).select("id", "chunk").collect()
    assert sorted(map(tuple, got)) == [("m1", 0), ("m3", 1), ("m4", 0)]


def test_report_takes_chunk_relations(spark):
    outside = spark.createDataFrame(
        [("o", 0, "user", "mentors", "Bosn", 0.8, "said so", ["m3"])],
        "owner_id string, pos int, source string, relation string, target string, confidence double, excerpt string, evidence array<string>",
    )
    plain = {r["owner_id"]: r for r in cp.corpus_report(memories(spark)).collect()}
    with_them = {r["owner_id"]: r for r in cp.corpus_report(memories(spark), chunk_relations=outside).collect()}
    own = [r["relation"] for r in plain["o"]["relations"]]
    assert [r["relation"] for r in with_them["o"]["relations"]] == [*own, "mentors"]
    last = with_them["o"]["relations"][-1]
    assert (last["target"], last["memory_id"], last["confidence"]) == ("Bosn", "m3", 0.8)


def test_annotation_of_ones_own(spark):
    def lengths(batches):
        for batch in batches:
            yield batch.assign(n=batch["content"].str.len())[["id", "n"]]

    chunks = dd.chunked_texts(memories(spark))
    got = {r["id"]: r["n"] for r in cp.annotate(chunks, lengths, "id string, n long").collect()}
    assert got == {i: len(c) for _, i, c, _ in MEMORIES if i in ("m1", "m3", "m4")}
    default = {r["owner_id"]: r for r in cp.annotate(chunks).collect()}
    assert "Alice Johnson" in default["o"]["people"] and default["o"]["summary"]
