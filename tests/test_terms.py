"""Terms counted in arrays, against plain loops."""

from collections import Counter

import pyarrow as pa
import pytest

from engram import lexicons as lx
from engram.operators import corpus as cp
from engram.operators import terms

ROWS = [
    ("a", ["alpha", "beta", "gamma", "alpha", "beta", "gamma"]),
    ("a", ["alpha", "beta", "delta"]),
    ("b", ["alpha", "beta", "gamma"]),
    (None, ["alpha", "beta", "gamma"]),
    (None, ["beta", "alpha"]),
    ("a", []),
    ("b", None),
    ("c", ["语言", "模型", "语言"]),
    ("c", ["xyz"]),
    ("c", ["end", "user"]),
]


def plain(rows):
    counts = Counter()
    for owner, words in rows:
        words = words or []
        found = {" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)}
        for name in set(words):
            counts[owner, "token", name] += 1
        for name in found:
            if len(name) >= 7 and name not in lx.THEME_DENYLIST:
                counts[owner, "phrase", name] += 1
    return {(*key, n) for key, n in counts.items()}


@pytest.mark.parametrize("least", [1, 2])
def test_counts(spark, least):
    df = spark.createDataFrame(ROWS * 3 + ROWS[:1], "owner_id string, words array<string>").repartition(3)
    got = cp.document_frequency(df, least=least)
    assert got.columns == ["owner_id", "kind", "name", "n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {r for r in plain(ROWS * 3 + ROWS[:1]) if r[3] >= least}


def test_terms_do_not_become_rows_before_they_meet(spark):
    df = spark.createDataFrame(ROWS, "owner_id string, words array<string>")
    plan = cp.document_frequency(df)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("size", [1, 4, 100])
def test_bounds_cut_nothing(monkeypatch, size):
    monkeypatch.setattr(terms, "WORDS", size)
    monkeypatch.setattr(terms, "TERMS", size)
    monkeypatch.setattr(terms, "BUCKET_BITS", 2)
    batch = pa.RecordBatch.from_pydict(
        {"k": pa.array([r[0] for r in ROWS]), "words": pa.array([r[1] for r in ROWS], pa.list_(pa.string()))}
    )
    sent = pa.Table.from_batches(terms._sent(["k"])(iter([batch, batch]))).sort_by("bucket")
    for rows in (1, 3, 1000):
        got = pa.Table.from_batches(terms._summed(["k"], 1)(iter(sent.to_batches(max_chunksize=rows)))).to_pylist()
        assert len(got) == len(plain(ROWS))
        assert {tuple(r.values()) for r in got} == plain(ROWS * 2)


@pytest.mark.parametrize("size", [1, 4, 100])
def test_terms_of_chunks_are_counted_in_arrays(spark, monkeypatch, size):
    monkeypatch.setattr(terms, "WORDS", size)
    df = spark.createDataFrame(ROWS * 3 + ROWS[:1], "owner_id string, words array<string>")
    got = cp.chunk_frequency(df, ["owner_id"], 2)
    assert got.columns == ["owner_id", "kind", "name", "n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {r for r in plain(ROWS * 3 + ROWS[:1]) if r[3] >= 2}
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_owner_themes_are_counted_once(spark):
    df = spark.createDataFrame(ROWS * 3, "owner_id string, words array<string>")
    own = cp.themes(cp.document_frequency(df, least=cp.THEME_MEMORIES), limit=3)
    boosts = spark.createDataFrame([("a", "delta", 5), ("a", "zeta", 2)], "owner_id string, name string, references long")
    got = cp.boosted_themes(own, boosts)
    assert ("a", "zeta") in {(r["owner_id"], r["name"]) for r in got.collect()}
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
