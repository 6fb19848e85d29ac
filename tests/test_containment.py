"""Which texts hold which patterns, against plain search."""

import random

import pytest

from engram.operators import containment as ct
from engram.operators import periods as pd


@pytest.mark.parametrize("scope", [[], ["day"]])
def test_contained(spark, monkeypatch, scope):
    rnd = random.Random(6)
    monkeypatch.setattr(ct, "PIECE", 32)
    alphabet = "ab c😀你é"
    texts = [("o", k, f"d{k % 3}", "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200)))) for k in range(60)]
    texts += [(None, 90, "d0", None), ("o", 91, "d1", ""), ("o", 92, "d1", texts[4][3])]
    long = texts[7][3] * 3
    texts.append(("p", 93, "d2", "x" + long + "y"))
    patterns = [(f"d{rnd.randrange(3)}", t[3][i : i + n]) for t in texts if t[3] for n in (1, 2, 3, 4, 5, 6, 7, 20) for i in [rnd.randrange(len(t[3]))]]
    patterns += [("d2", long), ("d0", ""), ("d0", None), ("d1", "not there at all"), *patterns[:5]]
    left = spark.createDataFrame(texts, "owner string, id int, day string, text string")
    right = spark.createDataFrame(patterns, "day string, pattern string")
    got = ct.contained(left, right if scope else right.select("pattern"), ["owner", "id"], scope).collect()
    want = {(*([d] if scope else []), o, i, p) for o, i, d, t in texts if t for day, p in patterns if p and p in t and (not scope or day == d)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nothing_to_find(spark):
    texts = spark.createDataFrame([("o", "some text")], "id string, text string")
    assert ct.contained(texts, spark.createDataFrame([], "pattern string"), ["id"]).collect() == []
    assert ct.contained(texts.limit(0), spark.createDataFrame([("some",)], "pattern string"), ["id"]).collect() == []


def test_quotes_find_the_first_text_of_their_period(spark, monkeypatch):
    """In lists of any size, in both directions, and without a text in any row that is exchanged by quote."""
    monkeypatch.setattr(pd, "QUOTES_AT_ONCE", 3)
    rnd = random.Random(8)
    words = "alpha beta gamma delta eps".split()
    memories = {(f"o{o}", f"d{d}"): [(f"m{o}{d}{k}", " ".join(rnd.choices(words, k=rnd.randrange(1, 7)))) for k in range(6)] for o in range(2) for d in range(2)}
    evidence = []
    for k in range(80):
        owner, day = rnd.choice([*memories, ("o0", "d9")])
        raw = rnd.choice(["nope", None, f"m{owner[1]}{day[1]}{rnd.randrange(8)}"])
        evidence.append((owner, day, k, raw, " ".join(rnd.choices(words, k=rnd.randrange(0, 9)))))
    periods = spark.createDataFrame([(o, d, m) for (o, d), m in memories.items()], "owner_id string, day string, memories array<struct<id:string,text:string>>")
    frame = spark.createDataFrame(evidence, "owner_id string, day string, k int, raw_id string, quote string")
    want = set()
    for owner, day, k, raw, quote in evidence:
        known = memories.get((owner, day), [])
        found = raw if raw in [i for i, _ in known] else next((i for i, t in known if quote in t or t in quote), None)
        if quote and found:
            want.add((k, found))
    assert {(r["k"], r["evidence_id"]) for r in pd.repair_evidence(frame, periods).collect()} == want


def test_runs_of_texts_do_not_become_rows(spark):
    """Only runs that pass the bitmap leave the task that reads a text, and no expression runs for each character."""
    texts = spark.createDataFrame([("a", "some text of some words"), ("b", None), ("c", "other")], "id string, text string")
    anchors = ct.anchored(spark.createDataFrame([("some",), ("other",)], "pattern string"), texts, [])
    found = ct.places(texts, anchors, [], ["id"])
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    assert {("a", "some"), ("c", "othe")} == {(r["id"], r["gram"][:4]) for r in found.collect()}
