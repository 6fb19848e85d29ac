"""Chinese words by dictionary against all ways to cut, and everything else unchanged."""

import random

import pytest
from pyspark.sql import functions as F

from engram.functions import tokens as tk
from engram.operators import classify as cl
from engram.operators.rules import Rule


def cuts(text, dictionary, unknown):
    """The words of least cost, sums from the left; at equal cost the longer last word, then the one before it."""
    best = [(0.0, [])]
    for i in range(1, len(text) + 1):
        found = []
        for n in range(1, i + 1):
            word = text[i - n : i]
            cost = dictionary.get(word, unknown if n == 1 else None)
            if cost is not None:
                found.append((best[i - n][0] + cost, -n, best[i - n][1] + [word]))
        cost, _, words = min(found, key=lambda f: f[:2])
        best.append((cost, words))
    return best[-1][1]


def every_cut(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in every_cut(text[n:]):
            yield [text[:n], *rest]


@pytest.mark.parametrize("seed", range(3))
def test_lattice_finds_the_cheapest_cut(spark, seed):
    rnd = random.Random(seed)
    letters = "今天气很开心中国人"
    dictionary = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))): rnd.randrange(1, 60) / 8 for _ in range(40)}
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 9))) for _ in range(60)] + ["".join(rnd.choices(letters, k=400))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["words"] for r in df.select("k", tk.lattice(dictionary, 9.0)(F.col("text")).alias("words")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == cuts(text, dictionary, 9.0)
        if len(text) < 9:
            price = lambda words: sum(dictionary.get(x, 9.0 if len(x) == 1 else float("inf")) for x in words)
            assert price(got[k]) == min(map(price, every_cut(text)))


def test_words_of_mixed_texts(spark):
    segment = tk.lattice({"今天": 1.0, "开心": 1.0, "产品": 1.0, "我": 2.0, "在": 2.0, "做": 2.0, "最近": 1.0})
    texts = ["我最近在做AI产品 and e.g. plain_words don't change", "今天很开心", None, "", "Nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    whole = {r["k"]: r["t"] for r in df.select("k", tk.word_tokens(F.col("content")).alias("t")).collect()}
    cut = {r["k"]: r["t"] for r in df.select("k", tk.word_tokens(F.col("content"), segment).alias("t")).collect()}
    assert cut[0] == ["最近", "AI", "产品", *whole[0][1:]] and cut[1] == ["今天", "开心"]
    assert all(cut[k] == whole[k] for k in (2, 3, 4))
    found = cl.classify(df, [Rule("emotion", "keyword", "开心", 4)], segment=segment).collect()
    assert {r["k"]: r["tags"] for r in found}[1] == ["今天", "开心"]
