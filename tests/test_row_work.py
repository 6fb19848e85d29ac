"""Expressions inside the row against plain loops, and that they do not do more work than they need."""

from collections import Counter

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions.lexicon import bounded_match, jvm_regex
from engram.functions.text import collapsed
from engram.functions.tokens import top_tokens


def test_top_tokens_equals_counter(spark):
    lists = [[], ["a"], list("abcabca"), list("zyxwvuts"), list("aabbccddeeff"), list("fedcbafedcbag"), list("qqqpppzzyyxxa"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, t array<string>").select("i", top_tokens(F.col("t"), 3).alias("r"))
    want = {i: None if v is None else [t for t, _ in Counter(v).most_common(3)] for i, v in enumerate(lists)}
    assert {r.i: r.r for r in df.collect()} == want
    # distinct tokens are not sorted with their places: structs are made of the counted ones only
    assert top_tokens(F.col("t"), 3)._jc.toString().count("sort_array") == 3


def test_bounded_match_equals_the_regex_and_asks_for_the_word_first(spark):
    texts = ["rest", "arest", "rest1", "a rest.", "REST", "reſt", "tıred", "TİRED", "tiredé", "unrest rest", "sleepy", "_rest", "", None, "Kids", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("low", F.lower("raw"))
    for pattern in (r"\b(tired|rest|sleep)\b", r"\bkids\b", r"\b(tir|tired|est|rest)\b", r"re.t"):
        got = bounded_match(F.col("low"), F.col("raw"), pattern)
        rows = df.select("raw", got.alias("got"), F.col("raw").rlike("(?iu)" + jvm_regex(pattern)).alias("want")).collect()
        assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]
    assert "contains" in bounded_match(F.col("low"), F.col("raw"), r"\b(tired|rest)\b")._jc.toString()


def test_collapsed_equals_replacing_every_run(spark):
    texts = [" a  b\t\nc 　d ", "a b", "a é", "a b", "\n", " ", "", None, "x \n", "é é  é"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    plain = F.btrim(F.regexp_replace("c", lx.WS_RUN, " "), F.lit(" "))
    rows = df.select(collapsed(F.col("c")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
