"""Exact copies against a plain grouping, with weak fingerprints, small pieces and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from engram.llm import copies

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, key string, body string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "x", None, str(k)) for k, (i, t) in enumerate(rows)], SCHEMA)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


def odd_rows():
    rnd = random.Random(4)
    texts = ["", None, "a", "A", "É", "é", "ab", "ba", "x" * 700, "x" * 699 + "y", "X" * 700, "x" * 701, "\x00", "\x00\x00", "K", "K"]
    texts += ["".join(rnd.choice("aAb") for _ in range(rnd.randrange(9))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, t in enumerate(texts[::2])]
    return rows + [(None, "a"), (None, "only null"), (None, "Only Null"), (7, "ba"), (1004, "a"), (1004, "A"), (1004, "a")]


@pytest.mark.parametrize("options", [{}, {"piece": 64, "huge_bytes": 200}, {"primes": (5, 3), "piece": 64, "huge_bytes": 200}])
def test_copies(spark, options):
    rows = odd_rows()
    got = copies.copies(frame(spark, rows), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_only_equal_fingerprints_differ(spark):
    """All texts of one length share a fingerprint modulo 1: only the comparison tells them apart."""
    rows = [(k, format(k % 50, "06b")) for k in range(200)]
    got = copies.copies(frame(spark, rows), primes=(1, 1))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_rows_that_stay(spark):
    rows = odd_rows()
    stay = copies.drop_copies(frame(spark, rows))
    assert stay.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
    got = stay.collect()
    assert sorted(repr((r["doc_id"], (r["text"] or "").translate(LOW))) for r in got) == sorted(
        repr((i, t)) for i, t in {(keep, (t or "").translate(LOW)) for (i, t), keep in keeps(rows)}
    )


def keeps(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    return [((i, t), max((x for x in groups[(t or "").translate(LOW)] if x is not None), default=None)) for i, t in rows]


def test_empty_table(spark):
    assert copies.copies(frame(spark, [])).collect() == []
    assert copies.drop_copies(frame(spark, [])).collect() == []


def test_a_large_group(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) AS text")
    got = copies.copies(docs).groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, True, 13333), (6667, False, 6666), (6667, True, 1)]


def test_fingerprints_compose():
    rnd = np.random.default_rng(1)
    text = rnd.integers(0, 256, 10_000, dtype=np.uint8)
    ends = np.array([0, len(text)])
    whole = copies.Fingerprint(0, piece=1 << 20).texts(text, ends)
    assert whole[0] == copies.Fingerprint(0, piece=17).texts(text, ends)[0]
    f = copies.Fingerprint(0)
    first = [sum((int(b) + 1) * pow(base, len(text) - 1 - k, p) for k, b in enumerate(text)) % p for base, p in zip(f.bases, f.primes)]
    assert whole[0] == first[0] << 31 | first[1]
