"""The Merkle manifest against a plain list version, for trees of many sizes, and what its labels promise."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from engram.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, hash int, tree string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(hashes):
    """(top, for each leaf its (left, right) by level)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for p, k in zip(paths, at):
            low = k // 8 * 8
            p.append(("".join(hashes[low:k]), "".join(hashes[k + 1 : low + 8])))
        hashes = [sha("".join(hashes[k : k + 8])) for k in range(0, len(hashes), 8)]
        at = [k // 8 for k in at]
    return hashes[0], paths


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault("" if row[2] is None else "=" + row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(trees, key=lambda t: t.encode())
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    built = {t: climb([x[2] for x in trees[t]]) for t in names}
    root, above = climb([built[t][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for (*_, own, row), path in zip(trees[t], built[t][1]):
            path = path + above[k]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf(row, row[1].translate(LOW) if row[1] is not None else None) if tampered else own
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], own, built[t][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def some_rows(sizes, seed=1):
    rnd = random.Random(seed)
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            text = rnd.choice([None, "", "Some Text", "all lower", "É " * rnd.randrange(5), "A" * rnd.randrange(3000)])
            rows.append((rnd.randrange(10**6), text, lang, rnd.choice([None, "web", "ü"]), rnd.choice([None, 3, -1])))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "p", 1, "t") for r in rows], SCHEMA)
    return merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


@pytest.mark.parametrize(
    "sizes",
    [{"en": 1}, {"en": 8}, {None: 9, "": 1, "en": 65, "é": 2}, {"a": 600, "b": 3, None: 64}, {f"l{k}": 1 + k % 3 for k in range(70)}],
)
def test_manifest(spark, sizes):
    rows = some_rows(sizes)
    if "b" in sizes:
        rows += [(None, "X", "b", None, None), (None, "X", "b", None, None), (rows[0][0], "Other", "a", None, None), rows[1], rows[1]]
    got = run(spark, rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_intervals_nest(spark):
    rows = some_rows({"a": 200, "b": 1})
    leaves = spark.createDataFrame([(r[2], k, leaf(r, r[1])) for k, r in enumerate(rows)], "tree string, id int, hash string")
    nodes = {}
    for r in merkle.forest(leaves, ["id"]).nodes().collect():
        nodes.setdefault((r["tree"], r["level"]), []).append((r["lo"], r["hi"]))
    assert {k: len(v) for k, v in nodes.items()} == {("a", 0): 200, ("a", 1): 25, ("a", 2): 4, ("a", 3): 1, ("b", 0): 1}
    for (tree, level), spans in nodes.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == (200 if tree == "a" else 1)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(lo % 8**level == 0 and hi - lo <= 8**level for lo, hi in spans)


def test_a_changed_row_no_longer_fits(spark):
    rows = [(k, f"Text {k}", "en", "web", 5) for k in range(100)]
    got = {r["doc_id"]: r["verified"] for r in run(spark, rows).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 != 0 for k in range(100)}
