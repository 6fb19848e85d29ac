"""Near-duplicate documents by a chosen-path join over word shingles, with every link confirmed on full sets.

1. Documents with the same shingle set form a class (id: a 64-bit hash of the set). Only classes go on.
2. Stars: classes that share a band of minwise tokens are paired with two heads drawn for the band. Confirmed pairs join
   large groups of near copies into components early, in a number of pairs that grows with the rows.
3. Trees: each tree sends every class down paths. A node picks one or two token positions from its own hash (1.25 on
   average, one over the similarity), and its children are the values found there. A node with few classes is
   compared exhaustively, a larger one is branched again; a node that lies in one component has nothing left to
   find and ends. Independent trees repeat this: a pair at exactly the limit stays together for d levels of one
   tree with a chance of 0.58 (d = 4) to 0.41 (d = 8), so TREES = 16 miss it with a chance below 2e-4.
4. A class goes on if some class of another component in its node has a signature that allows the similarity (within
   five standard deviations). These are compared on their full shingle sets, recomputed for their documents only, in
   blocks of bounded size, which report links and no other pairs.
5. Connected components over all confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.graph import BLOCK_ROWS, active_rows, blocks_to_compare, components
from engram.llm.store import save

POSITIONS = 64
TREES = 16
MAX_DEPTH = 8
LEAF_ROWS = 32
BANDS, BAND_WIDTH = 8, 6
STAR_HEADS = 2

_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = [f"s{k}" for k in range(POSITIONS // 8)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens of a shingle set, 32 bits each."""
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for low in range(0, len(shingles), 4096):
        part = (_MULTIPLIERS[:, None] * shingles[None, low : low + 4096]).min(axis=1)
        least = np.minimum(least, part)
    return (w.mix(least) >> np.uint64(32)).astype(np.uint32)


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a shingle set."""
    mixed = w.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = w.mix(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))]))
    return int(total.view(np.int64)[0])


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in w.chunks(batch.column(1), w.NOT_SPACE):
                sets = w.shingles(words, words.hashes(), size)
                filled = np.array([len(s) > 0 for s in sets])
                sig = np.zeros((len(sets), POSITIONS), np.uint32)
                ids = np.zeros(len(sets), np.int64)
                for k in np.flatnonzero(filled):
                    sig[k], ids[k] = signature(sets[k]), set_id(sets[k])
                sketch = np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)
                offsets = np.arange(0, sig.size + 1, POSITIONS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids, mask=~filled),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1).view(np.int32))),
                        *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(_SKETCH))],
                    ],
                    ["doc_id", "n_shingles", "id", "sig", *_SKETCH],
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in w.chunks(batch.column(0), w.NOT_SPACE):
                sets = [s for s in w.shingles(words, words.hashes(), size) if len(s)]
                if sets:
                    flat = np.concatenate(sets).view(np.int64)
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets]), lists], ["id", "members"])

    return run


def _agreeing(left, right) -> Column:
    """Positions where two sketches hold the same byte."""

    def differing_bytes(name: str) -> Column:
        x = left(name).bitwiseXOR(right(name))
        for by in (4, 2, 1):  # the lowest bit of each byte becomes the OR of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(POSITIONS) - reduce(lambda a, b: a + b, [differing_bytes(name) for name in _SKETCH])


def _plausible(percent: int):
    p = percent / 100
    least = max(0, int(POSITIONS * p - 5 * (POSITIONS * p * (1 - p)) ** 0.5))

    def test(left, right) -> Column:
        a, b = left("n_shingles"), right("n_shingles")
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_agreeing(left, right) >= least)

    return test


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures and set sizes allow the similarity."""
    sides = [classes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "n_shingles", *_SKETCH)]) for side in "ab"]
    both = pairs.join(sides[0], F.col("a") == F.col("a_id")).join(sides[1], F.col("b") == F.col("b_id"))
    return both.filter(_plausible(percent)(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")


def _full(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, members (the whole shingle set) of the classes in ``ids``, from the text of one document each."""
    heads = classes.join(ids, "id", "left_semi").select(F.col("doc_id").alias("head")).distinct()
    texts = docs.join(heads, docs["doc_id"].eqNullSafe(F.col("head")), "left_semi").select("text")
    return save(texts.mapInArrow(_full_sets(size), "id long, members array<long>").dropDuplicates(["id"]))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("shared")
    return save(both.filter(100 * F.col("shared") >= percent * union).select("a", "b"))


def _block_links(percent: int):
    """Links between rows of a block that lie on different sides (or in one chunk) and in different components.

    A row is compared with one row after another until it is linked; what is linked already is not compared again.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("id", "ascending")])
        ids, comps = table["id"].to_numpy(), table["comp"].to_numpy().copy()
        lists = table["members"].combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        count = np.diff(offsets)
        owner = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], np.diff(flat[order]) != 0]) if len(flat) else np.zeros(0, bool)
        element = np.empty(len(flat), np.int64)
        element[order] = np.cumsum(new) - 1
        holders, start = owner[order], np.concatenate([np.flatnonzero(new), [len(flat)]])
        split = int((table["side"].to_numpy() == 0).sum())
        found = []
        # each row of the first side against all rows of the second, or all later rows of one chunk
        for k in range(split):
            low = split if split < len(ids) else k + 1
            own = element[offsets[k] : offsets[k + 1]]
            met = np.concatenate([holders[start[e] : start[e + 1]] for e in own]) if len(own) else np.zeros(0, np.int64)
            shared = np.bincount(met, minlength=len(ids))
            near = np.flatnonzero(100 * shared[low:] >= percent * (count[k] + count[low:] - shared[low:])) + low
            for j in near:
                if comps[j] != comps[k]:
                    found.append((ids[k], ids[j]))
                    comps[comps == comps[j]] = comps[k]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_comp(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _stars(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, comp) of classes that confirmed star pairs join, and the full sets read for them.

    Each band draws STAR_HEADS heads and pairs them with the other classes of the band.
    """
    bands = [F.xxhash64(F.lit(k), F.slice("sig", k * BAND_WIDTH + 1, BAND_WIDTH)) for k in range(BANDS)]
    banded = classes.select("id", F.explode(F.array(*bands)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    banded = save(banded.join(shared, "key"))
    sets = _full(banded.select("id").distinct(), classes, docs, size)
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("by"), F.col("id").alias("head"))) for k in range(STAR_HEADS)]
    heads = banded.groupBy("key").agg(F.array(*drawn).alias("drawn")).select("key", F.explode("drawn.head").alias("head"))
    pairs = banded.join(heads, "key").filter("id != head")
    pairs = pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    return components(_linked(_likely(pairs, classes, percent), sets, percent)), sets


def _token(node: Column, depth: int, k: int) -> tuple[Column, Column]:
    position = F.pmod(F.xxhash64(node, F.lit(depth), F.lit(k)), F.lit(POSITIONS)).cast("int")
    return position, F.xxhash64(node, F.lit(depth), position, F.get("sig", position))


def _branches(depth: int) -> Column:
    """Child nodes of ``node`` for a row with ``sig``: one, or for one node in four two."""
    node = F.col("node")
    p, first = _token(node, depth, 0)
    q, second = _token(node, depth, 1)
    twice = (F.pmod(F.xxhash64(node, F.lit(-1 - depth)), F.lit(4)) == 0) & (p != q)
    return F.explode(F.when(twice, F.array(first, second)).otherwise(F.array(first)))


def _tree_rows(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, id) of classes that meet a likely partner of another component in a node of any tree; all nodes (key, n, top).

    Classes of the component with the top rank of a node are not listed, only their partners.
    """
    rows = classes.select("id", "comp", "rank", "sig", F.explode(F.sequence(F.lit(1), F.lit(TREES)).cast("array<long>")).alias("node"))
    leaves = []
    for depth in range(1, MAX_DEPTH + 1):
        rows = save(rows.select("id", "comp", "rank", _branches(depth).alias("node")))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("rank").alias("top"))
        nodes = save(nodes.filter("n > 1 and x < y").select("node", "n", "top"))
        small = nodes.filter(F.col("n") <= LEAF_ROWS) if depth < MAX_DEPTH else nodes
        leaves.append((rows.join(small, "node").select(F.col("node").alias("key"), "id", "comp", "rank"), small))
        large = nodes.filter(F.col("n") > LEAF_ROWS)
        if depth == MAX_DEPTH or large.isEmpty():
            break
        rows = rows.join(large, "node").select("id", "node").join(classes.select("id", "comp", "rank", "sig"), "id")
    members = reduce(DataFrame.union, [leaf for leaf, _ in leaves])
    counted = reduce(DataFrame.union, [small for _, small in leaves]).select(F.col("node").alias("key"), "n", "top")
    members = members.join(classes.select("id", "n_shingles", *_SKETCH), "id")
    met = save(active_rows(members, counted, _plausible(percent), ["n_shingles", *_SKETCH]).distinct())
    return met, counted


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id is that one).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of ``size`` words.
    A shorter text is one shingle. Texts that are null or without words are linked with nothing and kept. Links need
    ``100 * intersection >= percent * union``. Rows with the same doc_id are rows of one document: equal texts give
    equal rows, different texts meet only through links. A null doc_id takes part, but is never kept unless its
    text is empty or only null ids share the component. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    schema = ", ".join(f"{s} long" for s in _SKETCH)
    found = save(docs.mapInArrow(_signatures(size), f"doc_id long, n_shingles long, id long, sig array<int>, {schema}"))
    same = ["n_shingles", "sig", *_SKETCH]  # equal for all rows of a class
    one = found.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in same])
    classes = save(one)
    groups, sets = _stars(classes, docs, size, percent)
    rows = _with_comp(classes, groups)
    # large components get a rank by size, a hash tells equal sizes apart
    large = rows.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK_ROWS)
    order = F.least("n", F.lit(1 << 22)) * F.lit(1 << 40) + F.pmod(F.xxhash64("comp"), F.lit(1 << 40))
    large = save(large.select("comp", order.alias("rank")))
    rows = save(rows.join(large, "comp", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long"))))
    met, nodes = _tree_rows(rows, percent)
    # components that may be linked: those that meet in a node, and the top one of that node
    met = met.join(rows.select("id", "comp"), "id").select("key", "comp").distinct()
    heads = met.groupBy("key").agg(F.min("comp").alias("head"))
    tops = nodes.filter("top > 0").join(large.withColumnRenamed("comp", "of"), F.col("top") == F.col("rank")).select("key", "of")
    pairs = met.join(heads, "key").select("comp", "head").union(met.join(tops, "key").select("comp", "of"))
    wide = components(pairs.toDF("a", "b")).select(F.col("id").alias("comp"), F.col("comp").alias("group"))
    wide = rows.select("id", "comp").join(wide, "comp")
    more = _full(wide.select("id").join(sets, "id", "left_anti"), classes, docs, size)
    blocks = blocks_to_compare(save(wide)).join(sets.union(more), "id")
    links = blocks.select("block", "side", "id", "comp", "members").groupBy("block").applyInArrow(_block_links(percent), "a long, b long")
    groups = components(links.union(groups.toDF("a", "b")))
    classes = _with_comp(classes.select("id", "doc_id"), groups)
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "comp").select("id", "component_id")
    out = found.select("doc_id", "n_shingles", "id").join(classes, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
