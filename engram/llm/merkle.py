"""A Merkle manifest of a dataset by nested-interval labels.

Rows are leaves, ranked inside their tree (a partition of the dataset, such as a language) by id. Every node carries the interval
[lo, hi) of the leaf ranks it covers; FAN consecutive nodes of a level make one of the next until a tree has one node left, its subroot. The
subroots, in order of their trees, are the leaves of one more tree, whose top is the root.

Levels are built upwards by grouping on the bucket lo / FAN^level. On the way down each node meets its parent by a containment
join: equal tree and level bucket, interval inside the parent's. What the parent's interval holds beside the node's own are its
siblings: those that end before it hash on its left, those that begin after it on its right. A level has an eighth of the rows of the one below,
and no join key has more than FAN rows, however large a tree is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.copies import lowered
from engram.llm.store import save

#: Consecutive nodes that make one of the next level.
FAN = 8


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def encoded(*values: Column) -> Column:
    """The values, each as its number of UTF-8 bytes, a colon and itself, or as - where null, one after another."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with lo, the rank inside the tree by ``order`` from 0, and n, the tree's rows.

    Rows are dealt by range, so that a tree of any size spreads over all tasks; by a hash only through its first 15 digits, as Spark
    gathers a sample of the keys. Equal rows are interchangeable.
    """
    slices = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.conv(F.substring(c, 1, 15), 16, 10).cast("long") if c == "hash" else F.col(c) for c in ("tree", *order)]
    dealt = rows.repartitionByRange(slices, *keys).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    placed = save(dealt.withColumn("slice", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    # one row for each tree and slice: the slices and the trees together
    parts = placed.groupBy("tree", "slice").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(of_tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "slice", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(of_tree).alias("n"))
    met = placed.join(parts, ["tree", "slice"])
    return met.withColumn("lo", F.col("at") - F.col("first") + F.col("before")).drop("slice", "at", "first", "before")


@dataclass
class Forest:
    """Leaves (tree, n, lo, hash, ...) and, for each level from 1, nodes (tree, n, lo, hi, hash, children in order)."""

    leaves: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(tree, hash) of the last node of each tree."""
        out = self.leaves.filter("n = 1").select("tree", "hash")
        for k, nodes in enumerate(self.levels, 1):
            out = out.unionByName(nodes.filter(F.col("n") <= FAN**k).select("tree", "hash"))
        return out

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, hash) of all nodes."""
        out = self.leaves.select("tree", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), "hash")
        for k, nodes in enumerate(self.levels, 1):
            out = out.unionByName(nodes.select("tree", F.lit(k).alias("level"), "lo", "hi", "hash"))
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Each leaf with its columns, those of ``above`` for its tree, and path: its siblings (left, right) level by level.

        ``above``: tree, path, and columns with names of their own; the path of a tree's top.
        """
        extra = [c for c in above.columns if c not in ("tree", "path")]
        parents = None
        for level in range(len(self.levels), 0, -1):
            nodes = self.levels[level - 1]
            found = nodes.filter(F.col("n") <= FAN**level).join(above, "tree").select(*nodes.columns, "path", *extra)
            if parents is not None:
                found = found.unionByName(_under(nodes.filter(F.col("n") > FAN**level), parents, level + 1, extra))
            parents = save(found) if level > 1 else found
        columns = self.leaves.columns
        alone = self.leaves.filter("n = 1").join(above, "tree").select(*columns, "path", *extra)
        if parents is None:
            return alone
        opened = parents.select("tree", "n", "path", *extra, "children", F.explode("children").alias("node"))
        own = [F.col(c) if c in ("tree", "n") else F.col(f"node.{c}").alias(c) for c in columns]
        step = _siblings(F.col("node.lo"), F.col("node.lo") + 1)
        return alone.unionByName(opened.select(*own, F.array_prepend("path", step).alias("path"), *extra))


def _siblings(lo: Column, hi: Column) -> Column:
    """What the interval of the parent (``children``) holds beside [lo, hi), as the joined hashes to the left and to the right."""
    joined = lambda outside: F.array_join(F.transform(F.filter("children", outside), lambda c: c["hash"]), "")
    return F.struct(joined(lambda c: c["hi"] <= lo).alias("left"), joined(lambda c: c["lo"] >= hi).alias("right"))


def _under(nodes: DataFrame, parents: DataFrame, level: int, extra: list[str]) -> DataFrame:
    """nodes with path and ``extra``, from the parent at ``level`` that contains them."""
    above = parents.select(
        F.col("tree").alias("__tree"), F.floor(F.col("lo") / FAN**level).alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
        F.col("children").alias("__children"), "path", *extra,
    )
    bucket = F.floor(F.col("lo") / FAN**level)
    inside = (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
    met = nodes.join(above, (F.col("tree") == F.col("__tree")) & (bucket == F.col("__bucket")) & inside)
    met = met.withColumnsRenamed({"children": "__own", "__children": "children"})
    met = met.withColumn("path", F.array_prepend("path", _siblings(F.col("lo"), F.col("hi"))))
    return met.drop("children").withColumnRenamed("__own", "children").select(*nodes.columns, "path", *extra)


def forest(leaves: DataFrame, order: list[str]) -> Forest:
    """The trees over ``leaves``: tree (not null), hash, and columns to carry, none of them called n, lo, hi, path, children or node."""
    leaves = save(ranked(leaves, order))
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    while largest > FAN ** len(levels):
        level = len(levels) + 1
        below = levels[-1] if levels else leaves.withColumn("hi", F.col("lo") + 1)
        # leaves take all their columns into the first level; above it a child is its interval and its hash
        child = F.struct("lo", "hi", "hash", *([c for c in leaves.columns if c not in ("tree", "n", "lo", "hash")] if not levels else []))
        grown = below.filter(F.col("n") > FAN ** (level - 1)).groupBy("tree", "n", F.floor(F.col("lo") / FAN**level).alias("bucket"))
        made = grown.agg(F.sort_array(F.collect_list(child)).alias("children"))
        hashes = F.array_join(F.transform("children", lambda c: c["hash"]), "")
        levels.append(
            save(made.select("tree", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), digest(hashes).alias("hash"), "children"))
        )
    return Forest(leaves, levels)


def tree_key(name: Column) -> Column:
    """A key that is never null and sorts null first, then by UTF-8 bytes."""
    return F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name.cast("string")))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, hash, ...) with subroot, root and path: siblings (left, right) of each level up to the subroot, then up to the root."""
    trees = forest(leaves, order)
    tops = save(trees.tops())
    over = forest(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    root = over.tops().select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<left string, right string>>").alias("path"))
    above = over.paths(root).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    return trees.paths(save(above))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, tree: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    A leaf hashes the ``fields`` of a row; other columns are not read. Rows without ``tree`` make a tree of their own, the first;
    rows without ``order`` come first in their tree, rows with the same id by their leaf; equal rows are interchangeable.
    An empty table gives no rows. Where ``tampered`` holds, folded_root starts from the leaf of the row with A-Z of its text lower-cased.
    """
    leaf = digest(encoded(*[F.col(c) for c in fields]))
    changed = digest(encoded(*[F.when(F.col(c).isNotNull(), lowered(F.col(c))) if c == "text" else F.col(c) for c in fields]))
    found = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order).alias("id"), leaf.alias("hash"), F.when(found, changed).alias("changed"))
    # written down, so that dealing the leaves by range reads and hashes the texts once
    proved = proofs(save(leaves), ["id", "hash"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    proved = proved.select(
        F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
