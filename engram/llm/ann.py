"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors form a class; shards hold classes, dealt by hash. A shard's graph grows in batches: greedy searches over
the graph so far propose neighbours, relaxed pruning keeps a neighbour only if no kept one is ALPHA times nearer to it
than the vector itself, and kept links are added backwards too. A query is a beam search in every shard, from the shard's
centre; its finds are scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.store import save

#: Links of a vector, relaxation of the pruning, beam widths for building and searching.
DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM = 32, 1.2, 48, 64
#: Vectors of a shard, about, and least number of shards, so that small tables are searched in parallel too.
SHARD_ROWS, LEAST_SHARDS = 20_000, 8
#: Queries of one block; every block meets every shard.
QUERY_BLOCK = 4096


class Graph:
    """Unit vectors, up to DEGREE neighbours of each (-1 for none) and the entry point."""

    def __init__(self, unit: np.ndarray, links: np.ndarray, entry: int):
        self.unit, self.links, self.entry = unit, links, entry

    def search(self, queries: np.ndarray, beam: int, ready: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, inner products) of the ``beam`` nearest found for each query, nearest first; -1 for none.

        All queries move on together: each expands the nearest vector of its beam not yet expanded until none is left.
        """
        n = len(queries)
        found = np.full((n, beam), -1)
        near = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        found[:, 0], done[:, 0] = self.entry, False
        near[:, 0] = queries @ self.unit[self.entry]
        seen = np.zeros((n, len(self.unit) if ready is None else ready), bool)
        seen[:, self.entry] = True
        active = np.arange(n)
        while len(active):
            k = np.argmax(np.where(done[active], -np.inf, near[active]), axis=1)
            done[active, k] = True
            nxt = self.links[found[active, k]]
            fresh = (nxt >= 0) & ~seen[active[:, None], nxt]
            rows, cols = np.nonzero(fresh)
            seen[active[rows], nxt[rows, cols]] = True
            product = np.full(nxt.shape, -np.inf, np.float32)
            product[rows, cols] = np.einsum("ij,ij->i", queries[active[rows]], self.unit[nxt[rows, cols]])
            both = np.concatenate([near[active], product], axis=1)
            ids = np.concatenate([found[active], np.where(fresh, nxt, -1)], axis=1)
            old = np.concatenate([done[active], ~fresh], axis=1)
            best = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
            take = np.arange(len(active))[:, None]
            near[active], found[active], done[active] = both[take, best], ids[take, best], old[take, best]
            active = active[~done[active].all(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)

    def prune(self, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """DEGREE diverse neighbours of each vector ``own`` out of its candidates (-1 for none)."""
        vectors = self.unit[np.maximum(candidates, 0)]
        away = 2 - 2 * np.einsum("ij,ikj->ik", self.unit[own], vectors)
        between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        away[(candidates < 0) | (candidates == own[:, None])] = np.inf
        out = np.full((len(own), DEGREE), -1)
        rows = np.arange(len(own))
        for slot in range(DEGREE):
            k = np.argmin(away, axis=1)
            live = np.isfinite(away[rows, k])
            if not live.any():
                break
            out[live, slot] = candidates[rows[live], k[live]]
            # squared distances: ALPHA counts twice
            covered = ALPHA**2 * between[rows, k] <= away
            covered[rows, k] = True
            away[covered & live[:, None]] = np.inf
        return out


def build(vectors: np.ndarray) -> Graph:
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    n = len(unit)
    centre = unit.mean(axis=0)
    entry = int(np.argmax(unit @ centre))
    links = np.full((n, DEGREE), -1)
    graph = Graph(unit, links, entry)
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    low, step = 1, 8
    while low < n:
        own = order[low : low + step]
        found, _ = graph.search(unit[own], min(BUILD_BEAM, max(2, n)))
        if low < 256:  # the first batches also propose each other
            found = np.concatenate([found, np.tile(order[: low + len(own)], (len(own), 1))], axis=1)
        links[own] = graph.prune(own, dedup(found))
        back = np.stack([links[own].ravel(), np.repeat(own, DEGREE)])[:, links[own].ravel() >= 0]
        back = back[:, np.argsort(back[0], kind="stable")]
        targets, first, count = np.unique(back[0], return_index=True, return_counts=True)
        wide = np.full((len(targets), DEGREE + int(count.max(initial=0))), -1)
        wide[:, :DEGREE] = links[targets]
        place = np.arange(back.shape[1]) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(targets)), count), DEGREE + place] = back[1]
        wide = dedup(wide)
        room = (wide >= 0).sum(axis=1)
        packed = -np.sort(-wide, axis=1)  # the missing last
        fits = room <= DEGREE
        links[targets[fits]] = packed[fits, :DEGREE]
        for at in range(0, int((~fits).sum()), 256):
            some = np.flatnonzero(~fits)[at : at + 256]
            links[targets[some]] = graph.prune(targets[some], packed[some][:, : room[some].max()])
        low += len(own)
        step = min(512, max(8, low))
    return graph


def dedup(ids: np.ndarray) -> np.ndarray:
    """Each row sorted, repeats replaced by -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _build(rows: pa.Table) -> pa.Table:
    """One row for a shard: its graph and vectors as bytes."""
    rows = rows.combine_chunks().sort_by("class")
    vectors = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).astype(np.float64)
    graph = build(vectors)
    return pa.table(
        {
            "dim": pa.array([vectors.shape[1]], pa.int32()),
            "shard": rows["shard"].slice(0, 1),
            "classes": pa.array([rows["class"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "links": pa.array([graph.links.astype(np.int32).tobytes()], pa.binary()),
            "entry": pa.array([graph.entry], pa.int32()),
        }
    )


def _search(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, class, score) of the nearest classes of one shard for the queries of one block."""
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                vectors = np.frombuffer(r["vectors"]).reshape(-1, dim)
                classes = np.frombuffer(r["classes"], np.int64)
                norms = np.linalg.norm(vectors, axis=1)
                graph = Graph((vectors / norms[:, None]).astype(np.float32), np.frombuffer(r["links"], np.int32).reshape(-1, DEGREE), r["entry"])
                asked = np.frombuffer(r["queries"]).reshape(-1, dim)
                ids = np.frombuffer(r["query_ids"], np.int64)
                length = np.linalg.norm(asked, axis=1)
                for low in range(0, len(asked), 256):
                    part = asked[low : low + 256]
                    found, _ = graph.search((part / length[low : low + 256, None]).astype(np.float32), SEARCH_BEAM)
                    score = np.einsum("ij,ikj->ik", part, vectors[np.maximum(found, 0)])
                    score /= length[low : low + 256, None] * norms[np.maximum(found, 0)]
                    score[found < 0] = -np.inf
                    best = np.argsort(-score, axis=1, kind="stable")[:, :count]
                    score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
                    rows, cols = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[low + rows]), pa.array(classes[found[rows, cols]]), pa.array(score[rows, cols])],
                        ["query_id", "class", "score"],
                    )

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    vectors = np.stack([np.asarray(e, float) for e in rows["embedding"]])
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]],
            "query_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "queries": [vectors.tobytes()],
        }
    )


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components whose length is neither 0 nor beyond range."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.coalesce(F.forall(vector, number) & (squares > 0) & (squares < float("inf")), F.lit(False))


def index(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(graphs, members, shards): a graph for each shard of the classes of equal vectors, (class, vec_id) of the rows, number of shards.

    ``vectors``: vec_id and embedding (array<double>, usable).
    """
    # a vector is its own key; its hash only deals it to a shard
    name = F.xxhash64("embedding")
    members = vectors.select("vec_id", name.alias("class"))
    classes = save(vectors.select("embedding").distinct().withColumn("class", name))
    shards = max(LEAST_SHARDS, -(-classes.count() // SHARD_ROWS))
    dealt = classes.select("class", "embedding", F.size("embedding").alias("dim"), F.pmod("class", F.lit(shards)).cast("int").alias("shard"))
    schema = "dim int, shard int, classes binary, vectors binary, links binary, entry int"
    return save(dealt.groupBy("dim", "shard").applyInArrow(_build, schema)), members, shards


def nearest(vectors: DataFrame, queries: Column, count: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the ``count`` nearest found of each row of vectors that ``queries`` holds for.

    Every other usable row is a candidate, ties go to the smaller vec_id; vectors meet only those of their own length.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without a vec_id.
    Rows with one vec_id are one candidate for each different vector, and never candidates for that vec_id.
    """
    usable_rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = save(usable_rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct())
    graphs, members, shards = index(rows)
    # of equal vectors only the smallest ids can be among the nearest: one for each place and the query's own
    first = Window.partitionBy("class").orderBy("vec_id")
    members = save(members.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= count + 1).select("class", "vec_id"))
    asked = rows.filter(queries)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("embedding"))
    packed = asked.groupBy("dim", "block").applyInPandas(_pack, "dim int, query_ids binary, queries binary")
    packed = save(packed).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = graphs.join(packed, ["dim", "shard"]).repartition(shards * blocks)
    found = pairs.mapInArrow(_search(count + 1), "query_id long, class long, score double")
    # each shard adds count + 1 rows for a query
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = save(found).join(members, "class").filter(F.col("vec_id") != F.col("query_id")).distinct()
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
