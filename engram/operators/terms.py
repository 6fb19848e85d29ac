"""Tokens and phrases of texts, counted where rows of a table meet by the term.

Most phrases occur once, so a row for each of them costs more than the text. Here tasks count the terms of many texts at once in
arrays (Arrow, numpy) and send what they found in lists by bucket, a hash of group and term; every bucket is summed by itself. What a task holds
is bounded by ``WORDS`` on one side and by a bucket on the other, however large a group is.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from engram.lexicons import THEME_DENYLIST

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that are counted together; more of them find more equal terms.
WORDS = 400_000
#: Buckets (a power of two): a bucket's different terms are held at once.
BUCKET_BITS = 11
#: Terms that are summed together, if their buckets are smaller.
TERMS = 500_000
MIN_PHRASE = 7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grouped(columns: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, a row of each group) of equal values, null equal to null."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        values = c.dictionary_encode(null_encoding="encode")
        code = code * (len(values.dictionary) + 1) + values.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group.astype(np.int64), first


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; faster than numpy's own table of hashes."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _tally(row: np.ndarray, group: np.ndarray, term: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, term, number of its rows with the term) of terms below 2 ** bits; a term counts once in a row."""
    below = (1 << bits) - 1
    seen = _distinct(row << bits | term)
    found = np.sort(group[seen >> bits] << bits | seen & below)
    start = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    return found[start] >> bits, found[start] & below, np.diff(np.append(start, len(found)))


def _frequent(found: tuple[np.ndarray, ...], least: int) -> tuple[np.ndarray, ...]:
    """What :func:`_tally` found in at least ``least`` rows."""
    wanted = found[-1] >= least
    return found if least <= 1 else tuple(x[wanted] for x in found)


def _counts(words: pa.Array, group: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, is a phrase, name, rows, hash) of the terms of rows that all have words, of those in at least ``least`` rows."""
    row = np.repeat(np.arange(len(words), dtype=np.int64), pc.list_value_length(words).to_numpy())
    encoded = words.flatten().dictionary_encode()
    word, code = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    length = pc.utf8_length(word).to_numpy()
    hashed = np.array([zlib.crc32(w) for w in word.cast(pa.binary()).to_pylist()], np.uint64)
    denied = pa.array([p for p in THEME_DENYLIST if " " in p], pa.string())

    bits = len(word).bit_length()
    g, t, n = _frequent(_tally(row, group, code, bits), least)
    parts = [(g, np.zeros(len(g), bool), word.take(pa.array(t)), n, hashed[t])]

    def counted(g: np.ndarray, n: np.ndarray, *codes: np.ndarray) -> None:
        wanted = sum(length[c] for c in codes) + len(codes) - 1 >= MIN_PHRASE
        g, n, codes = g[wanted], n[wanted], [c[wanted] for c in codes]
        name = pc.binary_join_element_wise(*[word.take(pa.array(c)) for c in codes], " ")
        if len(denied):
            wanted = ~pc.is_in(name, denied).to_numpy(zero_copy_only=False)
            g, n, codes, name = g[wanted], n[wanted], [c[wanted] for c in codes], name.filter(pa.array(wanted))
        mixed = np.full(len(g), len(codes), np.uint64)
        for c in codes:
            mixed = mixed * _MIX + hashed[c]
        parts.append((g, np.ones(len(g), bool), name, n, mixed))

    two = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[two] << bits | code[two + 1], return_inverse=True)
    first, second = pairs >> bits, pairs & (1 << bits) - 1
    g, t, n = _frequent(_tally(row[two], group, pair, len(pairs).bit_length()), least)
    counted(g, n, first[t], second[t])
    three = np.flatnonzero(two[1:] == two[:-1] + 1)
    g, t, n = _frequent(_tally(row[two[three]], group, pair[three] << bits | code[two[three] + 2], len(pairs).bit_length() + bits), least)
    counted(g, n, first[t >> bits], second[t >> bits], t & (1 << bits) - 1)
    join = lambda i: np.concatenate([p[i] for p in parts])
    return join(0), join(1), pa.concat_arrays([p[2] for p in parts]), join(3), join(4)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _bucketed(table: pa.Table, keys: Sequence[str]) -> pa.RecordBatch:
    """The terms of some rows, a row for each bucket; inside it the terms of a group follow each other."""
    table = table.combine_chunks()
    columns = {c: pa.concat_arrays(table[c].chunks) for c in table.column_names}
    group, first = _grouped([columns[k] for k in keys], len(table))
    g, phrase, name, n, hashed = _counts(columns["words"], group)
    values = [columns[k].take(pa.array(first)).to_pylist() for k in keys]
    key_hash = [zlib.crc32(repr([v[i] for v in values]).encode()) for i in range(len(first))]
    bucket = ((hashed + np.array(key_hash, np.uint64)[g]) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(bucket * len(first) + g, kind="stable")
    g, bucket = g[order], bucket[order]
    run = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(g) != 0)))
    rows = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
    runs = np.searchsorted(run, rows)
    out = {"bucket": pa.array(bucket[rows], pa.int32())}
    for i, k in enumerate(keys):
        out[f"key_{i}"] = _lists(columns[k].take(pa.array(first[g[run]])), runs)
    out["sizes"] = _lists(pa.array(np.diff(np.append(run, len(g))), pa.int32()), runs)
    at = pa.array(order)
    out["phrase"] = _lists(pa.array(phrase).take(at), rows)
    out["name"] = _lists(name.take(at), rows)
    out["n"] = _lists(pa.array(n, pa.int64()).take(at), rows)
    return pa.RecordBatch.from_pydict(out)


def _sent(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch.filter(pc.greater(pc.list_value_length(batch.column("words")), 0))])
            ends = np.append(0, np.cumsum(pc.list_value_length(table["words"]).to_numpy()))
            start = 0
            while start < len(table):
                stop = int(np.searchsorted(ends, ends[start] + WORDS - size, "right")) - 1
                if stop > start or not waiting:
                    stop = max(stop, start + 1)  # a row of more words is counted alone
                    waiting.append(table.slice(start, stop - start))
                    size += int(ends[stop] - ends[start])
                    start = stop
                if size >= WORDS or start < len(table):
                    yield _bucketed(pa.concat_tables(waiting), keys)
                    waiting, size = [], 0
        if waiting:
            yield _bucketed(pa.concat_tables(waiting), keys)

    return run


def _summed(keys: Sequence[str], least: int):
    def total(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = lambda c: pa.concat_arrays([b.column(c).flatten() for b in batches])
        values = [flat(f"key_{i}") for i in range(len(keys))]
        sizes = flat("sizes").to_numpy(zero_copy_only=False)
        group, first = _grouped(values, len(sizes))
        terms = pa.table({"g": np.repeat(group, sizes), "phrase": flat("phrase"), "name": flat("name"), "n": flat("n")})
        sums = terms.group_by(["g", "phrase", "name"], use_threads=False).aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least)).combine_chunks()
        at = pa.array(first[sums["g"].to_numpy()])
        out = {k: v.take(at) for k, v in zip(keys, values, strict=True)}
        out["kind"] = pc.if_else(sums["phrase"], "phrase", "token")
        return pa.table(out | {"name": sums["name"], "n": sums["n_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            # the buckets before the last one of this batch are complete
            done = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if done and size + len(batch.column("name").flatten()) >= TERMS:
                yield from total([*waiting, batch.slice(0, done)]).to_batches()
                waiting, size, batch = [], 0, batch.slice(done)
            elif len(bucket) and waiting and size >= TERMS and waiting[-1].column("bucket")[-1].as_py() != bucket[0]:
                yield from total(waiting).to_batches()
                waiting, size = [], 0
            waiting.append(batch)
            size += len(batch.column("name").flatten())
        if size:
            yield from total(waiting).to_batches()

    return run


def term_counts(features: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """(keys, kind token|phrase, name, n >= least): number of rows with the word, or with the phrase of two or three words that follow each other.

    ``features``: keys and words, an array of strings without spaces; null keys form a group.
    """
    keys = list(keys)
    rows = features.select(*keys, "words")
    types = [rows.schema[k].dataType for k in keys]
    lists = {f"key_{i}": t for i, t in enumerate(types)}
    lists |= {"sizes": IntegerType(), "phrase": BooleanType(), "name": StringType(), "n": LongType()}
    sent = StructType([StructField("bucket", IntegerType()), *[StructField(c, ArrayType(t)) for c, t in lists.items()]])
    named = zip([*keys, "kind", "name", "n"], [*types, StringType(), StringType(), LongType()], strict=True)
    found = rows.mapInArrow(_sent(keys), sent)
    met = found.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return met.mapInArrow(_summed(keys, least), StructType([StructField(c, t) for c, t in named]))


def _whole(keys: Sequence[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.filter(pc.greater(pc.list_value_length(batch.column("words")), 0)) for batch in batches]
        held = [batch for batch in held if len(batch)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        group, first = _grouped([table[k].combine_chunks() for k in keys], len(table))
        values = {k: table[k].take(pa.array(first)) for k in keys}
        order = np.argsort(group, kind="stable")
        words = pc.list_value_length(table["words"]).to_numpy()[order]
        ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
        sums, start = np.append(0, np.cumsum(words)), 0
        while start < len(order):
            # whole groups; one of more words is counted alone
            k = max(int(np.searchsorted(sums[ends], sums[start] + WORDS, "right")) - 1, int(np.searchsorted(ends, start, "right")))
            rows, start = order[start : ends[k]], int(ends[k])
            part = table["words"].take(pa.array(rows))
            g, phrase, name, n, _ = _counts(pa.concat_arrays(part.chunks), group[rows], least)
            out = {key: v.take(pa.array(g)) for key, v in values.items()}
            out["kind"] = pc.if_else(pa.array(phrase), "phrase", "token")
            yield from pa.table(out | {"name": name, "n": pa.array(n, pa.int64())}).combine_chunks().to_batches()

    return run


def group_term_counts(features: DataFrame, keys: Sequence[str], parts: int, least: int = 1) -> DataFrame:
    """As :func:`term_counts`, for groups of bounded size: the words of a group meet in one of ``parts`` tasks and are counted there."""
    keys = list(keys)
    rows = features.select(*keys, "words")
    schema = [StructField(k, rows.schema[k].dataType) for k in keys]
    schema += [StructField("kind", StringType()), StructField("name", StringType()), StructField("n", LongType())]
    return rows.repartition(parts, *keys).mapInArrow(_whole(keys, least), StructType(schema))
