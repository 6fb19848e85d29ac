"""Which texts hold which patterns, for tables of both of any size.

Every pattern has an anchor: of its character runs the one that the fewest texts of a sample hold (the sample decides speed, never the
result). A bitmap of the anchors' hashes tests all runs of many texts at once, in arrays inside the task that reads them; only runs that
pass become rows, with as many characters around them as a pattern can reach. They meet the anchors by an equi-join and the pattern is searched in those characters, so that
no text and no pair of a text and a pattern is ever sent anywhere.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from engram.functions.binding import computed
from engram.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lengths of anchors; a pattern uses the largest one it reaches.
SIZES = (6, 4, 3, 2, 1)
#: Characters of a text that are looked at together.
PIECE = 1 << 18
#: Texts whose runs are counted to choose anchors.
SAMPLE_TEXTS = 300
#: Slots of the bitmap for each pattern, and their bounds.
SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS = 1 << 7, 1 << 14, 1 << 22
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _runs(text: Column, size: int) -> Column:
    """The run of ``size`` characters at each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def _hashed(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for the run of ``size`` characters at each place."""
    n = max(len(codes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + codes[k : k + n]
    return out


def _slot(hashed: np.ndarray, scope: np.ndarray, slots: int) -> np.ndarray:
    # the highest bits of the product; ``slots`` is a power of two
    return (hashed + scope) * _MIX >> np.uint64(65 - slots.bit_length())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _scope_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__scope").to_numpy().astype(np.uint64)


def _gram_slots(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = np.array([_hashed(_codes(g), len(g))[0] for g in batch.column("gram").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(_slot(hashed, _scope_numbers(batch), slots).astype(np.int64))})

    return run


def _scope_number(scope: Sequence[str]) -> Column:
    return F.hash(*scope).cast("bigint") if scope else F.lit(0).cast("bigint")


def _bitmap(anchors: DataFrame, scope: Sequence[str], slots: int) -> bytes:
    """A bit for each slot of an anchor, lowest first."""
    grams = anchors.select(_scope_number(scope).alias("__scope"), "gram").mapInArrow(_gram_slots(slots), "slot bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = np.zeros(slots // 64, np.int64)
    for word, bits in grams.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit)).collect():  # ``slots`` / 64 at most
        words[word] = bits
    return words.tobytes()


def _met(bitmap: bytes, slots: int, sizes: dict[int, int], keep: int):
    """The places of texts whose run passes the bitmap. The first ``keep`` columns go along."""
    reach = max(sizes.values())

    def pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, str]]]:
        """(row, text), about ``PIECE`` characters together; parts of a long text overlap by the longest pattern."""
        piece, size = [], 0
        for row, text in enumerate(batch.column("text").to_pylist()):
            for at in range(0, len(text or ""), PIECE):
                part = text[at : at + PIECE + reach]
                piece.append((row, part))
                size += len(part)
                if size >= PIECE:
                    yield piece
                    piece, size = [], 0
        if piece:
            yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            scope = _scope_numbers(batch)
            for piece in pieces(batch):
                joined = "".join(part for _, part in piece)
                codes = _codes(joined).astype(np.uint64)
                lengths = np.array([len(part) for _, part in piece])
                ends = np.cumsum(lengths)
                part = np.repeat(np.arange(len(piece)), lengths)
                rows = np.array([row for row, _ in piece])
                found: list[tuple[int, str, str]] = []
                for size, longest in sorted(sizes.items()):
                    hashed = _hashed(codes, size)
                    passes = marked[_slot(hashed, scope[rows[part[: len(hashed)]]], slots)]
                    places = np.flatnonzero(passes & (part[: len(hashed)] == part[size - 1 :][: len(hashed)]))
                    of, wide = part[places], longest - size
                    low, high = np.maximum(places - wide, (ends - lengths)[of]), np.minimum(places + size + wide, ends[of])
                    here = zip(rows[of].tolist(), places.tolist(), low.tolist(), high.tolist(), strict=True)
                    met = [(row, joined[i : i + size], joined[a:b]) for row, i, a, b in here]
                    found += met if wide else dict.fromkeys(met)
                if found:
                    row, gram, around = zip(*found, strict=True)
                    kept = [batch.column(i).take(pa.array(row)) for i in range(keep)]
                    names = [*batch.schema.names[:keep], "gram", "around"]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(gram), pa.array(around)], names)

    return run


def anchored(patterns: DataFrame, texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """patterns (scope, pattern: distinct and not empty) with size and gram, the anchor."""
    size = F.coalesce(*[F.when(F.length("pattern") >= n, n) for n in SIZES])
    sized = patterns.withColumn("size", size).filter(F.col("size").isNotNull())
    starts = F.sequence(F.lit(1), F.length("pattern") - F.col("size") + 1)
    runs = sized.select(*scope, "pattern", "size", F.explode(F.transform(starts, lambda i: F.substring("pattern", i, F.col("size")))).alias("gram"))
    sample = texts.select("text").limit(SAMPLE_TEXTS)
    counted = sample.select(F.explode(F.array_distinct(F.concat(*[_runs(F.col("text"), n) for n in SIZES]))).alias("gram")).groupBy("gram").count()
    rare = runs.join(counted, "gram", "left").groupBy(*scope, "pattern", "size")
    return materialize(rare.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram"))["gram"].alias("gram")))


def places(texts: DataFrame, anchors: DataFrame, scope: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(scope, keep, gram, around): the runs of texts that may be anchors. Where a pattern is no longer than its anchor
    ``around`` is the run, and each run of a text comes once."""
    sizes = {r["size"]: r["longest"] for r in anchors.groupBy("size").agg(F.max(F.length("pattern")).alias("longest")).collect()}
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_EACH * anchors.count()):
        slots *= 2
    columns = [*scope, *keep]
    fields = [StructField(c, texts.schema[c].dataType) for c in columns]
    schema = StructType([*fields, StructField("gram", StringType()), StructField("around", StringType())])
    if not sizes:
        return texts.sparkSession.createDataFrame([], schema)
    read = texts.select(*columns, "text", _scope_number(scope).alias("__scope"))
    return read.mapInArrow(_met(_bitmap(anchors, scope, slots), slots, sizes, len(columns)), schema)


def contained(texts: DataFrame, patterns: DataFrame, keep: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(scope, keep, pattern), distinct: the texts that hold a pattern, inside a scope of equal columns.

    ``texts``: scope, keep and text; ``patterns``: scope and pattern. A null text or pattern and an empty pattern is found nowhere.
    """
    scope, keep = list(scope), list(keep)
    texts = computed(texts.select(*scope, *keep, F.col("text").alias("__text")), "text", F.col("__text")).drop("__text")
    anchors = anchored(patterns.select(*scope, "pattern").distinct(), texts, scope)
    met = places(texts, anchors, scope, keep).join(anchors.drop("size"), [*scope, "gram"])
    return met.filter(F.contains("around", "pattern")).select(*scope, *keep, "pattern").distinct()
