"""Exact copies of whole texts by composable polynomial fingerprints.

A text, with A-Z lower-cased, is a number in base b modulo a prime, for two primes of 31 bits. Fingerprints compose:
that of A followed by B is f(A) * b^|B| + f(B), so pieces are hashed apart and combined by shifting with the lengths. Texts
of up to HUGE_BYTES are hashed where they are read; the pieces of longer ones are dealt out, hashed by all tasks, and combined.

Equal length and fingerprint only make a candidate. The texts of all candidates are compared piece by piece: the smallest and the
largest piece at one place of a fingerprint must be the same. Both are kept in the map-side aggregate, so that a group of
any size sends one row for each piece and task. Texts that differ after all get a further fingerprint and are
compared again, until none differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.store import Shared, save

#: Bytes of a piece, for hashing and for comparing.
PIECE_BYTES = 1 << 18
#: Longer texts are hashed in pieces by several tasks.
HUGE_BYTES = 1 << 24
#: Largest two primes below 2^31: a fingerprint has 62 bits.
PRIMES = (2147483647, 2147483629)
#: Most bits of the filter of repeated fingerprints (128 MB); where it is too small it lets more texts through.
FILTER_BITS = 1 << 30
#: A group with more than this part of all rows is joined by broadcast: there are at most as many such groups.
HOT_PART = 1000

_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


class Fingerprint:
    """Fingerprints of one round; each round has bases of its own."""

    def __init__(self, round_: int, primes: tuple[int, int] = PRIMES, piece: int = PIECE_BYTES):
        rng = np.random.default_rng([13, round_])
        self.primes, self.piece = primes, piece
        self.bases = tuple(int(rng.integers(p // 4, p)) for p in primes)
        self._powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in primes]

    def _power(self, which: int, n: int) -> np.ndarray:
        """Powers 0 to n - 1 of the base, by doubling."""
        table, p = self._powers[which], np.uint64(self.primes[which])
        while len(table) < n:
            step = np.uint64(pow(self.bases[which], len(table), int(p)))
            table = np.concatenate([table, table * step % p])
        self._powers[which] = table
        return table

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The hash of each non-empty piece of at most ``piece`` bytes, for each prime."""
        out = []
        length = end - start
        place = np.repeat(end - 1, length) - (np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length))
        value = data[np.repeat(end - 1, length) - place].astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(self.primes):
            terms = value * self._power(k, int(length.max()))[place]
            out.append(np.add.reduceat(terms, np.cumsum(length) - length) % np.uint64(p))
        return out

    def shift(self, length: int) -> tuple[int, ...]:
        """What the fingerprint of a text is multiplied by when ``length`` bytes follow."""
        return tuple(pow(b, length, p) for b, p in zip(self.bases, self.primes))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Fingerprint of each text as one 62-bit number; an empty text has 0."""
        size = np.diff(offsets)
        parts = -(-size // self.piece)
        owner = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        out = np.zeros(len(size), np.int64)
        if not len(owner):
            return out
        start = offsets[owner] + k * self.piece
        end = np.minimum(start + self.piece, offsets[owner + 1])
        first, second = self.pieces(data, start, end)
        whole = parts[owner] == 1
        out[owner[whole]] = pack(first[whole], second[whole])
        for i in np.flatnonzero(parts > 1):
            mine = np.flatnonzero(owner == i)
            total = [0, 0]
            for j in mine:
                shift = self.shift(int(end[j] - start[j]))
                total = [(t * s + int(h[j])) % p for t, s, h, p in zip(total, shift, (first, second), self.primes)]
            out[i] = (total[0] << 31) | total[1]
        return out


def pack(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first << np.uint64(31)) | second).astype(np.int64)


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = w.buffers(column)
    return _LOW[data], offsets


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about a work piece of bytes together; a longer text alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + w.CHUNK_BYTES, "right")) - 1))
        yield low, high
        low = high


def _scan(prints: list[Fingerprint], wanted: Shared | None):
    """(doc_id, n, key, sha) of every text; with ``wanted``, (doc_id, n, key, sha, body) of those whose last fingerprint it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        filter_ = None if wanted is None else wanted.value
        names = ["doc_id", "n", "key", "sha"] + ([] if wanted is None else ["body"])
        for batch in batches:
            data, offsets = _normal(batch.column("text"))
            for low, high in _runs(offsets):
                part = offsets[low : high + 1] - offsets[low]
                body = data[offsets[low] : offsets[high]]
                keys = np.stack([f.texts(body, part) for f in prints], 1)
                picked = np.arange(high - low)
                if filter_ is not None:
                    at = keys[:, len(prints) - 1] & (len(filter_) * 8 - 1)
                    picked = np.flatnonzero(filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                texts = [body[part[i] : part[i + 1]].tobytes() for i in picked]
                columns = [
                    batch.column("doc_id").slice(low, high - low).take(pa.array(picked)),
                    batch.column("n").slice(low, high - low).take(pa.array(picked)),
                    pa.array(list(keys[picked]), pa.list_(pa.int64())),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([] if wanted is None else [pa.array(texts, pa.binary())]), names)

    return run


def _hash_pieces(print_: Fingerprint):
    """(row, doc_id, n, sha, k, first, second, shift_first, shift_second) of pieces (row, doc_id, n, sha, k, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, offsets = _normal(one.column("piece"))
                (first,), (second,) = print_.pieces(data, offsets[:1], offsets[1:])
                numbers = [int(first), int(second), *print_.shift(len(data))]
                columns = [one.column(c) for c in ("row", "doc_id", "n", "sha", "k")] + [pa.array([x], pa.int64()) for x in numbers]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "sha", "k", "first", "second", "shift_first", "shift_second"])

    return run


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else; null as an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _combined(which: str, prime: int) -> Column:
    """Fingerprint of a text from its ``parts`` in order: each step shifts by the length of the next piece and adds it."""
    return F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: (h * x[f"shift_{which}"] + x[which]) % prime)


def _huge(docs: DataFrame, prints: list[Fingerprint]) -> DataFrame:
    """(doc_id, n, key, sha, body) of the texts of docs: their pieces are hashed by all tasks and combined by length-shifted sums."""
    piece = prints[0].piece
    body = F.col("body")
    rows = docs.select("doc_id", lowered(F.col("text")).cast("binary").alias("body"))
    rows = save(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length(body).cast("long").alias("n"), F.sha2(body, 256).alias("sha"), "body"))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / piece).cast("int"))).alias("k"))
    cut = cut.select("row", "doc_id", "n", "sha", "k", F.substring(body, F.col("k") * piece + 1, F.lit(piece)).alias("piece"))
    cut = cut.repartition("row", "k")
    doc_id = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {doc_id}, n long, sha string, k int, first long, second long, shift_first long, shift_second long"
    keys = None
    for r, print_ in enumerate(prints):
        hashed = cut.mapInArrow(_hash_pieces(print_), schema)
        parts = F.array_sort(F.collect_list(F.struct("k", "first", "second", "shift_first", "shift_second")))
        one = hashed.groupBy("row").agg(parts.alias("parts"))
        first, second = (_combined(c, p) for c, p in zip(("first", "second"), print_.primes))
        one = one.select("row", F.shiftleft(first, 31).bitwiseOR(second).alias(f"key_{r}"))
        keys = one if keys is None else keys.join(one, "row")
    key = F.array(*[f"key_{r}" for r in range(len(prints))])
    return keys.select("row", key.alias("key")).join(rows, "row").select("doc_id", "n", "key", "sha", "body")


def _fingerprints(docs: DataFrame, prints: list[Fingerprint], huge_bytes: int) -> DataFrame:
    """(doc_id, n, key, sha) of docs, written down."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    huge = F.col("n") > huge_bytes
    read = docs.select("doc_id", size.cast("long").alias("n"), F.when(size <= huge_bytes, F.col("text")).alias("text"))
    found = save(read.mapInArrow(_scan(prints, None), _fields(docs)))
    if found.filter(huge).isEmpty():
        return found
    return save(found.filter(~huge).unionByName(_huge(docs.filter(size > huge_bytes), prints).drop("body")))


def _bodies(docs: DataFrame, prints: list[Fingerprint], huge_bytes: int, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, key, sha, body) of all texts that may have a wanted (n, key)."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    small = docs.filter(size <= huge_bytes).select("doc_id", size.cast("long").alias("n"), "text")
    small = small.mapInArrow(_scan(prints, Shared(docs.sparkSession, _filter(wanted))), _fields(docs) + ", body binary")
    if wanted.filter(F.col("n") > huge_bytes).isEmpty():
        return small
    return small.unionByName(_huge(docs.filter(size > huge_bytes), prints))


def _fields(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key array<long>, sha string"


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of the last fingerprints of ``keys``, 16 for each of them but FILTER_BITS at most, as bytes."""
    count = keys.count()
    bits = 1 << 15
    while bits < min(FILTER_BITS, 16 * count):
        bits *= 2
    at = F.element_at("key", -1).bitwiseAND(F.lit(bits - 1))
    rows = keys.select((at / 32768).cast("int").alias("block"), F.bitmap_bit_position(at + 1).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for block, bitmap in rows.groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        out[block * 4096 : (block + 1) * 4096] = np.frombuffer(bitmap, np.uint8)
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    """(n, key, group_size, keep_id) of the fingerprints that several rows have."""
    return rows.groupBy("n", "key").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).filter("group_size > 1")


def _differing(bodies: DataFrame, piece: int) -> DataFrame:
    """(n, key) under which texts differ. Pieces at one place are equal if the smallest is the largest."""
    cut = bodies.filter("n > 0").select("n", "key", "body", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / piece).cast("int"))).alias("k"))
    cut = cut.select("n", "key", "k", F.substring("body", F.col("k") * piece + 1, F.lit(piece)).alias("piece"))
    met = cut.groupBy("n", "key", "k").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    return met.filter("low <> high").select("n", "key").distinct()


def classes(
    docs: DataFrame, primes: tuple[int, int] = PRIMES, piece: int = PIECE_BYTES, huge_bytes: int = HUGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(rows, repeated): (doc_id, n, key, sha) of every row, where (n, key) is the same for equal texts only, and
    (n, key, group_size, keep_id) of the texts that several rows have. ``primes`` serve the first round only."""
    docs = docs.select("doc_id", "text")
    prints = [Fingerprint(0, primes, piece)]
    rows = _fingerprints(docs, prints, huge_bytes)
    repeated = save(_repeated(rows))
    doubtful = repeated
    while True:
        differing = save(_differing(_bodies(docs, prints, huge_bytes, doubtful), piece))
        if differing.isEmpty():
            return rows, repeated
        # texts that share a fingerprint and differ: a further one, and the same again for them alone
        known = len(prints)
        prints = [*prints, Fingerprint(known, PRIMES, piece)]
        again = _fingerprints(docs, prints, huge_bytes).withColumn("known", F.slice("key", 1, known))
        old = differing.select(F.col("n").alias("old_n"), F.col("key").alias("old_key"))
        again = again.join(old, (F.col("n") == F.col("old_n")) & (F.col("known") == F.col("old_key")), "left_semi").drop("known")
        fresh = save(again)
        doubtful = save(_repeated(fresh))
        rows = save(rows.join(differing, ["n", "key"], "left_anti").select(*fresh.columns).unionByName(fresh))
        repeated = save(repeated.join(differing, ["n", "key"], "left_anti").select(*doubtful.columns).unionByName(doubtful))


def _decided(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha, copies) with ``copies`` equal rows in one where it is more than one."""
    rows, repeated = classes(docs, **options)
    # groups of more than a thousandth of all rows: fewer than a thousand
    hot = repeated.filter(F.col("group_size") * HOT_PART > rows.count())
    with_hot = rows.join(F.broadcast(hot), ["n", "key"])
    other = rows.join(F.broadcast(hot.select("n", "key")), ["n", "key"], "left_anti").join(repeated, ["n", "key"], "left")
    met = with_hot.select(*other.columns).unionByName(other)
    single = F.col("group_size").isNull()
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha", "copies"]
    one = F.lit(1).cast("long").alias("copies")
    alone = met.filter(single).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", one)
    gone = met.filter(~single & ~last).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "sha", one)
    # rows that repeat the largest id of their group are one row here
    stay = met.filter(~single & last).groupBy("n", "key", "doc_id", "keep_id", "group_size", "sha").agg(F.count("*").alias("copies"))
    return alone.unionByName(gone).unionByName(stay.withColumn("kept", F.lit(True)).select(*columns))


def copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; other columns are not read).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are one group. Of equal texts the row
    with the largest doc_id stays; a row without doc_id stays only where the whole group has none. Of several rows
    that repeat the largest doc_id one stays. text_sha256 is of the lower-cased text. An empty table gives no rows.
    """
    found = _decided(docs, **options)
    # two steps, so that no array grows with the number of copies beyond its square root
    block = 1 + F.floor(F.sqrt(F.col("copies")))
    blocks = found.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, block)))
    each = blocks.withColumn("at", F.explode(F.sequence("from", F.least(F.col("from") + block, F.col("copies")) - 1)))
    return each.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("at") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns, which may have any names."""
    own = "__own"
    while own in docs.columns:
        own += "_"
    left = docs.withColumn(own, F.sha2(lowered(F.col("text")).cast("binary"), 256))
    stay = _decided(docs, **options).filter("kept").select(F.col("doc_id").alias("__stay"), F.col("sha").alias("__sha"))
    left = left.join(stay, left["doc_id"].eqNullSafe(stay["__stay"]) & (left[own] == stay["__sha"]), "left_semi")
    return left.dropDuplicates(["doc_id", own]).drop(own)
