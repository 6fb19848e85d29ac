"""Benchmark decontamination with a generalised suffix automaton over the words of all benchmark items.

Training words stream through the automaton, which tracks the longest run of words that also stands in an item. Where
the run reaches a window (``size`` consecutive item words, or a whole shorter item), its words are hit. The automaton
is only entered on runs of words whose neighbouring pairs all occur in items; anywhere else its match is at most one
word long, so leaving those words out changes nothing (single-word items are looked up by word instead).

The benchmark is cut into parts of about MAX_WORDS words, so what is broadcast has a bound; each part is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.store import Shared, save

#: Words of one automaton, apart from one last item; its states take about 0.7 KB a word.
MAX_WORDS = 100_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = "array<struct<first: int, last: int, start: int, stop: int>>"
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "stop")]))


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[int]]], size: int):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: windows of a state: {number of words: item ids}
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, sequence in items:
            need, state, matched = min(size, len(sequence)), 0, 0
            for word in sequence:
                state, matched = self.step[state][word], matched + 1
                if matched >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    self.windows.setdefault(at, {}).setdefault(need, set()).add(item)
        #: nearest state with windows on the way to the root, the state itself included; -1 for none
        self.reach = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.reach[state] = state if state in self.windows else self.reach[self.link[state]] if state else -1

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that ``word`` leads to from ``state``, as the end of that state's longest run and no longer one."""
        old = self.step[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        copy = self._new(self.length[state] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = copy
        while state >= 0 and self.step[state].get(word) == old:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        added = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = added
            last = self.link[last]
        if last >= 0:
            self.link[added] = self._split(last, word)
        return added

    def scan(self, sequence: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(position, words, items) of each window that ends at a position."""
        step, link, length, reach = self.step, self.link, self.length, self.reach
        state = matched = 0
        for k, word in enumerate(sequence):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            at = reach[state]
            while at >= 0:
                for need, items in self.windows[at].items():
                    if need <= matched:
                        yield k, need, items
                at = reach[link[at]] if at else -1


class Scanner:
    """The automaton, and sorted hashes of the word pairs and single words that can lead into it."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        self.automaton = Automaton([(i, h.tolist()) for i, h in items], size)
        lengths = [min(size, len(h)) for _, h in items]
        self.least = min(lengths, default=0)
        pairs = [w.window_hashes(h, 2) for _, h in items]
        self.keys = np.unique(np.concatenate([h for _, h in items] if self.least == 1 else pairs or [np.zeros(0, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def runs(self, words: w.Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, after) of the word runs inside one text that may hold a window."""
        hashed = h if self.least == 1 else w.window_hashes(h, 2)
        if not len(hashed) or not len(self.keys):
            return
        near = np.flatnonzero(self.maybe[(hashed & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashed[near]), len(self.keys) - 1)
        near = near[self.keys[at] == hashed[near]]
        wide = 1 if self.least == 1 else 2
        near = near[words.doc[near] == words.doc[near + wide - 1]]
        if not len(near):
            return
        new = np.flatnonzero((np.diff(near) > 1) | (words.doc[near[1:]] != words.doc[near[:-1]])) + 1
        first, last = near[np.concatenate([[0], new])], near[np.concatenate([new - 1, [len(near) - 1]])]
        long = last - first + wide >= self.least
        yield from zip(first[long].tolist(), (last[long] + wide).tolist())

    def hits(self, words: w.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: hit word runs (first, after) and the items found."""
        h = words.hashes()
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for first, after in self.runs(words, h):
            for k, need, items in self.automaton.scan(h[first:after].tolist()):
                spans, ids = found.setdefault(int(words.doc[first]), ([], set()))
                spans.append((first + k + 1 - need, first + k + 1))
                ids.update(items)
        return found


def merged(spans: list[tuple]) -> list[tuple]:
    """Overlapping and touching (first, last, start, stop) spans joined."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


def _scan(shared, columns: list[str], again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            for low, words in w.chunks(batch.column("text"), w.ALNUM):
                n, bounds = words.n, words.bounds()
                spans: list[list[tuple]] = [[] for _ in range(n)]
                ids: list[set[str]] = [set() for _ in range(n)]
                if again:
                    for k, (old, items) in enumerate(zip(*[batch.column(c).slice(low, n).to_pylist() for c in ("spans", "items")])):
                        spans[k], ids[k] = [tuple(s.values()) for s in old], set(items)
                for k, (runs, items) in scanner.hits(words).items():
                    base, zero = int(bounds[k]), int(words.offsets[k])
                    spans[k] += [(a - base, b - base, int(words.start[a]) - zero, int(words.end[b - 1]) - zero) for a, b in runs]
                    ids[k] |= items
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(low, n) for c in columns],
                        pa.array(words.counts(), pa.int64()),
                        pa.array([[dict(zip(("first", "last", "start", "stop"), s)) for s in merged(x)] for x in spans], _SPAN_TYPE),
                        pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
                    ],
                    [*columns, "n_words", "spans", "items"],
                )

    return run


def _scanner(rows: list, size: int) -> Scanner:
    sequences = []
    for item, text in rows:
        for _, words in w.chunks(pa.array([text], pa.string()), w.ALNUM):
            if len(words.doc):
                sequences.append((item, words.hashes()))
    return Scanner(sequences, size)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of docs, n_words, spans (hit runs of words, as word and byte positions), items (ids found).

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. A null text has no words; an
    item without words finds nothing; items with one id count as one; a null item id reads "null". Repeated rows stay.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    parts = max(1, -(-int(total) // MAX_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = docs.select(*dict.fromkeys([*keep, "text"]))
    for k in range(parts):
        found = save(found) if k else found
        scanner = _scanner(items.filter(part == k).collect(), size)
        # the text goes on only where it is kept or another part must read it
        columns = list(dict.fromkeys([*keep, "text"] if k < parts - 1 else keep))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
        run = _scan(Shared(docs.sparkSession, scanner), columns, again=k > 0)
        found = found.mapInArrow(run, f"{schema}, n_words long, spans {SPANS}, items array<string>")
    return found


def hit_words() -> Column:
    """Number of words inside ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]).cast("long"))


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the found item ids, sorted, comma-joined), contaminated."""
    n_hit = hit_words()
    return contamination(docs, items, size).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs with every hit run cut out of the text; a document of which more than ``max_coverage`` is hit goes whole.

    Columns, other rows and the order of what is left in a text stay as they are; a column ``n_chars`` follows the text.
    """
    found = contamination(docs, items, size, tuple(docs.columns))
    found = found.filter(hit_words() <= F.col("n_words") * max_coverage)
    body = F.col("text").cast("binary")
    last = F.size("spans")
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("spans", k - 1)["stop"])
    end = lambda k: F.when(k == last, F.octet_length("text")).otherwise(F.get("spans", k)["start"])
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(body, begin(k) + 1, end(k) - begin(k)).cast("string"))
    out = found.withColumn("text", F.when(last == 0, F.col("text")).otherwise(F.array_join(pieces, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(last == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
