"""Secret scan with one deterministic automaton for all rules.

Rules are written as small regex trees over bytes. Subset construction joins them, unanchored, into one automaton over
byte classes, minimisation shrinks it, and each state becomes an array of next states; a text is read once, byte
by byte, whatever the number of rules. Where a rule may end, the automaton of the reversed rule finds its start, and the
rule as an anchored pattern fixes the whole match and its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.store import Shared

# ---- regex trees -------------------------------------------------------------------------------------------------
Node = tuple


def chars(members: str, any_case: bool = False) -> Node:
    found = set(members.encode())
    if any_case:
        found |= set(members.lower().encode()) | set(members.upper().encode())
    return ("set", frozenset(found))


def seq(*parts: Node) -> Node:
    return ("seq", *parts)


def alt(*parts: Node) -> Node:
    return ("alt", *parts)


def text(literal: str, any_case: bool = False) -> Node:
    return seq(*[chars(c, any_case) for c in literal])


def many(part: Node, least: int = 0) -> Node:
    """``part`` at least ``least`` times."""
    return seq(*[part] * least, ("loop", part))


def maybe(part: Node) -> Node:
    return alt(part, seq())


def backwards(node: Node) -> Node:
    kind, *parts = node
    if kind == "set":
        return node
    parts = [backwards(p) for p in parts]
    return (kind, *(reversed(parts) if kind == "seq" else parts))


# ---- automata ----------------------------------------------------------------------------------------------------
class Positions:
    """Regex trees as states with byte-set moves and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: Node, start: int) -> int:
        kind, *parts = node
        end = self.state()
        if kind == "set":
            self.moves[start].append((parts[0], end))
        elif kind == "seq":
            at = start
            for part in parts:
                at = self.add(part, at)
            self.empty[at].append(end)
        elif kind == "alt":
            for part in parts:
                self.empty[self.add(part, start)].append(end)
        else:  # loop
            self.empty[start].append(end)
            self.empty[self.add(parts[0], end)].append(end)
        return end

    def closures(self) -> list[int]:
        """For each state the states that empty moves reach, as bits."""
        out = []
        for state in range(len(self.empty)):
            seen, todo = {state}, [state]
            while todo:
                for nxt in self.empty[todo.pop()]:
                    if nxt not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            out.append(sum(1 << s for s in seen))
        return out


def byte_classes(sets: set[frozenset]) -> np.ndarray:
    """Class of each byte; bytes that no set tells apart share one."""
    member = np.array([[b in s for b in range(256)] for s in sorted(sets, key=sorted)])
    return np.unique(member, axis=1, return_inverse=True)[1].reshape(-1).astype(np.uint8)


def compile_rules(rules: list[Node], unanchored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte classes, transitions by state and class, accepted rules of each state as bits); state 0 begins."""
    nfa = Positions()
    root = nfa.state()
    final = {}
    for k, rule in enumerate(rules):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        final[nfa.add(rule, begin)] = 1 << k
    classes = byte_classes({s for moves in nfa.moves for s, _ in moves})
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    closure = nfa.closures()
    useful = sum(1 << s for s, moves in enumerate(nfa.moves) if moves or s in final)
    reached = [[(c, closure[to] & useful) for members, to in moves for c, b in enumerate(sample) if b in members] for moves in nfa.moves]
    first = closure[root] & useful
    index, queue, table, accepts = {first: 0}, [first], [], []
    for states in queue:
        row, accepted, rest = [first if unanchored else 0] * len(sample), 0, states
        while rest:
            state = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            accepted |= final.get(state, 0)
            for c, mask in reached[state]:
                row[c] |= mask
        for key in row:
            if key not in index:
                index[key] = len(queue)
                queue.append(key)
        accepts.append(accepted)
        table.append([index[key] for key in row])
    return classes, *minimise(np.array(table, np.int32), np.array(accepts, np.int64))


def minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no continuation tells apart merged, by refining blocks until they are stable."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack([block, block[table]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    order[np.setdiff1d(np.arange(len(order)), block[:1])] = np.arange(1, len(order))
    names = order[block]
    _, one = np.unique(names, return_index=True)
    return names[table[one]].astype(np.int32), accepts[one]


# ---- rules -------------------------------------------------------------------------------------------------------
@dataclass
class Rule:
    """A kind of secret: its tree for the automaton, its pattern, and a group with its least number of characters."""

    kind: str
    tree: Node
    pattern: re.Pattern
    group: int = 0
    least: int = 1


_DIGIT, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _DIGIT + _LOWER + _LOWER.upper()
_QUOTE = maybe(chars("\"'"))
_KEYWORDS = alt(*[text(k, True) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")])

#: Base rules, in the order of the report.
BASE = [
    Rule(
        "assign",
        seq(_KEYWORDS, _QUOTE, many(chars(" ")), chars(":="), many(chars(" ")), _QUOTE, many(chars(_ALNUM + "+/_.=-"), 1)),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
        group=2,
        least=6,
    ),
    Rule("access", seq(text("AKIA"), many(chars(_DIGIT + _LOWER.upper()), 1)), re.compile(rb"AKIA[A-Z0-9]+"), least=20),
    Rule("hex", many(chars(_DIGIT + "abcdef"), 24), re.compile(rb"[0-9a-f]+"), least=24),
]

_URL64 = chars(_ALNUM + "_-")
#: Further kinds of well-known token formats.
MORE = [
    Rule("github", seq(text("gh"), chars("pousr"), text("_"), many(chars(_ALNUM), 1)), re.compile(rb"gh[pousr]_[A-Za-z0-9]+"), least=34),
    Rule("slack", seq(text("xox"), chars("abprs"), text("-"), many(chars(_ALNUM + "-"), 1)), re.compile(rb"xox[abprs]-[A-Za-z0-9-]+"), least=15),
    Rule(
        "jwt",
        seq(text("eyJ"), many(_URL64, 1), text(".eyJ"), many(_URL64, 1), text("."), many(_URL64, 1)),
        re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        least=36,
    ),
    Rule(
        "private_key",
        seq(text("-----BEGIN "), many(chars(_LOWER.upper() + " ")), text("PRIVATE KEY-----")),
        re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ),
]


@dataclass
class Scanner:
    rules: list[Rule]
    classes: bytes = b""
    rows: list[list[int]] = field(default_factory=list)
    accepts: list[int] = field(default_factory=list)
    reversed: list[tuple[bytes, list[list[int]], list[int], int]] = field(default_factory=list)

    def __post_init__(self):
        classes, table, accepts = compile_rules([r.tree for r in self.rules], unanchored=True)
        self.classes, self.rows, self.accepts = classes.tobytes(), table.tolist(), accepts.tolist()
        for rule in self.rules:
            classes, table, accepts = compile_rules([backwards(rule.tree)], unanchored=False)
            dead = next((s for s, row in enumerate(table) if not accepts[s] and (row == s).all()), -1)
            self.reversed.append((classes.tobytes(), table.tolist(), accepts.tolist(), dead))

    def link(self) -> list:
        """The start state as an array of arrays: entry c is the state after a byte of class c, the last entry its rules."""
        linked: list[list] = [[] for _ in self.rows]
        for k, row in enumerate(self.rows):
            linked[k].extend(linked[c] for c in row)
            linked[k].append(self.accepts[k])
        return linked[0]

    def begin(self, k: int, data: bytes, end: int, low: int) -> int:
        """Smallest start, not before ``low``, of a match of rule ``k`` that ends before byte ``end``; -1 for none."""
        classes, rows, accepts, dead = self.reversed[k]
        state, found = 0, -1
        for at in range(end - 1, low - 1, -1):
            state = rows[state][classes[data[at]]]
            if state == dead:
                break
            if accepts[state]:
                found = at
        return found

    def spans(self, data: bytes, start_state: list) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all secrets in byte positions, sorted; matches of one rule never overlap."""
        out: list[tuple[int, int, int]] = []
        resume = [0] * len(self.rules)
        row = start_state
        for at, c in enumerate(data.translate(self.classes), 1):
            row = row[c]
            if row[-1]:
                for k, rule in enumerate(self.rules):
                    if row[-1] >> k & 1 and at > resume[k]:
                        begin = self.begin(k, data, at, resume[k])
                        if begin >= 0:
                            match = rule.pattern.match(data, begin)
                            resume[k] = match.end()
                            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                                out.append((begin, k, match.end()))
        return sorted(out)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        start = scanner.link()
        kinds = [r.kind for r in scanner.rules]
        for batch in batches:
            data, offsets = w.buffers(batch.column(1))
            body = data.tobytes()
            found = []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                one = body[low:high]
                spans, points, at = [], 0, 0
                borders = {}
                hits = scanner.spans(one, start)
                for border in sorted({p for s, _, e in hits for p in (s, e)}):
                    points += len(one[at:border].decode())
                    borders[border], at = points, border
                for s, k, e in hits:
                    spans.append({"kind": kinds[k], "start": borders[s], "end": borders[e]})
                found.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return run


def secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive; by start, then in the order of the rules).

    A null or empty text has no spans; every row gives one row. Rules are BASE and MORE unless given.
    """
    scanner = Shared(docs.sparkSession, Scanner(rules or BASE + MORE))
    kinds = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kinds}, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(_scan(scanner), schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans of ``secrets``, and all spans as text."""
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of_kind(*[r.kind for r in BASE])
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))
