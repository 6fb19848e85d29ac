"""Case-insensitive lexicon tests without running a regex where plain words do."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.binding import let

_W = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_META = re.compile(r"[\\.\[\]()?*+^${}]")


def jvm_regex(pattern: str) -> str:
    """A pattern with ASCII ``\\b`` and script names as the JVM engine spells them."""
    return pattern.replace(r"\b", _BOUNDARY).replace(r"\p{Script=Han}", r"\p{IsHan}")


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of ``a|b|(c|d)``; one enclosing group is opened first."""
    parts, depth, last, whole = [], 0, 0, pattern.startswith("(") and not pattern.startswith("(?")
    for i, ch in enumerate(pattern):
        if ch == "\\" or (i and pattern[i - 1] == "\\"):
            continue
        depth += (ch in "([") - (ch in ")]")
        if depth == 0 and i < len(pattern) - 1:
            whole = False
        if ch == "|" and depth == 0:
            parts.append(pattern[last:i])
            last = i + 1
    if whole:
        return alternatives(pattern[1:-1])
    return [*parts, pattern[last:]]


_BOUNDED = re.compile(r"\\b\((?:\?:)?([A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)*)\)\\b|\\b([A-Za-z0-9_]+)\\b")
#: Characters of lower-cased text that a regex which ignores case takes for ASCII letters.
_FOLDED = ("\u017f", "\u0131", "i\u0307")


def bounded_match(lowered: Column, raw: Column, pattern: str) -> Column:
    """Whether ``raw`` has a match of a pattern, ignoring case; ``lowered`` is ``raw`` in lower case.

    ``\\b(word|word)\\b`` is tried only where a word is a substring of ``lowered``, and there only at the words' first characters.
    """
    found = _BOUNDED.fullmatch(pattern)
    if found is None:
        return raw.rlike("(?iu)" + jvm_regex(pattern))
    words = list(dict.fromkeys((found[1] or found[2]).lower().split("|")))
    starts = "".join(sorted({w[0] for w in words}))
    possible = F.lit(False)
    for part in (*words, *_FOLDED):
        possible = possible | F.contains(lowered, F.lit(part))
    at_words = raw.rlike(f"(?iu)(?=[{starts}])(?<!{_W})(?:{'|'.join(words)})(?!{_W})")
    return possible & at_words


def mentions(lowered: Column, pattern: str) -> Column:
    """Whether lower-cased text contains a match of the lexicon ``pattern``. Never null.

    Plain words become substring tests, tens of times cheaper than a long alternation; only the alternatives
    that need it stay regular expressions.
    """
    parts = [q for p in alternatives(pattern) for q in (alternatives(p) if p.startswith("(") else [p])]
    words = [p.lower() for p in dict.fromkeys(parts) if not _META.search(p)]
    rest = [p for p in dict.fromkeys(parts) if _META.search(p)]

    def test(text: Column) -> Column:
        out = F.lit(False)
        if words:
            listed = F.from_json(F.lit(json.dumps(words)), "array<string>")
            out = F.exists(listed, lambda w: F.contains(text, w))
        if rest:
            by_regex = text.rlike("(?iu)" + jvm_regex("|".join(rest)))  # not lowered: \S and \s differ
            out = out | by_regex if words else by_regex
        return out

    return F.coalesce(let(lowered, test), F.lit(False))
