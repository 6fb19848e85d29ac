"""Text -> array expressions: tokens, phrases, names, dictionary hits."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions.binding import let
from engram.functions.lexicon import mentions
from engram.functions.text import has_han, token_key


def _in(x: Column, words: Sequence[str]) -> Column:
    return x.isin(list(words))


#: Turns a run of Han characters into its words (array<string>).
Segmenter = Callable[[Column], Column]


def word_tokens(c: Column, segment: Segmenter | None = None) -> Column:
    """Words longer than one character. Han runs stay whole, unless ``segment`` cuts them."""
    found = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+(?:[._'][\p{L}\p{N}]+)*"), F.lit(0))
    if segment is not None:
        found = F.flatten(F.transform(found, lambda t: F.when(has_han(t), _cut_han(t, segment)).otherwise(F.array(t))))
    return F.filter(found, lambda t: F.length(t) > 1)


def _cut_han(token: Column, segment: Segmenter) -> Column:
    """The words of the Han runs of a token, and what stands between them."""
    parts = F.regexp_extract_all(token, F.lit(r"\p{IsHan}+|\P{IsHan}+"), F.lit(0))
    return F.flatten(F.transform(parts, lambda x: F.when(has_han(x), segment(x)).otherwise(F.array(x))))


def facet_tokens(c: Column, stopwords: Sequence[str] = tuple(lx.FACET_STOPWORDS), segment: Segmenter | None = None) -> Column:
    return F.filter(F.transform(word_tokens(c, segment), F.lower), lambda t: (F.length(t) > 1) & ~_in(t, stopwords))


def lattice(dictionary: Mapping[str, float], unknown: float = 20.0) -> Segmenter:
    """A segmenter by dictionary: of all ways to cut a run into words, the one of least cost.

    ``dictionary``: word -> cost, such as the negative logarithm of its frequency. A character that is no word by itself costs ``unknown``. At
    equal cost the longer last word wins. The best cut up to each character follows from those before it. The
    dictionary becomes a constant of the plan, which bounds it to some ten thousands of words; pass a segmenter of your own for more.
    """
    longest = max(map(len, dictionary), default=1)
    size = 1 << max(4, (2 * len(dictionary)).bit_length())
    buckets: list[list] = [[] for _ in range(size)]
    for word, cost in dictionary.items():
        buckets[zlib.crc32(word.encode()) % size].append({"w": word, "c": float(cost)})
    index = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w:string,c:double>>>")

    def cost(word: Column, length: Column) -> Column:
        known = F.filter(F.get(index, F.pmod(F.crc32(word.cast("binary")), F.lit(size)).cast("int")), lambda r: r["w"] == word)
        return F.coalesce(F.get(known, F.lit(0))["c"], F.when(length == 1, F.lit(float(unknown))))

    def step(text: Column, best: Column, i: Column) -> Column:
        ends = F.transform(
            F.sequence(F.lit(1), F.least(i, F.lit(longest))),
            lambda n: F.struct((F.get(best, i - n)["cost"] + cost(F.substring(text, i - n + 1, n), n)).alias("cost"), (-n).alias("back")),
        )
        return F.array_min(F.filter(ends, lambda e: e["cost"].isNotNull()))

    def words(text: Column, best: Column) -> Column:
        def back(s: Column, _: Column) -> Column:
            n = -F.get(best, s["end"])["back"]
            word = F.substring(text, s["end"] - n + 1, n)
            return F.when(s["end"] > 0, F.struct((s["end"] - n).alias("end"), F.concat(F.array(word), s["words"]).alias("words"))).otherwise(s)

        start = F.struct(F.length(text).alias("end"), F.array().cast("array<string>").alias("words"))
        return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, back)["words"]

    def segment(run: Column) -> Column:
        def cut(text: Column) -> Column:
            start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("back")))
            best = F.aggregate(F.sequence(F.lit(1), F.length(text)), start, lambda b, i: F.concat(b, F.array(step(text, b, i))))
            return let(best, lambda b: words(text, b))

        return F.when(F.length(run) > 0, let(run, cut)).otherwise(F.array().cast("array<string>"))

    return segment


def meaningful_token(t: Column) -> Column:
    """Not a link, not a number, long enough, not a stop word. Expects a lower-cased token.

    A Han token never equals an English stop word, so one list serves from three characters up.
    """
    long_enough = (F.length(t) >= 3) & ~_in(t, lx.THEME_DENYLIST) & ~t.rlike(r"^([0-9]+$|https?:|www\.)")
    short_han = (F.length(t) == 2) & has_han(t) & ~_in(t, lx.THEME_STOPWORDS_ZH)
    return long_enough | short_han


def meaningful_label(label: Column) -> Column:
    key = token_key(label)
    return ~_in(key, lx.ENTITY_DENYLIST) & (
        F.length(key) >= F.when(has_han(key), F.lit(2)).otherwise(F.lit(3))
    )


def corpus_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}@#._/-]+"), meaningful_token)


def phrases(tokens: Column) -> Column:
    """Distinct 2- and 3-word phrases of at least 7 characters."""

    def grams(words: Column, size: int) -> Column:
        last = F.size(words) - (size - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))

    return let(
        tokens,
        lambda words: F.array_distinct(
            F.filter(
                F.concat(grams(words, 2), grams(words, 3)),
                lambda p: (F.length(p) >= 7) & ~_in(p, lx.THEME_DENYLIST),
            )
        ),
    )


def coverage_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_./+-]{2,}|\p{IsHan}{2,}"), F.lit(0))


def proper_names(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(lx.bounded(lx.PROPER_NAME)), F.lit(0))
    return F.filter(
        F.array_distinct(found), lambda name: (F.length(name) >= 3) & ~_in(F.lower(name), lx.ENTITY_DENYLIST)
    )


def team_labels(c: Column) -> Column:
    """``<word> team|group`` in title case, then the hinted teams."""
    found = F.regexp_extract_all(c, F.lit("(?i)" + lx.bounded(lx.TEAM_LABEL)), F.lit(0))
    words = F.transform(found, lambda m: F.split(F.regexp_replace(m, lx.WS_RUN, " "), " "))
    named = F.filter(words, lambda w: ~_in(F.lower(w[0]), lx.ENTITY_DENYLIST))
    labels = F.transform(named, lambda w: F.array_join(F.transform(w, F.initcap), " "))
    hinted = F.filter(
        F.array(
            *[
                F.when(c.rlike("(?i)" + lx.bounded(f"{h}{lx.WS_RUN}team")), F.lit(f"{h.title()} Team"))
                for h in lx.TEAM_HINTS
            ]
        ),
        lambda x: x.isNotNull(),
    )
    low = F.lower(c)
    possible = F.contains(low, F.lit("team")) | F.contains(low, F.lit("group"))
    return F.when(possible, F.array_distinct(F.concat(labels, hinted))).otherwise(F.array().cast("array<string>"))


def dictionary_hits(c: Column, terms: Sequence[str], whole_words: bool = False) -> Column:
    """Dictionary terms found as substrings (the specified behaviour) or, on request, as whole words."""
    if whole_words:
        return let(
            F.lower(c),
            lambda text: F.array_compact(F.array(*[F.when(text.rlike(lx.bounded(t)), F.lit(t)) for t in terms])),
        )
    names = F.array(*[F.lit(t) for t in terms])
    return let(F.lower(c), lambda text: F.filter(names, lambda t: F.contains(text, t)))


def project_tags(tags: Column) -> Column:
    keys = F.transform(tags, lambda t: token_key(F.regexp_replace(t, r"^#+", "")))
    return F.filter(
        keys,
        lambda t: meaningful_token(t) & ~_in(t, lx.PROJECT_TAG_DENYLIST) & ~_in(t, lx.ENTITY_DENYLIST),
    )


def relation_targets(c: Column, lead: str) -> Column:
    pattern = f"(?<![A-Za-z0-9_]){lead} {lx.RELATION_TARGET}(?![A-Za-z0-9_])"
    found = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), meaningful_label)
    if not lead.replace(" ", "").isalnum():
        return found
    return F.when(F.contains(c, F.lit(f"{lead} ")), found).otherwise(F.array().cast("array<string>"))


def signals(c: Column, lexicons: dict[str, str]) -> Column:
    """Names of the lexicons that fire, in lexicon order."""
    return let(
        F.lower(c),
        lambda low: F.array_compact(F.array(*[F.when(mentions(low, p), F.lit(name)) for name, p in lexicons.items()])),
    )


def top_tokens(tokens: Column, k: int = 5) -> Column:
    """The ``k`` most frequent tokens, the one seen first winning a tie.

    Sorting puts equal tokens side by side, so a count is the distance to the next run: O(n log n) inside the row and no shuffle, however
    long the text. Only the fewer than ``k`` tokens above the ``k``-th count are sorted again; those at it come as they are seen.
    """

    def run_starts(s: Column) -> Column:
        return F.array_compact(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1) != x), j)))

    def chosen(t: Column, s: Column, runs: Column, counts: Column, least: Column) -> Column:
        def of(count_fits: Callable[[Column], Column]) -> Column:
            fits = F.transform(
                runs, lambda a, j: F.when(count_fits(F.get(counts, j)), F.struct((-F.get(counts, j)).alias("minus_n"), F.get(s, a).alias("t")))
            )
            return F.array_compact(fits)

        above = F.transform(
            of(lambda n: n > least), lambda x: F.struct(x["minus_n"].alias("minus_n"), F.array_position(t, x["t"]).alias("i"), x["t"].alias("t"))
        )
        level = F.transform(of(lambda n: n == least), lambda x: x["t"])
        return F.slice(F.concat(F.transform(F.sort_array(above), lambda x: x["t"]), F.array_intersect(t, level)), 1, k)

    def ranked(t: Column, s: Column, runs: Column) -> Column:
        counts = F.transform(runs, lambda a, j: F.coalesce(F.get(runs, j + 1), F.size(s)) - a)
        # the k-th largest count
        least = lambda n: F.coalesce(F.get(F.sort_array(n, asc=False), F.lit(k - 1)), F.lit(1))
        return let(counts, lambda n: let(least(n), lambda at: chosen(t, s, runs, n, at)))

    return let(tokens, lambda t: let(F.sort_array(t), lambda s: let(run_starts(s), lambda runs: ranked(t, s, runs))))
