"""Rule-based classification as one projection per memory: no shuffle, no Python.

Keyword and phrase rules are substring tests; regex rules are literal ``rlike`` tests (a pattern taken from a
joined column would be recompiled per row).  A large rule set is first narrowed by the characters a pattern
starts with; only the rules whose start occurs in the text are verified.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.functions.binding import computed, let
from engram.functions.lexicon import bounded_match, mentions
from engram.functions.tokens import Segmenter, coverage_tokens, facet_tokens, top_tokens
from engram.operators.containment import contained
from engram.operators.rules import Rule, category_order
from engram.session import materialize

DIRECT_RULES = 200
GRAM_SIZES = (10, 8, 6, 5, 4, 3)

def _hit(rule: Rule) -> Column:
    return F.struct(F.lit(rule.category).alias("category"), F.lit(rule.weight).cast("bigint").alias("weight"))


_RULE = "struct<pattern:string,category:string,weight:bigint>"


def _constant(value: list, ddl: str) -> Column:
    """A nested literal, parsed once while the query is optimized."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _row(rule: Rule) -> dict:
    return {"pattern": rule.pattern.lower(), "category": rule.category, "weight": rule.weight}


def _found(candidates: Column, content: Column) -> Column:
    hits = F.filter(candidates, lambda r: F.contains(content, r["pattern"]))
    return F.transform(hits, lambda r: F.struct(r["category"].alias("category"), r["weight"].alias("weight")))


def _by_grams(rules: Sequence[Rule], content: Column) -> list[Column]:
    """Candidates through the first characters of their pattern, then verified.

    Patterns are bucketed by the checksum of their first characters, as many as leave only a few patterns
    shorter than that; those are tested one by one.  A text looks up the buckets of its own character runs of
    that length: the work grows with the text, hardly with the number of rules.
    """
    size = next(
        (g for g in GRAM_SIZES if sum(len(r.pattern) < g for r in rules) <= DIRECT_RULES), GRAM_SIZES[-1]
    )
    short = [r for r in rules if len(r.pattern) < size]
    parts = [_found(_constant([_row(r) for r in short], f"array<{_RULE}>"), content)] if short else []
    # sparse buckets: a text's runs rarely hit one by chance
    n = 1 << max(13, (16 * len(rules)).bit_length())
    buckets: list[list] = [[] for _ in range(n)]
    for rule in rules:
        if len(rule.pattern) >= size:
            buckets[zlib.crc32(rule.pattern.lower()[:size].encode()) % n].append(_row(rule))
    grams = F.regexp_extract_all(content, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    wanted = F.array_distinct(F.transform(grams, lambda g: F.pmod(F.crc32(g), F.lit(n)).cast("int")))
    return [*parts, _found(_bucket_rules(wanted, buckets), content)]


def _bucket_rules(wanted: Column, buckets: list[list]) -> Column:
    index = _constant(buckets, f"array<array<{_RULE}>>")
    return F.flatten(F.transform(wanted, lambda b: F.get(index, b)))


def matched_rules(rules: Sequence[Rule], content: Column, regex_text: Column | None = None) -> Column:
    """array<struct<category, weight>> of all rules that match. ``content`` must be lower-cased."""
    literal = [r for r in rules if r.match_type in ("keyword", "phrase")]
    regex = [r for r in rules if r.match_type == "regex"]

    def found(text: Column, raw: Column) -> Column:
        parts = [F.array().cast("array<struct<category:string,weight:bigint>>")]
        if literal and len(literal) <= DIRECT_RULES:
            parts.append(_found(_constant([_row(r) for r in literal], f"array<{_RULE}>"), text))
        elif literal:
            parts.extend(_by_grams(literal, text))
        if regex:
            parts.append(F.array_compact(F.array(*[F.when(bounded_match(text, raw, r.pattern), _hit(r)) for r in regex])))
        return F.concat(*parts)

    return let(content, lambda text: found(text, text if regex_text is None else regex_text))


def category_scores(matched: Column, order: Sequence[str] = tuple(lx.CATEGORY_PRIORITY)) -> Column:
    """array<struct<minus_score, priority, category>>, the winner first."""
    ranks = F.array(*[F.lit(c) for c in order])

    def score(hits: Column, c: Column) -> Column:
        total = F.aggregate(
            F.filter(hits, lambda r: r["category"] == c), F.lit(0).cast("bigint"), lambda a, r: a + r["weight"]
        )
        place = F.array_position(ranks, c)
        return F.struct(
            (-total).alias("minus_score"),
            F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("bigint").alias("priority"),
            c.alias("category"),
        )

    def all_scores(hits: Column) -> Column:
        names = F.array_distinct(F.transform(hits, lambda r: r["category"]))
        return F.sort_array(F.transform(names, lambda c: score(hits, c)))

    return let(matched, all_scores)


def fallback_category(tokens: Column, available: Sequence[str]) -> Column:
    """Category from the first lexicon test that fires on the space-joined facet tokens."""
    default = next((c for c in lx.DEFAULT_CATEGORIES if c in available), available[0] if available else "task")

    def chain(joined: Column) -> Column:
        out = F
        for pattern, preferred in lx.FALLBACK_TESTS:
            chosen = next((c for c in preferred if c in available), default)
            out = out.when(mentions(joined, pattern), chosen)
        return out.otherwise(default)

    return let(F.array_join(tokens, " "), chain)


def classify(df: DataFrame, rules: Sequence[Rule], tags: int = 5, segment: Segmenter | None = None) -> DataFrame:
    """Add category, confidence and tags. Needs ``content``. ``segment`` cuts Han runs into words, see ``tokens.lattice``."""
    available = category_order([r.category for r in rules])
    scores = category_scores(matched_rules(rules, tx.normalized(F.col("content"))))

    def verdict(s: Column, tokens: Column) -> Column:
        total = -F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["minus_score"])
        best = F.get(s, F.lit(0))
        return F.struct(
            F.when(total > 0, best["category"]).otherwise(fallback_category(tokens, available)).alias("category"),
            F.when(total > 0, tx.ratio2(-best["minus_score"], total))
            .otherwise(F.lit(lx.UNMATCHED_CONFIDENCE))
            .alias("confidence"),
            top_tokens(tokens, tags).alias("tags"),
        )

    result = let(facet_tokens(F.col("content"), segment=segment), lambda tokens: let(scores, lambda s: verdict(s, tokens)))
    kept = [c for c in df.columns if c not in ("category", "confidence", "tags")]
    return computed(df, "__verdict", result).select(*kept, "__verdict.*")


def rule_scores(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per (memory, category) that scored."""
    scores = category_scores(matched_rules(rules, tx.normalized(F.col("content"))))
    return df.select("owner_id", "id", F.explode_outer(scores).alias("s")).filter("s is not null").select(
        "owner_id", "id", F.col("s.category").alias("category"), (-F.col("s.minus_score")).alias("score")
    )


def literal_scores(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(owner_id, id, category, score) from a table of keyword and phrase rules (category, pattern, weight) of any size.

    Texts and patterns meet by rare character runs, see :mod:`engram.operators.containment`. ``id`` must be unique inside ``owner_id``.
    """
    weights = rules.groupBy(F.lower("pattern").alias("pattern"), "category").agg(F.sum(F.col("weight").cast("bigint")).alias("weight"))
    texts = df.select("owner_id", "id", tx.normalized(F.col("content")).alias("text"))
    found = contained(texts, weights.select("pattern"), ["owner_id", "id"]).join(weights, "pattern")
    return found.groupBy("owner_id", "id", "category").agg(F.sum("weight").cast("bigint").alias("score"))


def low_confidence(classified: DataFrame, below: float) -> DataFrame:
    """Rows to hand on for a second opinion."""
    return classified.filter(F.col("confidence") < below)


def coverage(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per memory: winning category without fallback, null when no rule matches. Regexes see the raw text."""
    order = [c for c in lx.CATEGORY_PRIORITY if c not in ("activity", "identity")]
    scores = category_scores(matched_rules(rules, F.lower("content"), F.col("content")), order)
    return df.withColumn("category", F.get(scores, F.lit(0))["category"])


def coverage_report(covered: DataFrame, top_categories: int = 20, top_tokens: int = 30) -> DataFrame:
    """Long form (section, name, n): totals, largest categories, most frequent tokens of unmatched texts."""
    missing = F.col("category").isNull()
    # read three times below: keep the verdict and, for unmatched texts, their tokens
    slim = materialize(
        covered.select("category", F.when(missing, coverage_tokens(F.col("content"))).alias("tokens"))
    )
    totals = slim.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("category").alias("matched"),
        F.count_if(missing).alias("unmatched"),
    ).selectExpr("stack(3, 'total', total, 'matched', matched, 'unmatched', unmatched) as (name, n)")

    def top(counted: DataFrame, k: int) -> DataFrame:
        return counted.orderBy(F.desc("n"), "name").limit(k)

    by_category = slim.filter("category is not null").groupBy(F.col("category").alias("name"))
    tokens = slim.select(F.explode("tokens").alias("name"))
    parts = {
        "totals": totals,
        "category": top(by_category.agg(F.count(F.lit(1)).alias("n")), top_categories),
        "unmatched_token": top(tokens.groupBy("name").agg(F.count(F.lit(1)).alias("n")), top_tokens),
    }
    frames = [p.select(F.lit(s).alias("section"), "name", "n") for s, p in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
