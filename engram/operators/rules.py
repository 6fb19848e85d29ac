"""Taxonomy rules as data: loading, generation, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators.ranking import union_all


@dataclass(frozen=True)
class Rule:
    category: str
    match_type: str
    pattern: str
    weight: int


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rules written as one SQL value row per line."""
    return parse_rule_lines(spark.read.text(path))


def parse_rule_lines(lines: DataFrame) -> DataFrame:
    """``('id', 'version', 'category', 'label', 'lang', 'type', 'pattern', weight, true)`` per line; others skipped."""
    quoted = r"'([^']+)'"
    pattern = rf"^\s+\({', '.join([quoted] * 6)}, '((?:[^']|'')*)', ([0-9]+), true\)[,;]$"
    parts = [F.regexp_extract("value", pattern, i) for i in range(1, 9)]
    names = ["id", "version", "category", "label", "lang", "match_type"]
    return lines.filter(F.col("value").rlike(pattern)).select(
        *[p.alias(n) for p, n in zip(parts, names)],
        F.replace(parts[6], F.lit("''"), F.lit("'")).alias("pattern"),
        parts[7].cast("int").alias("weight"),
        F.lit(True).alias("enabled"),
    )


def enabled_rules(rules: DataFrame, version: str | None = None) -> DataFrame:
    """Enabled rules of one version, heaviest first."""
    kept = rules.filter("enabled")
    if version is not None:
        kept = kept.filter(F.col("version") == version)
    return kept.orderBy(F.desc("weight"), "id")


#: Rules that expressions may hold as literals; ``classify.literal_scores`` takes a table of any size.
MOST_LITERAL_RULES = 50_000


def rule_list(rules: DataFrame, limit: int = MOST_LITERAL_RULES) -> list[Rule]:
    """Rules as literals for expressions. A table of more than ``limit`` rows is refused, and no more than that is collected."""
    rows = rules.select("category", "match_type", "pattern", "weight").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules; use classify.literal_scores")
    return [Rule(r["category"], r["match_type"], r["pattern"], int(r["weight"])) for r in rows]


def category_order(names: list[str]) -> list[str]:
    """Known categories in priority order, then the others as first seen; legacy ones when there are no rules."""
    seen = list(dict.fromkeys(names))
    if not seen:
        return list(lx.LEGACY_CATEGORIES)
    rank = {c: i for i, c in enumerate(lx.CATEGORY_PRIORITY)}
    return sorted(seen, key=lambda c: (rank.get(c, len(rank) + seen.index(c)), c))


def categories(rules: DataFrame) -> DataFrame:
    """Distinct categories with their priority rank (unlisted ones after all listed)."""
    order = F.array(*[F.lit(c) for c in lx.CATEGORY_PRIORITY])
    rank = F.array_position(order, F.col("category"))
    return rules.select("category").distinct().withColumn(
        "priority",
        F.when(rank > 0, rank - 1).otherwise(F.lit(len(lx.CATEGORY_PRIORITY))).cast("bigint"),
    )


# kind -> (match type, weight, place in the generation order)
KINDS = {
    "keyword": ("keyword", 5, 0),
    "phrase": ("phrase", 7, 1),
    "weak": ("keyword", 3, 2),
    "regex": ("regex", 7, 3),
    "term": ("keyword", 5, 4),
}


def filled_templates(terms: DataFrame) -> DataFrame:
    """(category, label, lang, pattern, template_pos, pos): every different template filled with every different term.

    Equal texts fill in equal patterns, of which only the first by (template_pos, pos) can stay, so the first of
    the equal texts stands for all of them: copies never multiply each other.
    """
    scope = ["category", "lang"]
    pos = F.col("pos").cast("bigint")
    firsts = terms.filter("kind = 'term'").groupBy(*scope, "text").agg(F.min(F.struct(pos.alias("pos"), "label")).alias("f"))
    templates = (
        terms.filter("kind = 'template'")
        .groupBy(*scope, F.col("text").alias("template"))
        .agg(F.min(F.struct(pos.alias("pos"))).alias("t"))
    )
    pattern = F.replace("template", F.lit("{term}"), F.col("text"))
    return firsts.join(templates, scope).select(
        "category", "f.label", "lang", pattern.alias("pattern"), F.col("t.pos").alias("template_pos"), "f.pos"
    )


def generate_rules(terms: DataFrame, version: str) -> DataFrame:
    """Rules from term lists: category, label, lang, kind, pos, text.

    Every ``template`` is filled with every ``term`` of its category and language (``{term}`` is replaced).
    A pattern that repeats inside (category, lang, type) keeps its first place; ids that repeat get -2, -3, ...
    """
    base = ["category", "label", "lang"]
    plain = union_all(
        [
            terms.filter(F.col("kind") == kind).select(
                *base,
                F.lit(match_type).alias("match_type"),
                F.col("text").alias("pattern"),
                F.lit(weight).alias("weight"),
                F.lit(place).alias("place"),
                F.lit(0).cast("bigint").alias("template_pos"),
                F.col("pos").cast("bigint").alias("pos"),
            )
            for kind, (match_type, weight, place) in KINDS.items()
        ]
    )
    filled = filled_templates(terms).select(
        *base,
        F.lit("phrase").alias("match_type"),
        "pattern",
        F.lit(5).alias("weight"),
        F.lit(5).alias("place"),
        "template_pos",
        "pos",
    )
    order = [F.col("place"), F.col("template_pos"), F.col("pos")]
    # an aggregate: copies of a pattern go before the shuffle
    first = F.min(F.struct("place", "template_pos", "pos", "label", "pattern", "weight")).alias("f")
    rules = (
        plain.unionByName(filled)
        .groupBy("category", "lang", "match_type", F.lower("pattern").alias("__lower"))
        .agg(first)
        .select("category", "lang", "match_type", "f.*")
        .withColumn(
            "base_id",
            F.concat_ws("-", F.lit(version), "lang", "category", tx.rule_slug(F.col("pattern"))),
        )
        .withColumn("copy", F.row_number().over(Window.partitionBy("base_id").orderBy(*order)))
    )
    return rules.select(
        F.when(F.col("copy") > 1, F.concat_ws("-", "base_id", "copy")).otherwise(F.col("base_id")).alias("id"),
        F.lit(version).alias("version"),
        *base,
        "match_type",
        "pattern",
        "weight",
        F.lit(True).alias("enabled"),
    )


def rule_violations(
    rules: DataFrame, low: int = 100, high: int = 150, high_value: tuple[str, ...] = tuple(lx.HIGH_VALUE_REGEX_CATEGORIES)
) -> DataFrame:
    """(category, problem) for every category that breaks a rule-set requirement."""
    counts = rules.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lang") == "zh-CN").alias("zh"),
        F.count_if(F.col("lang") == "en-US").alias("en"),
        F.count_if(F.col("match_type") == "keyword").alias("keywords"),
        F.count_if(F.col("match_type") == "phrase").alias("phrases"),
        F.count_if(F.col("match_type") == "regex").alias("regexes"),
    )
    problems = F.array_compact(
        F.array(
            F.when(~F.col("n").between(low, high), "rule_count"),
            F.when((F.col("zh") == 0) | (F.col("en") == 0), "language"),
            F.when(F.col("keywords") == 0, "no_keyword"),
            F.when(F.col("phrases") == 0, "no_phrase"),
            F.when(F.col("category").isin(*high_value) & (F.col("regexes") == 0), "no_regex"),
        )
    )
    return counts.select("category", F.col("n").alias("rule_count"), F.explode(problems).alias("problem"))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category", "lang").agg(F.count(F.lit(1)).alias("rule_count"))
