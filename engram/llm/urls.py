"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

The trees learn from all URLs that rules judge and see the spelling of a URL only: lengths, depth, digits, entropy, parameters,
and how often judged URLs with the same host endings are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.boosting import fit
from engram.llm.store import save

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where the URL is null or has no ``://``."""
    mark = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(size > 0, bits).otherwise(0.0)


def _endings(host: Column) -> tuple[Column, Column]:
    """Last label of a host, and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def _features(url: Column, host: Column, path: Column) -> list[Column]:
    size = F.greatest(F.length(url), F.lit(1))
    return [
        F.length(url).cast("double"),
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        _count(path, "/[^/]"),
        _count(host, r"\."),
        _count(url, "[0-9]") / size,
        _count(host, "[0-9-]"),
        _entropy(url),
        _entropy(host),
        _count(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&]+"),
        F.contains(url, F.lit("#")).cast("double"),
        F.startswith(url, F.lit("https")).cast("double"),
        F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
        F.endswith(path, F.lit("/")).cast("double"),
    ]


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of a block by the trees) of every row.

    A null URL counts as empty. Without any judged URL the trees say allow; with one kind of verdict only, that one.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    one, two = _endings(F.col("host"))
    rows = rows.withColumns({"rule": rule, "said": verdict, "one": one, "two": two})
    rows = save(rows.withColumn("lexical", F.array(*_features(F.col("url"), F.col("host"), F.col("path")))).drop("url"))
    label = (F.col("said") == "block").cast("double")
    judged = rows.filter("rule is not null").select("one", "two", label.alias("label"))
    for name in ("one", "two"):
        # as many endings as the judged URLs have: Spark broadcasts them where they are few
        known = judged.groupBy(name).agg(
            ((F.sum("label") + 0.5) / (F.count("*") + 1)).alias(f"{name}_rate"), F.log1p(F.count("*").cast("double")).alias(f"{name}_seen")
        )
        rows = rows.join(save(known), name, "left")
    ending = [F.coalesce(f"{n}_rate", F.lit(0.5)) for n in ("one", "two")] + [F.coalesce(f"{n}_seen", F.lit(0.0)) for n in ("one", "two")]
    rows = save(rows.select("page_id", "host", "path", "rule", "said", F.concat("lexical", F.array(*ending)).alias("features")))
    training = rows.filter("rule is not null").select("features", label.alias("label"))
    scored = fit(training, F.lit(0), calibrate=False, parts=None)(rows)
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
