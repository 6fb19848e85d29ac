"""Day periods: budgets, grouping, caches, insights with evidence, and changes per dimension.

Long tables are used throughout: one row per insight, evidence or change, with explicit positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import metadata as md
from engram.functions import text as tx
from engram.operators.ranking import MAX_GROUP_ROWS, running, top_per_group

INSIGHTS_PER_DIMENSION = 3
EVIDENCE_PER_INSIGHT = 1
EVIDENCE_PER_CHANGE = 3
QUOTE_CHARS = 280
#: Quotes that are searched in a period's texts together, about.
QUOTES_AT_ONCE = 500
CACHE_DAYS = 30


def content_budget(
    memories: DataFrame,
    cap: int = lx.CONTENT_CAP,
    budget: int = lx.CONTENT_BUDGET,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Texts that fit the owner's budget in time order, cut head-and-tail where they are too long.

    A text costs its length after the per-text cut.  A row is kept while the rows before it cost less than the
    budget; the last kept one is cut to what is left.  Only ids and lengths are scanned in order; the texts join
    the kept ids afterwards.
    """
    key = ["owner_id", "created_at", "id"]
    sizes = memories.select(*key, tx.head_tail_length(F.col("content"), cap).alias("cost")).filter("cost > 0")
    summed = running(sizes, ["owner_id"], ["created_at", "id"], sums={"upto": "cost"}, max_group_rows=max_group_rows, sized_by=memories)
    kept = summed.withColumn("spent", F.col("upto") - F.col("cost")).filter(F.col("spent") < budget)
    limits = kept.select(*key, F.least(F.lit(cap), F.lit(budget) - F.col("spent")).cast("int").alias("cap"))
    return memories.join(limits, key).withColumn("text", tx.head_tail(F.col("content"), F.col("cap"))).drop("cap")


def period_bounds(day: Column, first: Column, last: Column) -> tuple[Column, Column]:
    known = day != "unknown-date"
    start = F.when(known, F.concat(day, F.lit("T00:00:00Z"))).otherwise(F.coalesce(first, F.lit("")))
    end = F.when(known, F.concat(day, F.lit("T23:59:59Z"))).otherwise(F.coalesce(last, F.lit("")))
    return start, end


def periods(budgeted: DataFrame) -> DataFrame:
    """One row per (owner, day) with its memories. The lists are bounded by the owner's content budget."""
    review = md.review_of(md.parsed(F.col("metadata_json")))
    memory = F.struct("created_at", "id", "text", review.alias("review"))
    day = tx.day_key(F.col("created_at"))
    grouped = budgeted.groupBy("owner_id", day.alias("day")).agg(
        F.sort_array(F.collect_list(memory)).alias("memories"),
        F.min("created_at").cast("string").alias("first"),
        F.max("created_at").cast("string").alias("last"),
    )
    start, end = period_bounds(F.col("day"), F.col("first"), F.col("last"))
    return grouped.select("owner_id", "day", start.alias("start"), end.alias("end"), "memories")


def is_cacheable(start: Column, end: Column, requested_start: Column, requested_end: Column, now: Column) -> Column:
    """A known day that the request covers and that is over."""
    s, e = start.try_cast("timestamp"), end.try_cast("timestamp")
    return F.coalesce((requested_start <= s) & (requested_end >= e) & (now > e), F.lit(False))


def day_ranges(requests: DataFrame) -> DataFrame:
    """UTC days of [start, end], clipped to it; a full day ends one millisecond before the next."""
    days = F.sequence(F.date_trunc("day", "start"), F.date_trunc("day", "end"), F.expr("INTERVAL 1 DAY"))
    exploded = requests.withColumn("d", F.explode(days))
    last = F.col("d") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.001 SECOND")
    return exploded.select(
        *[c for c in requests.columns if c not in ("start", "end")],
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        F.greatest("start", "d").alias("day_start"),
        F.least(F.col("end"), last).alias("day_end"),
    )


def uncached(days: DataFrame, cache: DataFrame, model: str | None, version: str, now: Column) -> DataFrame:
    """Days without a live cached summary. ``cache``: owner_id, day, model, cache_version, written_at."""
    if model is None:
        return days
    live = cache.filter(
        (F.col("model") == model)
        & (F.col("cache_version") == version)
        & (F.col("written_at") > now - F.make_dt_interval(days=F.lit(CACHE_DAYS)))
    )
    return days.join(live.select("owner_id", "day"), ["owner_id", "day"], "left_anti")


def count_in_ranges(
    ranges: DataFrame, memories: DataFrame, keys: list[str], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Memories per ``keys`` inside the ranges (owner_id, day_start, day_end), both ends included.

    Range ends are merged into the time line of their owner: the count of a range is the running count at its
    end minus that at its start.  No range is ever paired with the memories inside it.
    """
    start = F.struct(F.col("day_start").alias("t"), F.lit(0).alias("side"))
    end = F.struct(F.col("day_end").alias("t"), F.lit(2).alias("side"))
    marks = ranges.select("owner_id", *keys, F.explode(F.array(start, end)).alias("m")).select(
        "owner_id", *keys, "m.t", "m.side", F.lit(0).cast("bigint").alias("w")
    )
    rows = memories.select(
        "owner_id",
        *[F.lit(None).cast(dict(ranges.dtypes)[k]).alias(k) for k in keys],
        F.col("created_at").alias("t"),
        F.lit(1).alias("side"),
        F.lit(1).cast("bigint").alias("w"),
    )
    line = marks.unionByName(rows)
    # rows with the same time and side weigh the same, so their order does not matter
    summed = running(line, ["owner_id"], ["t", "side"], sums={"upto": "w"}, max_group_rows=max_group_rows)
    signed = F.when(F.col("side") == 2, F.col("upto")).when(F.col("side") == 0, -F.col("upto"))
    return summed.filter("side <> 1").groupBy(*keys).agg(F.sum(signed).cast("bigint").alias("count"))


def invalidated_days(changes: DataFrame) -> DataFrame:
    """(owner, day) whose cached summary a marked, edited or reverted message outdates."""
    day = tx.day_key(F.col("created_at"))
    return changes.select("owner_id", day.alias("day")).filter("day <> 'unknown-date'").distinct()


def day_overview(messages: DataFrame) -> DataFrame:
    """Per (owner, day): messages, how they were reviewed, how many were edited, and their characters.

    ``messages``: owner_id, day, content, correctness, edit_version.
    """
    number = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    return messages.groupBy("owner_id", "day").agg(
        F.count(F.lit(1)).cast("bigint").alias("messages"),
        number(F.col("correctness") == "correct").alias("correct"),
        number(F.col("correctness") == "incorrect").alias("incorrect"),
        number(F.col("edit_version") > 0).alias("edited"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("characters"),
    )


def without_invalidated(cache: DataFrame, changes: DataFrame) -> DataFrame:
    return cache.join(invalidated_days(changes), ["owner_id", "day"], "left_anti")


# --- insights -----------------------------------------------------------------


def repair_evidence(evidence: DataFrame, periods_: DataFrame) -> DataFrame:
    """Evidence with an id of its period: the given one if it exists there, else the first memory that holds
    the quote (or is held by it). Rows without a match are dropped. A quote is searched once for each period.

    ``evidence``: owner_id, day, key columns, raw_id, quote.
    """
    quote = F.substring(tx.plain_text(F.col("quote")), 1, QUOTE_CHARS)
    quoted = evidence.withColumns({"quote": quote, "raw_id": tx.plain_text(F.col("raw_id"))}).filter(F.length("quote") > 0)
    texts = periods_.select("owner_id", "day", F.explode("memories").alias("m")).select(
        "owner_id", "day", F.col("m.id").alias("raw_id"), F.lit(True).alias("known")
    )
    checked = quoted.join(texts, ["owner_id", "day", "raw_id"], "left")
    given = checked.filter("known").withColumn("evidence_id", F.col("raw_id"))
    # Quotes go to their period in lists of bounded size, and only the ids found come back: no row of a quote carries texts.
    per = ["owner_id", "day"]
    lost = checked.filter("known is null")
    asked = lost.select(*per, "quote").distinct()
    lists = F.ceil(F.count(F.lit(1)) / QUOTES_AT_ONCE).cast("int")
    dealt = asked.join(asked.groupBy(*per).agg(lists.alias("lists")), per)
    dealt = dealt.groupBy(*per, F.pmod(F.xxhash64("quote"), "lists").alias("list")).agg(F.collect_list("quote").alias("quotes"))

    def first_holder(quote: Column) -> Column:
        held = F.filter("memories", lambda m: F.contains(m["text"], quote) | F.contains(quote, m["text"]))
        return F.struct(quote.alias("quote"), F.get(held, F.lit(0))["id"].alias("evidence_id"))

    met = dealt.join(periods_.select(*per, "memories"), per).select(*per, F.inline_outer(F.transform("quotes", first_holder)))
    searched = lost.join(met.filter("evidence_id is not null"), [*per, "quote"])
    return given.unionByName(searched).drop("known")


def normalized_insights(insights: DataFrame, evidence: DataFrame, periods_: DataFrame) -> DataFrame:
    """Valid insights of every period, at most three per dimension, each with its first valid evidence.

    ``insights``: owner_id, day, insight_id, dimension, pos, title, summary; ``evidence``: owner_id, day,
    insight_id, epos, raw_id, quote.  Periods without insights stay, with nulls.
    """
    first = top_per_group(
        repair_evidence(evidence, periods_), ["owner_id", "day", "insight_id"], [F.asc("epos")], EVIDENCE_PER_INSIGHT
    ).select("owner_id", "day", "insight_id", "evidence_id", "quote")
    summary = tx.summary_or(F.col("summary"), F.col("quote"))
    valid = (
        insights.withColumn("dimension", tx.dimension_or_null(F.col("dimension")))
        .filter("dimension is not null")
        .join(first, ["owner_id", "day", "insight_id"])
        .withColumn("summary", summary)
        .filter(F.length("summary") > 0)
        .withColumn("title", tx.title_or(F.col("title"), F.col("summary")))
    )
    listed = top_per_group(valid, ["owner_id", "day", "dimension"], [F.asc("pos")], INSIGHTS_PER_DIMENSION, rank="place")
    return periods_.select("owner_id", "day", "start", "end").join(
        listed.select("owner_id", "day", "dimension", "place", "title", "summary", "evidence_id", "quote"),
        ["owner_id", "day"],
        "left",
    )


def cached_insights(summaries: DataFrame) -> DataFrame:
    """Cached insights (owner_id, day, dimension, pos, title, summary, evidence_id, quote), cleaned alike."""
    quote = F.substring(tx.plain_text(F.col("quote")), 1, QUOTE_CHARS)
    valid = (
        summaries.withColumns(
            {
                "dimension": tx.dimension_or_null(F.col("dimension")),
                "evidence_id": tx.plain_text(F.col("evidence_id")),
                "quote": quote,
            }
        )
        .filter((F.length("evidence_id") > 0) & (F.length("quote") > 0) & F.col("dimension").isNotNull())
        .withColumn("summary", tx.summary_or(F.col("summary"), F.col("quote")))
        .withColumn("title", tx.title_or(F.col("title"), F.col("summary")))
    )
    return top_per_group(valid, ["owner_id", "day", "dimension"], [F.asc("pos")], INSIGHTS_PER_DIMENSION, rank="place")


# --- changes ------------------------------------------------------------------


def local_changes(insights: DataFrame) -> DataFrame:
    """Every insight with evidence is a change of its dimension, in period order."""
    return insights.filter("evidence_id is not null").select(
        "owner_id",
        "dimension",
        tx.dimension_rank(F.col("dimension")).alias("dimension_rank"),
        "start",
        "end",
        "place",
        "title",
        "summary",
        "evidence_id",
        "quote",
    )


def dimension_summaries(changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per (owner, dimension): number of changes, and the first two non-empty summaries joined, at most 120."""
    keys = ["owner_id", "dimension"]
    order = order or ["start", "end", "place"]
    counts = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"))
    first = top_per_group(changes.filter(F.length("summary") > 0), keys, [F.asc(c) for c in order], 2, rank="n")
    texts = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "summary"))).alias("s"))
    joined = F.substring(F.array_join(F.transform("s", lambda x: x["summary"]), "；"), 1, 120)
    return counts.join(texts.select(*keys, joined.alias("summary")), keys, "left").withColumn(
        "summary", F.coalesce("summary", F.lit(""))
    )


def merged_changes(raw: DataFrame, source: DataFrame) -> DataFrame:
    """Changes proposed by a model, kept when they rest on known evidence.

    ``raw``: owner_id, change_id, dimension, title, summary, score, start, end, evidence_ids ARRAY<STRING>;
    ``source``: owner_id, evidence_id, quote (distinct).  At most three distinct ids per change.
    """
    ids = raw.select("owner_id", "change_id", F.posexplode("evidence_ids").alias("epos", "evidence_id")).withColumn(
        "evidence_id", tx.plain_text(F.col("evidence_id"))
    )
    first = ids.groupBy("owner_id", "change_id", "evidence_id").agg(F.min("epos").alias("epos"))
    known = first.join(source, ["owner_id", "evidence_id"])
    kept = top_per_group(known, ["owner_id", "change_id"], [F.asc("epos")], EVIDENCE_PER_CHANGE)
    listed = kept.groupBy("owner_id", "change_id").agg(
        F.sort_array(F.collect_list(F.struct("epos", "evidence_id", "quote"))).alias("e")
    )
    dimension = tx.dimension_or_null(F.col("dimension"))
    start, end = tx.plain_text(F.col("start")), tx.plain_text(F.col("end"))
    joined = (
        raw.drop("evidence_ids")
        .join(listed, ["owner_id", "change_id"])
        .withColumns({"dimension": dimension, "start": start, "end": end})
        .withColumn("title", tx.title_or(F.col("title"), F.get("e", F.lit(0))["quote"]))
        .filter((F.length("title") > 0) & (F.length("start") > 0) & (F.length("end") > 0) & F.col("dimension").isNotNull())
    )
    return joined.select(
        "owner_id",
        "change_id",
        "dimension",
        "start",
        "end",
        "title",
        tx.summary_or(F.col("summary"), F.col("title")).alias("summary"),
        tx.score_or_null(F.col("score"), F.col("dimension")).alias("score"),
        F.transform("e", lambda x: x["evidence_id"]).alias("evidence_ids"),
    )


def insight_counts(insights: DataFrame) -> DataFrame:
    """Per owner: periods and insights."""
    return insights.groupBy("owner_id").agg(
        F.countDistinct("day").alias("periods"), F.count("evidence_id").alias("insights")
    )
