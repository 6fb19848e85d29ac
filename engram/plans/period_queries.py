"""Period reports over conversations (owner = eight conversations) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators import periods as pd
from engram.plans import tables as tb
from engram.plans.registry import query


@query(
    "content_budget",
    f"""WITH {tb.MEM}, t AS (SELECT owner_id, id, created_at, {tb.sql_trim('content')} AS c FROM mem),
      l AS (SELECT *, CASE WHEN length(c) <= 12000 THEN length(c) ELSE 12029 END AS cost FROM t WHERE length(c) > 0),
      s AS (SELECT *, sum(cost) OVER (PARTITION BY owner_id ORDER BY created_at, id) - cost AS spent FROM l),
      k AS (SELECT *, CAST(least(12000, 60000 - spent) AS BIGINT) AS cap FROM s WHERE spent < 60000)
    SELECT owner_id, id, sha256(CASE WHEN length(c) <= cap THEN c ELSE substring(c, 1, cap * 6 // 10) || chr(10) || chr(10)
      || '[...content truncated...]' || chr(10) || chr(10) || substring(c, length(c) - (cap - cap * 6 // 10) + 1) END) AS text_hash FROM k""",
)
def content_budget(spark, sf):
    return pd.content_budget(tb.documents(spark, sf)).select("owner_id", "id", F.sha2("text", 256).alias("text_hash"))


_PERIOD = f"""{tb.SES}, live AS (SELECT *, {tb.sql_trim('content')} AS text, strftime(created_at, '%Y-%m-%d') AS day FROM ses
  WHERE NOT coalesce(metadata_json LIKE '%"correctness":"incorrect"%', false) AND length({tb.sql_trim('content')}) > 0)"""


def _periods(spark, sf):
    from engram.sources.memories import reviewed_incorrect

    return pd.periods(pd.content_budget(tb.sessions(spark, sf).filter(~reviewed_incorrect())))


@query(
    "period_grouping",
    f"""WITH {_PERIOD} SELECT owner_id, day, day || 'T00:00:00Z' AS "start", day || 'T23:59:59Z' AS "end", string_agg(id, ',' ORDER BY created_at, id) AS ids,
      CAST(sum(length(text)) AS BIGINT) AS chars, count_if(metadata_json IS NOT NULL) AS reviewed,
      TIMESTAMP '2024-01-02' <= CAST(day AS TIMESTAMP) AND TIMESTAMP '2024-01-07' >= CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND
        AND TIMESTAMP '2024-01-05' > CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND AS cacheable
    FROM live GROUP BY owner_id, day""",
)
def period_grouping(spark, sf):
    def at(s):
        return F.lit(s).cast("timestamp")

    chars = F.aggregate(F.transform("memories", lambda m: F.length(m["text"])), F.lit(0), lambda a, x: a + x)
    return _periods(spark, sf).select(
        "owner_id",
        "day",
        "start",
        "end",
        F.array_join(F.transform("memories", lambda m: m["id"]), ",").alias("ids"),
        chars.cast("bigint").alias("chars"),
        F.size(F.filter("memories", lambda m: m["review"].isNotNull())).cast("bigint").alias("reviewed"),
        pd.is_cacheable(
            F.col("start"), F.col("end"), at("2024-01-02 00:00:00"), at("2024-01-07 00:00:00"), at("2024-01-05 00:00:00")
        ).alias("cacheable"),
    )


_RANGES = """q AS (SELECT user_id AS owner_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1),
d AS (SELECT owner_id, s, e, unnest(generate_series(date_trunc('day', s), date_trunc('day', e), INTERVAL 1 DAY)) AS d FROM q),
days AS (SELECT owner_id, strftime(d, '%Y-%m-%d') AS day, greatest(s, d) AS a, least(e, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND) AS b FROM d)"""
_F = "'%Y-%m-%d %H:%M:%S.%f'"


def _ranges(spark, sf):
    e = tb.events(spark, sf).groupBy(F.col("user_id").alias("owner_id")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return pd.day_ranges(e)


@query(
    "day_split",
    f"WITH {_RANGES} SELECT owner_id, day, strftime(a, {_F}) AS day_start, strftime(b, {_F}) AS day_end FROM days",
)
def day_split(spark, sf):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return _ranges(spark, sf).withColumns({c: F.date_format(c, fmt) for c in ("day_start", "day_end")})


_CACHE = """cache AS (SELECT DISTINCT user_id AS owner_id, strftime(ts, '%Y-%m-%d') AS day FROM events
  WHERE event_type = 'purchase' AND event_id % 3 <> 0 AND ts > TIMESTAMP '2024-02-05' - INTERVAL 30 DAY)"""


def _cache(spark, sf):
    e = tb.events(spark, sf).filter("event_type = 'purchase'")
    return e.select(
        F.col("user_id").alias("owner_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_id") % 3 == 0, "old").otherwise("m1").alias("model"),
        F.lit("v1").alias("cache_version"),
        F.col("ts").alias("written_at"),
    )


def _uncached(spark, sf):
    return pd.uncached(_ranges(spark, sf), _cache(spark, sf), "m1", "v1", F.lit("2024-02-05 00:00:00").cast("timestamp"))


@query(
    "uncached_days",
    f"WITH {_RANGES}, {_CACHE} SELECT owner_id, day FROM days WHERE (owner_id, day) NOT IN (SELECT (owner_id, day) FROM cache)",
)
def uncached_days(spark, sf):
    return _uncached(spark, sf).select("owner_id", "day")


@query(
    "uncached_memory_count",
    f"""WITH {_RANGES}, {_CACHE}, u AS (SELECT * FROM days WHERE (owner_id, day) NOT IN (SELECT (owner_id, day) FROM cache))
    SELECT u.owner_id, u.day, count(e.event_id) AS "count" FROM u LEFT JOIN events e ON e.user_id = u.owner_id AND e.ts BETWEEN u.a AND u.b
    GROUP BY ALL""",
)
def uncached_memory_count(spark, sf):
    memories = tb.events(spark, sf).select(F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at"))
    ranges = _uncached(spark, sf).withColumn("request_owner", F.col("owner_id"))
    counted = pd.count_in_ranges(ranges, memories, ["request_owner", "day"])
    return counted.withColumnRenamed("request_owner", "owner_id")


@query(
    "cache_invalidation",
    f"""WITH {_CACHE}, ch AS (SELECT DISTINCT user_id AS owner_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error')
    SELECT owner_id, day FROM cache WHERE (owner_id, day) NOT IN (SELECT (owner_id, day) FROM ch)""",
)
def cache_invalidation(spark, sf):
    cache = _cache(spark, sf).filter("model = 'm1' and written_at > timestamp'2024-01-06'").select("owner_id", "day").distinct()
    changes = tb.events(spark, sf).filter("event_type = 'error'").select(
        F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at")
    )
    return pd.without_invalidated(cache, changes)


# Insights as a model would return them: one per turn, some with wrong ids, quotes or dimensions.
_RAW = f"""raw AS (SELECT owner_id, strftime(created_at, '%Y-%m-%d') AS day, id AS insight_id, turn AS pos,
   [{", ".join(f"' {d.upper()} '" for d in lx.DIMENSIONS)}, 'other'][turn % 6 + 1] AS dim,
   CASE turn % 3 WHEN 0 THEN ' Note ' || id || '!!' WHEN 1 THEN '' ELSE NULL END AS title,
   CASE turn % 4 WHEN 0 THEN '' ELSE 'Summary of turn ' || CAST(turn AS VARCHAR) END AS summary,
   CASE turn % 3 WHEN 0 THEN id WHEN 1 THEN 'bogus' ELSE NULL END AS raw_id,
   CASE turn % 5 WHEN 4 THEN 'not in any text' ELSE substring(content, 12, 30) END AS quote FROM ses)"""
_NORMAL = f"""{_PERIOD}, {_RAW}, q AS (SELECT *, substring({tb.sql_trim("coalesce(quote, '')")}, 1, 280) AS qt FROM raw),
f AS (SELECT q.*, coalesce((SELECT l.id FROM live l WHERE l.owner_id = q.owner_id AND l.day = q.day AND l.id = q.raw_id),
   (SELECT arg_min(l.id, (l.created_at, l.id)) FROM live l WHERE l.owner_id = q.owner_id AND l.day = q.day
     AND (contains(l.text, q.qt) OR contains(q.qt, l.text)))) AS evidence_id FROM q WHERE length(qt) > 0),
n AS (SELECT owner_id, day, insight_id, pos, lower(trim(dim)) AS dimension, qt AS quote, evidence_id,
   CASE WHEN length(trim(coalesce(summary, ''))) > 0 THEN substring(trim(summary), 1, 80) ELSE substring(qt, 1, 20) END AS summary,
   regexp_replace(trim(coalesce(title, '')), '[。.!！?？]+$', '') AS t FROM f WHERE evidence_id IS NOT NULL),
o AS (SELECT *, CASE WHEN length(t) > 0 THEN substring(t, 1, 24) ELSE substring(regexp_replace(summary, '[。.!！?？]+$', ''), 1, 12) END AS title,
   row_number() OVER (PARTITION BY owner_id, day, dimension ORDER BY pos) AS place FROM n WHERE dimension IN {tb.sql_list(lx.DIMENSIONS)}),
ins AS (SELECT * FROM o WHERE place <= 3),
per AS (SELECT DISTINCT owner_id, day FROM live)"""


def _raw(spark, sf):
    turn = F.col("turn")
    names = F.array(*[F.lit(f" {d.upper()} ") for d in lx.DIMENSIONS], F.lit("other"))
    return tb.sessions(spark, sf).select(
        "owner_id",
        tx.day_key(F.col("created_at")).alias("day"),
        F.col("id").alias("insight_id"),
        turn.alias("pos"),
        F.get(names, (turn % 6).cast("int")).alias("dimension"),
        F.when(turn % 3 == 0, F.concat(F.lit(" Note "), "id", F.lit("!!"))).when(turn % 3 == 1, "").alias("title"),
        F.when(turn % 4 == 0, "").otherwise(F.concat(F.lit("Summary of turn "), turn.cast("string"))).alias("summary"),
        F.when(turn % 3 == 0, F.col("id")).when(turn % 3 == 1, "bogus").alias("raw_id"),
        F.when(turn % 5 == 4, "not in any text").otherwise(F.substring("content", 12, 30)).alias("quote"),
    )


def _insights(spark, sf):
    raw = _raw(spark, sf)
    evidence = raw.select("owner_id", "day", "insight_id", F.lit(0).alias("epos"), "raw_id", "quote")
    return pd.normalized_insights(raw.drop("raw_id", "quote"), evidence, _periods(spark, sf))


@query("quote_repair", f"WITH {_NORMAL} SELECT owner_id, day, insight_id, evidence_id, quote FROM n")
def quote_repair(spark, sf):
    evidence = _raw(spark, sf).select("owner_id", "day", "insight_id", "raw_id", "quote")
    return pd.repair_evidence(evidence, _periods(spark, sf)).drop("raw_id")


@query(
    "period_insights",
    f"""WITH {_NORMAL} SELECT per.owner_id, per.day, dimension, place, title, summary, evidence_id, quote FROM per LEFT JOIN ins USING (owner_id, day)""",
)
def period_insights(spark, sf):
    return _insights(spark, sf).drop("start", "end")


@query(
    "change_groups",
    f"""WITH {_NORMAL}, s AS (SELECT owner_id, dimension, string_agg(summary, '；' ORDER BY day, place) AS summary FROM (SELECT *, row_number() OVER
        (PARTITION BY owner_id, dimension ORDER BY day, place) AS r FROM ins WHERE length(summary) > 0) WHERE r <= 2 GROUP BY ALL)
    SELECT owner_id, dimension, count(*) AS changes, substring(any_value(s.summary), 1, 120) AS summary FROM ins JOIN s USING (owner_id, dimension) GROUP BY ALL""",
)
def change_groups(spark, sf):
    return pd.dimension_summaries(pd.local_changes(_insights(spark, sf)))


@query(
    "insight_counts",
    f"""WITH {_NORMAL} SELECT owner_id, count(DISTINCT day) AS periods, count(evidence_id) AS insights FROM per LEFT JOIN ins USING (owner_id, day) GROUP BY 1""",
)
def insight_counts(spark, sf):
    return pd.insight_counts(_insights(spark, sf))


@query(
    "cached_insights",
    f"""WITH {tb.SES}, {_RAW}, c AS (SELECT *, substring({tb.sql_trim("coalesce(quote, '')")}, 1, 280) AS qt, lower(trim(dim)) AS dimension,
       coalesce(raw_id, '') AS eid, regexp_replace(trim(coalesce(title, '')), '[。.!！?？]+$', '') AS t FROM raw),
      v AS (SELECT *, CASE WHEN length(trim(summary)) > 0 THEN substring(trim(summary), 1, 80) ELSE substring(qt, 1, 20) END AS sm,
        row_number() OVER (PARTITION BY owner_id, day, dimension ORDER BY pos) AS place
        FROM c WHERE eid <> '' AND qt <> '' AND dimension IN {tb.sql_list(lx.DIMENSIONS)})
    SELECT owner_id, day, dimension, place, eid AS evidence_id, sm AS summary,
      CASE WHEN length(t) > 0 THEN substring(t, 1, 24) ELSE substring(regexp_replace(sm, '[。.!！?？]+$', ''), 1, 12) END AS title FROM v WHERE place <= 3""",
)
def cached_insights(spark, sf):
    raw = _raw(spark, sf).withColumnRenamed("raw_id", "evidence_id")
    return pd.cached_insights(raw).select("owner_id", "day", "dimension", "place", "evidence_id", "summary", "title")


@query(
    "merged_changes",
    f"""WITH e AS (SELECT *, ['Emotion', 'focus_area', ' GROWTH_signal', 'nope'][event_id % 4 + 1] AS dim,
        [CAST(event_id - 1 AS VARCHAR), ' ' || CAST(event_id - 2 AS VARCHAR), CAST(event_id - 1 AS VARCHAR), CAST(event_id - 3 AS VARCHAR), CAST(event_id AS VARCHAR)] AS ids FROM events),
      src AS (SELECT user_id, CAST(event_id AS VARCHAR) AS evidence_id, event_type || ' number ' || CAST(event_id AS VARCHAR) || '.' AS quote FROM events),
      x AS (SELECT user_id, event_id, trim(unnest(ids)) AS evidence_id, generate_subscripts(ids, 1) AS p FROM e),
      d AS (SELECT user_id, event_id, evidence_id, min(p) AS p FROM x GROUP BY ALL),
      k AS (SELECT d.*, src.quote, row_number() OVER (PARTITION BY d.user_id, d.event_id ORDER BY p) AS r FROM d JOIN src USING (user_id, evidence_id)),
      g AS (SELECT user_id, event_id, string_agg(evidence_id, ',' ORDER BY p) AS evidence_ids, arg_min(quote, p) AS q FROM k WHERE r <= 3 GROUP BY ALL),
      j AS (SELECT e.*, g.evidence_ids, CASE WHEN event_id % 3 = 0 THEN substring(regexp_replace(event_type || ' change?!', '[。.!！?？]+$', ''), 1, 24)
        ELSE substring(regexp_replace(q, '[。.!！?？]+$', ''), 1, 12) END AS title FROM e JOIN g USING (user_id, event_id))
    SELECT user_id AS owner_id, event_id AS change_id, lower(trim(dim)) AS dimension, title, CASE WHEN event_id % 2 = 0 THEN 'changed' ELSE substring(title, 1, 20) END AS summary,
      CASE WHEN lower(trim(dim)) = 'emotion' AND event_id % 8 <> 0 THEN CAST(least(10, greatest(1, floor(value / 20 + 0.5))) AS BIGINT) END AS score, evidence_ids
    FROM j WHERE event_id % 4 <> 3 AND event_id % 7 <> 0""",
)
def merged_changes(spark, sf):
    key = F.col("event_id")

    def back(n: int):
        return (key - n).cast("string")

    e = tb.events(spark, sf)
    raw = e.select(
        F.col("user_id").alias("owner_id"),
        key.alias("change_id"),
        F.get(F.array(F.lit("Emotion"), F.lit("focus_area"), F.lit(" GROWTH_signal"), F.lit("nope")), (key % 4).cast("int")).alias("dimension"),
        F.when(key % 3 == 0, F.concat("event_type", F.lit(" change?!"))).alias("title"),
        F.when(key % 2 == 0, "changed").alias("summary"),
        F.when(key % 8 != 0, (F.col("value") / 20).cast("string")).otherwise("high").alias("score"),
        F.when(key % 7 != 0, "2024-01-01").otherwise("  ").alias("start"),
        F.lit("2024-01-02").alias("end"),
        F.array(back(1), F.concat(F.lit(" "), back(2)), back(1), back(3), back(0)).alias("evidence_ids"),
    )
    source = e.select(
        F.col("user_id").alias("owner_id"),
        key.cast("string").alias("evidence_id"),
        F.concat("event_type", F.lit(" number "), key.cast("string"), F.lit(".")).alias("quote"),
    )
    return pd.merged_changes(raw, source).select(
        "owner_id", "change_id", "dimension", "title", "summary", "score", F.array_join("evidence_ids", ",").alias("evidence_ids")
    )
