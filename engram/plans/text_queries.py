"""Projections over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import metadata as md
from engram.functions import text as tx
from engram.plans import tables as tb
from engram.plans.registry import query

S = tb.sql_collapse


@query(
    "normalize_hash",
    f"""WITH {tb.MEM} SELECT id, sha256({tb.sql_norm('content')}) AS content_hash,
        CAST(length({tb.sql_norm('content')}) AS BIGINT) AS normalized_chars FROM mem""",
)
def normalize_hash(spark, sf):
    normalized = tx.normalized(F.col("content"))
    return tb.documents(spark, sf).select(
        "id", tx.content_hash(normalized).alias("content_hash"), F.length(normalized).cast("bigint").alias("normalized_chars")
    )


@query(
    "previews",
    f"""WITH {tb.MEM} SELECT id, {tb.sql_preview('content')} AS preview_220,
        {tb.sql_preview('content', 180)} AS preview_180 FROM mem""",
)
def previews(spark, sf):
    return tb.documents(spark, sf).select(
        "id",
        tx.preview(F.col("content")).alias("preview_220"),
        tx.preview(F.col("content"), 180).alias("preview_180"),
    )


@query(
    "head_tail_trim",
    f"""WITH {tb.MEM}, t AS (SELECT id, {tb.sql_trim('content')} AS c FROM mem)
    SELECT id, CAST(length(c) AS BIGINT) AS full_chars,
      sha256(CASE WHEN length(c) <= 1005 THEN c ELSE substring(c, 1, 603) || chr(10) || chr(10)
        || '[...content truncated...]' || chr(10) || chr(10) || substring(c, length(c) - 401, 402) END) AS kept_hash
    FROM t""",
)
def head_tail_trim(spark, sf):
    text = F.col("content")
    return tb.documents(spark, sf).select(
        "id",
        F.length(tx.trimmed(text)).cast("bigint").alias("full_chars"),
        F.sha2(tx.head_tail(text, 1005), 256).alias("kept_hash"),
    )


@query(
    "request_day_keys",
    """WITH z AS (SELECT event_id, ts, CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Asia/Shanghai'
          WHEN 2 THEN 'America/New_York' ELSE CASE WHEN event_id % 5 = 0 THEN 'Mars/Base' ELSE ' UTC ' END END AS tz FROM events),
      n AS (SELECT event_id, ts, CASE WHEN trim(tz) = '' THEN 'UTC' ELSE trim(tz) END AS tz FROM z)
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_key,
      strftime(ts + CASE tz WHEN 'Asia/Shanghai' THEN INTERVAL 8 HOUR WHEN 'America/New_York' THEN INTERVAL '-5' HOUR
        WHEN 'UTC' THEN INTERVAL 0 HOUR END, '%Y-%m-%d') || '@' || tz AS request_day_key,
      CASE WHEN tz = 'Mars/Base' THEN 'INVALID_TIMEZONE' END AS zone_error FROM n""",
)
def request_day_keys(spark, sf):
    user = F.col("user_id")
    zone = (
        F.when(user % 4 == 0, "").when(user % 4 == 1, "Asia/Shanghai").when(user % 4 == 2, "America/New_York")
    ).when(F.col("event_id") % 5 == 0, "Mars/Base").otherwise(" UTC ")
    return tb.events(spark, sf).select(
        "event_id",
        tx.day_key(F.col("ts")).alias("day_key"),
        tx.request_day_key(F.col("ts"), zone).alias("request_day_key"),
        tx.request_zone_error(zone).alias("zone_error"),
    )


@query(
    "metadata_picks",
    f"""WITH {tb.MEM}, j AS (SELECT *, CAST(metadata_json AS JSON) AS m FROM mem)
    SELECT id,
      nullif({S("m->>'title'")}, '') AS title,
      CASE WHEN json_type(m->'confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(m->>'confidence' AS DOUBLE) END AS confidence,
      CAST(m->>'evidenceCount' AS DOUBLE) AS evidence,
      CAST(round(10 * ((CAST(m->>'confidence' AS DOUBLE) * 10 + least(CAST(m->>'evidenceCount' AS DOUBLE), 5))
        * CASE WHEN memory_type = 'fact' THEN 1.2 ELSE 1.0 END + 0.2)) AS BIGINT) AS score_tenths
    FROM j""",
)
def metadata_picks(spark, sf):
    v = F.col("v")
    return (
        tb.documents(spark, sf)
        .withColumn("v", md.parsed(F.col("metadata_json")))
        .select(
            "id",
            md.string_of(v, ["label", "title"]).alias("title"),
            md.number_of(v, ["confidence", "score", "importance"]).alias("confidence"),
            md.number_of(v, ["evidenceCount", "evidence_count"]).alias("evidence"),
            F.round(md.memory_score(v, F.col("memory_type"), F.col("tags")) * 10).cast("bigint").alias("score_tenths"),
        )
    )


@query(
    "review_extract",
    f"""WITH {tb.SES}, j AS (SELECT id, CAST(metadata_json AS JSON) AS m FROM ses WHERE metadata_json IS NOT NULL)
    SELECT id, CASE WHEN m->>'correctness' IN ('correct', 'incorrect') THEN m->>'correctness' END AS correctness,
      CAST(m->>'edited' AS BOOLEAN) AS edited,
      CASE WHEN json_type(m->'edit_version') <> 'VARCHAR' THEN CAST(m->>'edit_version' AS BIGINT) END AS edit_version
    FROM j""",
)
def review_extract(spark, sf):
    review = md.review_of(md.parsed(F.col("metadata_json")))
    return (
        tb.sessions(spark, sf)
        .select("id", review.alias("r"))
        .filter("r is not null")
        .select("id", "r.correctness", "r.edited", "r.edit_version")
    )


_SENT = r"regexp_extract({x}, '^[^。.!?\n]*', 0)"


def _strip_label_sql(x: str) -> str:
    ws = lx.WS_CLASS
    return (
        f"regexp_replace({x}, '^[{ws}]*[A-Za-z0-9_{ws}\\x{{4e00}}-\\x{{9fff}}-]{{1,24}}[{ws}]*[:：][{ws}]*', '')"
    )


def _limit_sql(x: str, n: int) -> str:
    tail = "'[；，、。,.，:：;]+$'"
    text = f"regexp_replace({S(x)}, {tail}, '')"
    head = f"substring({text}, 1, {n})"
    mark = f"regexp_extract({head}, '(?s)^(.+[。！？.!?；;])', 1)"
    kept = f"CASE WHEN length({mark}) > 0 THEN {mark} ELSE {head} END"
    clean = f"trim(regexp_replace({kept}, {tail}, ''), ' ')"
    return (
        f"CASE WHEN length({text}) <= {n} THEN {text} WHEN length({clean}) > 0 THEN {clean} ELSE trim({head}, ' ') END"
    )


@query(
    "sentences",
    f"""WITH {tb.MEM} SELECT id,
      nullif(trim({_SENT.format(x=S('content'))}, ' '), '') AS first_sentence,
      sha256({_strip_label_sql('content')}) AS without_label_hash,
      {_limit_sql('content', 100)} AS limited
    FROM mem""",
)
def sentences(spark, sf):
    c = F.col("content")
    return tb.documents(spark, sf).select(
        "id",
        tx.first_sentence(c).alias("first_sentence"),
        F.sha2(tx.strip_label(c), 256).alias("without_label_hash"),
        tx.limit_text(c, 100).alias("limited"),
    )


@query(
    "lookup_keys",
    f"""WITH {tb.MEM} SELECT id,
      trim(regexp_replace(lower({tb.sql_trim('content')}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS lookup_key,
      'focus:' || coalesce(nullif(substring(trim(regexp_replace(lower({tb.sql_trim('content')}),
         '[^a-z0-9\\x{{4e00}}-\\x{{9fa5}}]+', '-', 'g'), '-'), 1, 40), ''), 'signal') AS discovery_id
    FROM mem""",
)
def lookup_keys(spark, sf):
    c = F.col("content")
    return tb.documents(spark, sf).select(
        "id", tx.lookup_key(c).alias("lookup_key"), tx.discovery_id("focus", c).alias("discovery_id")
    )


@query(
    "titles_and_scores",
    f"""WITH e AS (SELECT event_id, event_type, value, user_id,
        CASE user_id % 3 WHEN 0 THEN ' ' || event_type || ' happened!!' WHEN 1 THEN '  ' ELSE NULL END AS title,
        CASE event_type WHEN 'click' THEN ' Focus_Area ' WHEN 'view' THEN 'EMOTION' WHEN 'error' THEN 'emotion'
          WHEN 'purchase' THEN 'growth_signal' ELSE 'other' END AS dim FROM events),
      n AS (SELECT *, coalesce(substring(trim(title), 1, 1000), '') AS t, lower(trim(dim)) AS d FROM e)
    SELECT event_id, CASE WHEN d IN {tb.sql_list(lx.DIMENSIONS)} THEN d END AS dimension,
      CASE WHEN length(substring(regexp_replace(t, '[。.!！?？]+$', ''), 1, 24)) > 0
        THEN substring(regexp_replace(t, '[。.!！?？]+$', ''), 1, 24)
        ELSE substring(regexp_replace('Untitled note from events...', '[。.!！?？]+$', ''), 1, 12) END AS title,
      CASE WHEN length(substring(t, 1, 80)) > 0 THEN substring(t, 1, 80)
        ELSE substring('Untitled note from events...', 1, 20) END AS summary,
      CASE WHEN d = 'emotion' THEN CAST(least(10, greatest(1, floor(value / 10 + 0.5))) AS BIGINT) END AS score,
      least(1.0, greatest(0.0, value / 100)) AS confidence
    FROM n""",
)
def titles_and_scores(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id")
    title = F.when(user % 3 == 0, F.concat(F.lit(" "), kind, F.lit(" happened!!"))).when(user % 3 == 1, F.lit("  "))
    name = (
        F.when(kind == "click", " Focus_Area ")
        .when(kind == "view", "EMOTION")
        .when(kind == "error", "emotion")
        .when(kind == "purchase", "growth_signal")
        .otherwise("other")
    )
    fallback = F.lit("Untitled note from events...")
    dimension = tx.dimension_or_null(name)
    return tb.events(spark, sf).select(
        "event_id",
        dimension.alias("dimension"),
        tx.title_or(title, fallback).alias("title"),
        tx.summary_or(title, fallback).alias("summary"),
        tx.score_or_null((F.col("value") / 10).cast("string"), dimension).alias("score"),
        tx.confidence_or(F.col("value") / 100, 0.5).alias("confidence"),
    )


@query(
    "redaction",
    r"""SELECT page_id, regexp_replace(url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END
          || 'api_key=k' || CAST(page_id AS VARCHAR) || '&z=1', '([?&]api_key=)[^&#]*', '\1%5BREDACTED%5D', 'g') AS url,
      '[REDACTED]' AS authorization_header, CAST(page_id AS VARCHAR) AS request_header FROM pages""",
)
def redaction(spark, sf):
    key = F.col("page_id").cast("string")
    joiner = F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?")
    headers = tx.redact_map(F.create_map(F.lit("authorization"), key, F.lit("x-request"), key))
    return tb.table(spark, sf, "pages").select(
        "page_id",
        tx.redact_query(F.concat(F.col("url"), joiner, F.lit("api_key=k"), key, F.lit("&z=1"))).alias("url"),
        headers["authorization"].alias("authorization_header"),
        headers["x-request"].alias("request_header"),
    )


@query(
    "low_quality",
    f"""WITH {tb.MEM}, {tb.SES}, a AS (SELECT 'd' || id AS id, content FROM mem UNION ALL SELECT 'c' || id, content FROM ses)
    SELECT id FROM a WHERE length({tb.sql_trim('content')}) < 24
      OR regexp_matches(lower({tb.sql_trim('content')}), '^(ok|done|noted|received|收到|好的|完成|明白了)$', 'i')""",
)
def low_quality(spark, sf):
    from engram.operators.corpus import is_low_quality

    both = (
        tb.documents(spark, sf)
        .select(F.concat(F.lit("d"), "id").alias("id"), "content")
        .unionByName(tb.sessions(spark, sf).select(F.concat(F.lit("c"), "id").alias("id"), "content"))
    )
    return both.filter(is_low_quality(F.col("content"))).select("id")
