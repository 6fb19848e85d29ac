"""Evidence and report checks and repairs, with events standing in for proposals: owner = user, memory = event."""

from __future__ import annotations

from pyspark.sql import functions as F


from engram.operators import validate as va
from engram.plans import tables as tb
from engram.plans.registry import query

def _key():
    return F.col("event_id")


def _events(spark, sf):
    return tb.events(spark, sf).withColumns({"owner_id": F.col("user_id"), "id": _key().cast("string"), "pos": _key()})


def _memories(spark, sf):
    """Every event but each ninth is a known memory."""
    return _events(spark, sf).filter(_key() % 9 != 0).select("owner_id", "id")


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _ids():
    return F.array(F.col("id"), F.lit("zz"), F.lit(" "), (_key() - 1).cast("string"), F.col("id"))


_MEM = "known AS (SELECT user_id AS owner_id, event_id AS mid, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 9 <> 0)"
# first six non-blank ids are: own id, zz, previous id, own id again
_VALID = f"""{_MEM}, v AS (SELECT e.*, e.user_id AS owner_id, list_concat(CASE WHEN event_id % 9 <> 0 THEN [CAST(event_id AS VARCHAR)] ELSE [] END,
   CASE WHEN k.mid IS NOT NULL THEN [k.id] ELSE [] END) AS valid FROM events e LEFT JOIN known k ON k.owner_id = e.user_id AND k.mid = e.event_id - 1)"""


@query(
    "evidence_validation",
    f"""WITH {_MEM}, r AS (SELECT user_id AS owner_id, event_type, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'x' || CAST(event_id AS VARCHAR)
        ELSE CAST(event_id AS VARCHAR) END AS id FROM events),
      c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, event_type ORDER BY pos) AS n FROM r) WHERE n <= 6)
    SELECT c.owner_id, c.event_type, c.pos, c.id, k.mid IS NOT NULL AS valid FROM c LEFT JOIN known k ON k.owner_id = c.owner_id AND k.id = c.id""",
)
def evidence_validation(spark, sf):
    return va.check_evidence(_refs(spark, sf), _memories(spark, sf), ["owner_id", "event_type"])


def _refs(spark, sf):
    ref = F.when(_key() % 4 == 0, F.concat(F.lit("x"), "id")).otherwise(F.concat(F.lit(" "), "id"))
    return _events(spark, sf).select("owner_id", "event_type", "pos", ref.alias("id"))


@query(
    "unknown_evidence",
    f"""WITH {_MEM}, r AS (SELECT user_id AS owner_id, event_type, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'x' || CAST(event_id AS VARCHAR)
        ELSE CAST(event_id AS VARCHAR) END AS id FROM events),
      c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, event_type ORDER BY pos) AS n FROM r) WHERE n <= 6),
      u AS (SELECT owner_id, id, min(pos) AS pos FROM c WHERE (owner_id, id) NOT IN (SELECT (owner_id, id) FROM known) GROUP BY ALL)
    SELECT owner_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY pos, id) AS place FROM u) WHERE place <= 12""",
)
def unknown_evidence(spark, sf):
    return va.unknown_ids(va.check_evidence(_refs(spark, sf), _memories(spark, sf), ["owner_id", "event_type"]))


@query(
    "repair_diagnostics",
    f"""WITH {_MEM}, r AS (SELECT user_id AS owner_id, event_type, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'x' || CAST(event_id AS VARCHAR)
        ELSE CAST(event_id AS VARCHAR) END AS id FROM events),
      c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, event_type ORDER BY pos) AS n FROM r) WHERE n <= 6),
      b AS (SELECT * FROM c WHERE (owner_id, id) NOT IN (SELECT (owner_id, id) FROM known)),
      u AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY pos, id) AS place FROM (SELECT owner_id, id, min(pos) AS pos FROM b GROUP BY ALL)),
      l AS (SELECT owner_id, string_agg(id, ',' ORDER BY place) AS invalid_ids FROM u WHERE place <= 12 GROUP BY 1),
      k AS (SELECT owner_id, count(DISTINCT event_type) AS n FROM b GROUP BY 1 UNION ALL SELECT user_id, sum(CASE event_id % 50 WHEN 1 THEN event_id % 3 ELSE 0 END) FROM events GROUP BY 1)
    SELECT owner_id, CAST(sum(n) AS BIGINT) AS repair_count, coalesce(any_value(invalid_ids), '') AS invalid_ids FROM k LEFT JOIN l USING (owner_id) GROUP BY 1""",
)
def repair_diagnostics(spark, sf):
    checked = va.check_evidence(_refs(spark, sf), _memories(spark, sf), ["owner_id", "event_type"])
    repaired = F.when(_key() % 50 == 1, _key() % 3).otherwise(0).cast("bigint")
    others = _events(spark, sf).select("owner_id", repaired.alias("repaired"))
    found = va.repair_diagnostics(checked, ["owner_id", "event_type"], others)
    return found.withColumn("invalid_ids", F.array_join("invalid_ids", ","))


_THEME_NAMES = ("Graph  Sync", "graph-sync", "the", "", "Night shift")


@query(
    "repair_themes",
    f"""WITH p AS (SELECT user_id AS owner_id, event_id AS pos, [{", ".join(repr(x) for x in _THEME_NAMES)}][event_id % 5 + 1] AS name,
        CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS n,
        CASE WHEN event_id % 3 = 0 THEN ' text ' || CAST(event_id AS VARCHAR) ELSE '  ' END AS description FROM events WHERE user_id % 6 <> 0),
      k AS (SELECT *, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM p),
      ok AS (SELECT * FROM k WHERE key <> '' AND key <> 'the'),
      f AS (SELECT DISTINCT user_id AS owner_id, 'graph sync' AS key, CAST(7 AS BIGINT) AS fn, 'own words' AS ft FROM events WHERE user_id % 2 = 0),
      l AS (SELECT owner_id, key, max(pos) AS lp, min(pos) AS fp FROM ok GROUP BY ALL),
      r AS (SELECT ok.owner_id, ok.name, CASE WHEN n > 0 THEN n ELSE coalesce(fn, 1) END AS n,
        coalesce(nullif(trim(description), ''), ft, 'Recurring signal around ' || name || '.') AS description,
        row_number() OVER (PARTITION BY ok.owner_id ORDER BY fp) AS place FROM l JOIN ok ON ok.owner_id = l.owner_id AND ok.pos = l.lp AND ok.key = l.key
        LEFT JOIN f ON f.owner_id = ok.owner_id AND f.key = ok.key)
    SELECT * FROM r WHERE place <= 8 UNION ALL SELECT owner_id, 'Graph sync', fn, ft, 1 FROM f WHERE owner_id NOT IN (SELECT owner_id FROM r)""",
)
def repair_themes(spark, sf):
    e = _events(spark, sf)
    proposed = e.filter(F.col("user_id") % 6 != 0).select(
        "owner_id",
        "pos",
        _pick(_THEME_NAMES, _key() % 5).alias("name"),
        F.when(_key() % 2 == 0, F.floor("value").cast("bigint")).otherwise(-1).alias("n"),
        F.when(_key() % 3 == 0, F.concat(F.lit(" text "), "id")).otherwise("  ").alias("description"),
    )
    fallback = e.filter(F.col("user_id") % 2 == 0).select("owner_id").distinct().select(
        "owner_id",
        F.lit(1).cast("bigint").alias("place"),
        F.lit("Graph sync").alias("name"),
        F.lit(7).cast("bigint").alias("n"),
        F.lit("own words").alias("description"),
    )
    return va.repair_themes(proposed, fallback)


_LABELS = ("Alpha Team", "alpha-team", "User", "Beta", "")
_MERGED = """ids AS (SELECT owner_id, kind, key, x, min(pos * 10 + i) AS o FROM (SELECT owner_id, kind, key, pos, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM it) GROUP BY ALL),
  idl AS (SELECT owner_id, kind, key, string_agg(x, ',' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, kind, key ORDER BY o) AS r FROM ids) WHERE r <= 6 GROUP BY ALL)"""


@query(
    "repair_entities",
    f"""WITH {_VALID}, p AS (SELECT owner_id, event_type AS kind, event_id AS pos, [{", ".join(repr(x) for x in _LABELS)}][event_id % 5 + 1] AS label,
        CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS cnt, valid FROM v),
      k AS (SELECT *, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM p WHERE label NOT IN ('', 'User')),
      f AS (SELECT DISTINCT user_id AS owner_id, event_type AS kind, 'beta' AS key, CAST(3 AS BIGINT) AS fc, ['f1', 'f2'] AS fi FROM events),
      it AS (SELECT k.*, fc, CASE WHEN len(valid) > 0 THEN valid ELSE coalesce(fi, []) END AS ids FROM k LEFT JOIN f USING (owner_id, kind, key)
        WHERE len(valid) > 0 OR fi IS NOT NULL),
      m AS (SELECT owner_id, kind, key, min(pos) AS fp, arg_min(label, pos) AS label, max(CASE WHEN cnt > 0 THEN cnt ELSE coalesce(fc, len(ids)) END) AS cnt
        FROM it GROUP BY ALL), {_MERGED},
      r AS (SELECT m.owner_id, m.kind, label, cnt, evidence, row_number() OVER (PARTITION BY m.owner_id, m.kind ORDER BY fp) AS place FROM m JOIN idl USING (owner_id, kind, key))
    SELECT owner_id, kind, place, label, CAST(cnt AS BIGINT) AS "count", evidence FROM r
    UNION ALL SELECT owner_id, kind, 1, 'Beta', fc, 'f1,f2' FROM f WHERE (owner_id, kind) NOT IN (SELECT (owner_id, kind) FROM r)""",
)
def repair_entities(spark, sf):
    e = _events(spark, sf)
    proposed = e.select(
        "owner_id",
        F.col("event_type").alias("kind"),
        "pos",
        _pick(_LABELS, _key() % 5).alias("label"),
        F.when(_key() % 2 == 0, F.floor("value").cast("bigint")).otherwise(0).alias("count"),
        _ids().alias("evidence"),
    )
    fallback = e.select("owner_id", F.col("event_type").alias("kind")).distinct().select(
        "*",
        F.lit(1).cast("bigint").alias("place"),
        F.lit("Beta").alias("label"),
        F.lit(3).cast("bigint").alias("count"),
        F.array(F.lit("f1"), F.lit("f2")).alias("evidence"),
    )
    return va.repair_entities(proposed, fallback, _memories(spark, sf)).withColumn("evidence", F.array_join("evidence", ","))


@query(
    "repair_relations",
    f"""WITH {_VALID}, k AS (SELECT owner_id, event_id AS pos, 'user' AS source, event_type AS relation, ['Bo Li', 'bo-li', '', 'Al'][event_id % 4 + 1] AS target,
        CASE WHEN event_id % 3 = 0 THEN value / 100 END AS conf, valid, 'said ' || CAST(event_id AS VARCHAR) AS excerpt FROM v),
      it AS (SELECT *, relation AS kind, trim(regexp_replace(lower(target), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key, valid AS ids,
        least(1.0, greatest(0.0, coalesce(conf, 0.5))) AS c FROM k WHERE target <> '' AND len(valid) > 0),
      m AS (SELECT owner_id, kind, key, min(pos) AS fp, arg_min(target, pos) AS target, max(c) AS confidence FROM it GROUP BY ALL), {_MERGED},
      ex AS (SELECT owner_id, kind, key, string_agg(excerpt, ',' ORDER BY pos) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, kind, key ORDER BY pos) AS r FROM it)
        WHERE r <= 4 GROUP BY ALL)
    SELECT m.owner_id, 'user' AS source, m.kind AS relation, target, confidence, evidence, excerpts, row_number() OVER (PARTITION BY m.owner_id ORDER BY fp) AS place
    FROM m JOIN idl USING (owner_id, kind, key) JOIN ex USING (owner_id, kind, key)""",
)
def repair_relations(spark, sf):
    e = _events(spark, sf)
    proposed = e.select(
        "owner_id",
        "pos",
        F.lit(" user ").alias("source"),
        F.col("event_type").alias("relation"),
        _pick(("Bo Li", "bo-li", "", "Al"), _key() % 4).alias("target"),
        F.when(_key() % 3 == 0, F.col("value") / 100).alias("confidence"),
        _ids().alias("evidence"),
        F.array(F.lit(" "), F.concat(F.lit("said "), "id")).alias("excerpts"),
    )
    empty = proposed.filter("false").select(
        "owner_id", F.lit(1).cast("bigint").alias("place"), "source", "relation", "target", "confidence", "evidence", "excerpts"
    )
    repaired = va.repair_relations(proposed, empty, _memories(spark, sf))
    return repaired.withColumns({c: F.array_join(c, ",") for c in ("evidence", "excerpts")})


@query(
    "repair_discoveries",
    f"""WITH {_VALID}, p AS (SELECT owner_id, event_id AS pos, ['focus_area', 'odd', 'routine', ''][event_id % 4 + 1] AS kind,
        CASE WHEN event_id % 3 = 0 THEN 'card:' || CAST(event_id % 5 AS VARCHAR) END AS id, CASE WHEN event_id % 2 = 0 THEN 'Own routine' END AS title,
        CASE WHEN event_id % 5 <> 0 THEN 'sum ' || CAST(event_id AS VARCHAR) END AS summary, valid FROM v),
      q AS (SELECT *, CASE WHEN kind IN ('focus_area', 'routine') THEN kind END AS k0, kind = 'routine' OR coalesce(title, '') = 'Own routine' AS fb FROM p),
      r AS (SELECT owner_id, pos, coalesce(id, CASE WHEN fb THEN 'routine:own' END, CASE WHEN coalesce(k0, CASE WHEN fb THEN 'routine' END) IS NOT NULL AND coalesce(title, CASE WHEN fb THEN 'Own routine' END) IS NOT NULL
           THEN coalesce(k0, 'routine') || ':' || trim(regexp_replace(lower(coalesce(title, 'Own routine')), '[^a-z0-9]+', '-', 'g'), '-') END) AS id,
        coalesce(k0, CASE WHEN fb THEN 'routine' END) AS kind, coalesce(title, CASE WHEN fb THEN 'Own routine' END) AS title, coalesce(summary, CASE WHEN fb THEN 'own summary' END) AS summary,
        CASE WHEN fb THEN 0.74 ELSE 0.66 END AS confidence, CASE WHEN len(valid) > 0 THEN valid WHEN fb THEN ['f1'] ELSE [] END AS ev FROM q),
      u AS (SELECT *, row_number() OVER (PARTITION BY owner_id, id ORDER BY pos) AS n FROM r WHERE id IS NOT NULL AND kind IS NOT NULL AND title IS NOT NULL AND summary IS NOT NULL AND len(ev) > 0)
    SELECT owner_id, id, kind, title, summary, confidence, array_to_string(ev, ',') AS evidence, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY pos) AS place FROM u WHERE n = 1) WHERE place <= 6""",
)
def repair_discoveries(spark, sf):
    e = _events(spark, sf)
    proposed = e.select(
        "owner_id",
        "pos",
        _pick(("focus_area", "odd", "routine", ""), _key() % 4).alias("kind"),
        F.when(_key() % 3 == 0, F.concat(F.lit("card:"), (_key() % 5).cast("string"))).alias("id"),
        F.when(_key() % 2 == 0, "Own routine").alias("title"),
        F.when(_key() % 5 != 0, F.concat(F.lit("sum "), "id")).alias("summary"),
        F.lit(None).cast("double").alias("confidence"),
        _ids().alias("evidence"),
    )
    fallback = e.select("owner_id").distinct().select(
        "owner_id",
        F.lit(1).cast("bigint").alias("place"),
        F.lit("routine:own").alias("id"),
        F.lit("routine").alias("kind"),
        F.lit("Own routine").alias("title"),
        F.lit("own summary").alias("summary"),
        F.lit(0.74).alias("confidence"),
        F.array(F.lit("f1")).alias("evidence"),
    )
    repaired = va.repair_discoveries(proposed, fallback, _memories(spark, sf))
    return repaired.withColumn("evidence", F.array_join("evidence", ","))


@query(
    "repair_quality",
    f"""WITH {_VALID}, lq AS (SELECT owner_id, event_id, row_number() OVER (PARTITION BY owner_id ORDER BY event_id) AS place FROM v WHERE event_id % 9 <> 0),
      cl AS (SELECT owner_id, event_id, list_filter(valid, lambda x: x <> CAST(event_id AS VARCHAR)) AS d FROM v WHERE event_id % 9 <> 0),
      cr AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY event_id) AS place FROM cl WHERE len(d) > 0)
    SELECT owner_id, 'low' AS section, place, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'short' ELSE 'Low-information memory' END AS detail FROM lq WHERE place <= 10
    UNION ALL SELECT owner_id, 'cluster', place, CAST(event_id AS VARCHAR), array_to_string(d, ',') FROM cr WHERE place <= 10""",
)
def repair_quality(spark, sf):
    e, memories = _events(spark, sf), _memories(spark, sf)
    reason = F.when(_key() % 2 == 0, " short ")
    low = e.select("owner_id", "pos", F.col("id").alias("memory_id"), reason.alias("reason"))
    no_low = low.filter("false").select("owner_id", F.lit(1).cast("bigint").alias("place"), "memory_id", "reason")
    clusters = e.select("owner_id", "pos", F.col("id").alias("canonical_id"), _ids().alias("duplicate_ids"))
    no_clusters = clusters.filter("false").select(
        "owner_id", F.lit(1).cast("bigint").alias("place"), "canonical_id", "duplicate_ids"
    )
    left = va.repair_low_quality(low, no_low, memories).select(
        "owner_id", F.lit("low").alias("section"), "place", F.col("memory_id").alias("id"), F.col("reason").alias("detail")
    )
    right = va.repair_clusters(clusters, no_clusters, memories).select(
        "owner_id", F.lit("cluster").alias("section"), "place", F.col("canonical_id").alias("id"),
        F.array_join("duplicate_ids", ",").alias("detail"),
    )
    return left.unionByName(right)


@query(
    "repair_highlights",
    f"""WITH {_VALID}, p AS (SELECT owner_id, event_id AS pos, row_number() OVER (PARTITION BY owner_id ORDER BY event_id) AS idx,
        CASE event_id % 3 WHEN 0 THEN 'Evidence  1' WHEN 1 THEN 'other' END AS title, CASE WHEN event_id % 2 = 0 THEN 'detail ' || CAST(event_id AS VARCHAR) END AS detail, valid FROM v),
      q AS (SELECT *, title = 'Evidence  1' OR idx = 1 AS fb FROM p),
      r AS (SELECT owner_id, pos, coalesce(title, CASE WHEN fb THEN 'Evidence 1' END) AS title, coalesce(detail, CASE WHEN fb THEN 'own detail' END) AS detail,
        CASE WHEN len(valid) > 0 THEN valid WHEN fb THEN ['f1'] ELSE [] END AS ev FROM q)
    SELECT owner_id, title, detail, array_to_string(ev, ',') AS evidence, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY pos) AS place FROM r
      WHERE title IS NOT NULL AND detail IS NOT NULL AND len(ev) > 0) WHERE place <= 4""",
)
def repair_highlights(spark, sf):
    from engram.operators.ranking import running

    e = running(_events(spark, sf), ["owner_id"], ["event_id"], number="idx")
    proposed = e.select(
        "owner_id",
        F.col("idx").alias("pos"),
        F.when(_key() % 3 == 0, "Evidence  1").when(_key() % 3 == 1, "other").alias("title"),
        F.when(_key() % 2 == 0, F.concat(F.lit("detail "), "id")).alias("detail"),
        _ids().alias("evidence"),
    )
    fallback = e.select("owner_id").distinct().select(
        "owner_id",
        F.lit(1).cast("bigint").alias("place"),
        F.lit("Evidence 1").alias("title"),
        F.lit("own detail").alias("detail"),
        F.array(F.lit("f1")).alias("evidence"),
    )
    repaired = va.repair_highlights(proposed, fallback, _memories(spark, sf))
    return repaired.withColumn("evidence", F.array_join("evidence", ","))


@query(
    "repair_text_lists",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',b' WHEN 1 THEN 'own' ELSE 'own' END AS texts,
      CASE event_id % 3 WHEN 2 THEN 0 ELSE 1 END AS repaired FROM events""",
)
def repair_text_lists(spark, sf):
    given = F.when(_key() % 3 == 0, F.array(F.concat(F.lit(" "), "event_type"), F.lit(" "), F.lit("b"))).when(
        _key() % 3 == 1, F.array(F.lit(""))
    )
    own = F.array(F.lit("own"))
    return tb.events(spark, sf).select(
        "event_id",
        F.array_join(va.text_list_or(given, own, 5), ",").alias("texts"),
        va.repaired_text_list(given, own, 5).alias("repaired"),
    )


@query(
    "report_violations",
    f"""WITH {_MEM}, a AS (SELECT user_id AS owner_id, count(*) AS n FROM events GROUP BY 1),
      it AS (SELECT user_id AS owner_id, CASE WHEN event_type = 'click' AND event_id % 40 = 0 THEN 'generic_theme' WHEN event_type = 'view' AND event_id % 30 = 0 THEN 'generic_entity'
        WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'empty_relation' END AS problem FROM events),
      u AS (SELECT user_id AS owner_id, event_type AS section, event_id AS pos, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 9 = 0),
      l AS (SELECT owner_id, section, string_agg(id, ', ' ORDER BY pos) AS detail FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, section ORDER BY pos) AS r FROM u) WHERE r <= 5 GROUP BY ALL)
    SELECT owner_id, 'memory_count' AS problem, '' AS detail FROM a WHERE owner_id % 5 = 0
    UNION ALL SELECT owner_id, 'deduplicated_count', '' FROM a WHERE owner_id % 7 = 0
    UNION ALL SELECT DISTINCT owner_id, problem, '' FROM it WHERE problem IS NOT NULL
    UNION ALL SELECT owner_id, 'unknown_memory:' || section, detail FROM l
    UNION ALL SELECT owner_id, 'shallow_persona', '' FROM a WHERE owner_id % 4 = 0 OR owner_id % 3 = 0""",
)
def report_violations(spark, sf):
    e = _events(spark, sf)
    owner = F.col("owner_id")
    counts = e.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    actual = counts.select("owner_id", F.col("n").alias("memory_count"), F.col("n").alias("deduplicated_count"))
    overview = counts.select(
        "owner_id",
        F.when(owner % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("memory_count"),
        F.when(owner % 7 == 0, F.col("n") - 1).otherwise(F.col("n")).alias("deduplicated_count"),
    )
    kind = F.col("event_type")
    items = e.select(
        "owner_id",
        F.when(kind == "click", "theme").when(kind == "view", "entity").otherwise("relation").alias("section"),
        F.when((kind == "click") & (_key() % 40 == 0), " The ").when((kind == "view") & (_key() % 30 == 0), "platform").otherwise("fine").alias("name"),
        F.lit("user").alias("source"),
        F.when((kind == "error") & (_key() % 20 == 0), " ").otherwise("knows").alias("relation"),
        F.lit("Bo").alias("target"),
    )
    refs = e.select("owner_id", kind.alias("section"), "pos", "id")
    persona = counts.select(
        "owner_id",
        F.when(owner % 4 == 0, " ").otherwise("steady").alias("summary"),
        F.when(owner % 3 == 0, 0).otherwise(2).alias("signal_count"),
    )
    return va.report_violations(overview, items, refs, persona, actual, _memories(spark, sf))
