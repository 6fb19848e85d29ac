"""Profiles over documents: every text is preceded by one of a few telling sentences, chosen by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram import profile_lexicons as pl
from engram.operators import profile as pr
from engram.plans import tables as tb
from engram.plans.registry import query
from engram.plans.text_queries import _limit_sql
from engram.session import materialize
from engram.sources.memories import profile_memories

SENTENCES = (
    "用户长期关注 AI Agent 与 Memory 研究。",
    "Prefer a direct reply style with concrete steps. ",
    "Never invent facts: the assistant should answer from evidence only. ",
    "目标: plan the next career task this year. ",
    "React 前端 工程实践 长期 TypeScript. ",
    "summary: nothing to see here. ",
    "习惯: 结构化 拆解 复杂问题，少说教。",
    "Created a demo folder with a README script. ",
    "The backend module covers the endpoint API. ",
    "Today is a temporary note. ",
    "height 180 cm and weight 70 kg. ",
    "健康 减脂 长期目标 持续推进。",
    "dislike long talks, hates noise; long-term habit. ",
)


def _memories(spark, sf):
    picked = F.get(F.array(*[F.lit(s) for s in SENTENCES]), (F.col("doc_id") % len(SENTENCES)).cast("int"))
    return profile_memories(tb.documents(spark, sf).withColumn("content", F.concat(picked, "content")))


def _flags(spark, sf):
    return pr.flagged(_memories(spark, sf))


def _re(c: str, p: str) -> str:
    return f"regexp_matches({c}, {tb._q(p)}, 'i')"


_META = "'{' || metadata_json || '}'"
FLAGS = f"""{tb.MEM}, pm AS (SELECT * FROM (SELECT doc_id, owner_id, id, created_at, memory_type, tags, metadata_json,
    [{", ".join(tb._q(s) for s in SENTENCES)}][doc_id % {len(SENTENCES)} + 1] || content AS c,
    row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id) AS pos FROM mem
    WHERE state = 'active' AND memory_type IN ('fact', 'insight', 'pinned')) WHERE pos <= 50),
j AS (SELECT *, CAST(metadata_json AS JSON) AS m, array_to_string(tags, ' ') || ' correctness confidence evidenceCount title edited edit_version' AS labels FROM pm),
w AS (SELECT *, [m->>'correctness', m->>'confidence', m->>'evidenceCount', m->>'title', m->>'edited', m->>'edit_version',
   'correctness', 'confidence', 'evidenceCount', 'title', 'edited', 'edit_version'] AS meta FROM j),
fl AS (SELECT *,
  {_re(tb.sql_collapse('c'), pl.SUMMARY_PREFIX)} AS is_summary,
  CASE WHEN contains(lower(c), 'current_priority') THEN 'current_priority' END AS item_kind,
  {_re('c', pl.PRODUCT_OR_DOC)} AND NOT {_re('c', pl.ABOUT_USER)} AS product_or_doc,
  {_re('c', pl.FILE_OR_DEMO)} AS file_or_demo, {_re('c', pl.FACT_ONLY)} AS fact_only,
  {_re('c', pl.TEMPORAL_PLAN)} AS temporal_plan, {_re('c', pl.EPHEMERAL)} AS ephemeral,
  {_re('c', pl.CONSTRAINT)} AND ({_re('c', pl.ROBOT_TARGET)} OR {_re('c', pl.ROBOT_BEHAVIOR)}) AS robot_constraint,
  ({_re('c', pl.PREFERENCE)} OR {_re('c', pl.PREFERENCE_WIDE)}) AND {_re('c', pl.COMPANION_TARGET)} AS companion_style,
  CASE WHEN {_re('c', pl.DISLIKE)} THEN NULL {" ".join(f"WHEN {_re('c', p)} OR len(list_filter(meta, lambda x: {_re('x', p)})) > 0 THEN '{k}'" for k, p in pl.ATTRIBUTE_LEXICONS.items())} END AS attribute_kind,
  {" OR ".join(f"{_re('c', p)} OR len(list_filter(meta, lambda x: {_re('x', p)})) > 0" for p in [pl.STABLE, *pl.ATTRIBUTE_LEXICONS.values(), pl.PERSONA, pl.PREFERENCE, pl.DISLIKE, pl.WORK_STYLE])} AS lasting,
  (CAST(m->>'confidence' AS DOUBLE) * 10 + least(CAST(m->>'evidenceCount' AS DOUBLE), 5)) * CASE WHEN memory_type = 'fact' THEN 1.2 ELSE 1.0 END + 0.2 AS score,
  nullif({tb.sql_collapse("m->>'title'")}, '') AS m_title FROM w),
flags AS (SELECT *, NOT (is_summary OR item_kind IS NOT NULL OR robot_constraint OR product_or_doc OR fact_only OR file_or_demo)
   AND NOT temporal_plan AND NOT ephemeral AND lasting AS stable FROM fl)"""


@query(
    "profile_flags",
    f"""WITH {FLAGS} SELECT owner_id, id, pos, is_summary, item_kind, product_or_doc, file_or_demo, fact_only, temporal_plan, ephemeral, robot_constraint,
      companion_style, attribute_kind, stable, round(score, 6) AS score FROM flags""",
)
def profile_flags(spark, sf):
    return _flags(spark, sf).select(
        "owner_id", "id", "pos", "is_summary", "item_kind", "product_or_doc", "file_or_demo", "fact_only", "temporal_plan",
        "ephemeral", "robot_constraint", "companion_style", "attribute_kind", "stable", F.round("score", 6).alias("score"),
    )


_WS = "[" + lx.WS_CLASS + "]*"
_NO_LABEL = f"regexp_replace(c, '^{_WS}[A-Za-z0-9_{_WS[1:-2]}\\x{{4e00}}-\\x{{9fff}}-]{{1,24}}{_WS}[:：]{_WS}', '')"


def _sentence(x: str) -> str:
    return f"nullif(trim(regexp_extract({tb.sql_collapse(x)}, '^[^。.!?\\n]*', 0), ' '), '')"


_KIND_SQL = {
    "current_priority": _re("c", pl.PRIORITY),
    "companion_style": "NOT product_or_doc AND NOT file_or_demo AND companion_style",
    "robot_constraint": "NOT product_or_doc AND NOT file_or_demo AND robot_constraint",
}
ITEMS = f"""{FLAGS}, ir AS ({" UNION ALL ".join(
    f"SELECT owner_id, '{k}' AS kind, pos, id, score, coalesce(m_title, {_sentence(_NO_LABEL)}, '{pl.ITEM_LABELS[k]}') AS title, {tb.sql_collapse('c')} AS summary FROM flags "
    f"WHERE NOT is_summary AND CASE WHEN item_kind IS NOT NULL THEN item_kind = '{k}' ELSE {t} END" for k, t in _KIND_SQL.items())}),
cand AS (SELECT owner_id, kind, lower(title) AS key, min(pos) AS fp, arg_min(title, pos) AS title, arg_min(summary, pos) AS summary, sum(score) AS importance,
   list(id ORDER BY pos) AS ids FROM ir GROUP BY ALL),
src AS (SELECT owner_id, kind, title || ' ' || summary AS text, importance, 0 AS part, fp AS pos, ids FROM cand WHERE kind <> 'current_priority'
  UNION ALL SELECT owner_id, 'companion_style', coalesce({_sentence('c')}, '') || ' ' || {tb.sql_collapse('c')}, score, 1, pos, [id] FROM flags
    WHERE NOT is_summary AND NOT product_or_doc AND NOT file_or_demo AND {_re('c', pl.PLAN_CONTENT)}
  UNION ALL SELECT owner_id, 'robot_constraint', coalesce({_sentence('c')}, '') || ' ' || {tb.sql_collapse('c')}, score, 1, pos, [id] FROM flags WHERE NOT is_summary),
sx AS (SELECT owner_id, kind, x, min((part, pos, i)) AS o FROM (SELECT owner_id, kind, part, pos, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM src) GROUP BY ALL),
sev AS (SELECT owner_id, kind, list(x ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, kind ORDER BY o) AS r FROM sx) WHERE r <= 3 GROUP BY ALL),
pool AS (SELECT owner_id, kind, sum(importance) AS importance,
  {", ".join(f"bool_or({_re('text', p)}) AS c{i}" for i, (p, _) in enumerate(pl.COMPANION_PARTS))},
  {", ".join(f"bool_or({_re('text', p)}) AS k{i}" for i, (_, p, _) in enumerate(pl.CONSTRAINT_ITEMS))} FROM src GROUP BY ALL),
made AS (SELECT owner_id, kind, {tb._q(pl.COMPANION_TITLE)} AS title, {{limited}} AS summary, importance, 0 AS o FROM
    (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN c{i} THEN {tb._q(t)} END" for i, (_, t) in enumerate(pl.COMPANION_PARTS))}], lambda x: x IS NOT NULL), '；') AS parts FROM pool
     WHERE kind = 'companion_style') WHERE parts <> ''
  {" ".join(f"UNION ALL SELECT owner_id, kind, {tb._q(t)}, {tb._q(s)}, importance, {i} FROM pool WHERE kind = 'robot_constraint' AND k{i}" for i, (t, _, s) in enumerate(pl.CONSTRAINT_ITEMS))}),
alli AS (SELECT owner_id, kind, title, summary, importance, fp AS o, len(ids) AS evidence_count, ids[1:3] AS evidence FROM cand
    WHERE (owner_id, kind) NOT IN (SELECT (owner_id, kind) FROM made)
  UNION ALL SELECT made.*, len(evidence), evidence FROM made JOIN sev USING (owner_id, kind)),
items AS (SELECT owner_id, kind, place, title, summary, CAST(floor(round(importance, 6) + 0.5) AS BIGINT) AS importance, evidence_count, evidence FROM
  (SELECT *, row_number() OVER (PARTITION BY owner_id, kind ORDER BY round(importance, 6) DESC, o) AS place FROM alli) WHERE place <= 10)"""
ITEMS = ITEMS.replace("{limited}", _limit_sql("parts", 150))


@query(
    "profile_items",
    f"""WITH {ITEMS} SELECT owner_id, kind, place, title, sha256(summary) AS summary_hash, importance, evidence_count, array_to_string(evidence, ',') AS evidence FROM items""",
)
def profile_items(spark, sf):
    items = pr.profile_items(_flags(spark, sf))
    return items.withColumns({"evidence": F.array_join("evidence", ","), "summary_hash": F.sha2("summary", 256)}).drop("summary")


_SIG = f"""{ITEMS}, st AS (SELECT *, {tb.sql_collapse('c')} AS t FROM flags WHERE stable),
it AS (SELECT owner_id, kind, title || ' ' || summary AS t FROM items),
plans(label, a, b) AS (VALUES {", ".join(f"({tb._q(l)}, {tb._q(a)}, {tb._q(b or '')})" for l, a, b in pl.PLAN_SIGNALS)}),
texts(grp, label, a) AS (VALUES {", ".join(f"('{g}', {tb._q(l)}, {tb._q(p)})" for g, l, p in pl.TEXT_SIGNALS)}),
sg AS (SELECT owner_id, 'identity' AS grp, CASE WHEN {_re('t', pl.AI_CONTEXT)} THEN {tb._q(pl.ID_AI_FRONTEND)} ELSE {tb._q(pl.ID_FRONTEND)} END AS label FROM st WHERE {_re('t', pl.FRONTEND)}
  UNION ALL SELECT owner_id, 'identity', {tb._q(pl.ID_AI_PRODUCT)} FROM st WHERE NOT {_re('t', pl.FRONTEND)} AND {_re('t', pl.PRODUCT_ROLE)} AND {_re('t', pl.AI_PRODUCT)}
  UNION ALL SELECT owner_id, texts.grp, texts.label FROM st JOIN texts ON regexp_matches(t, a, 'i')
  UNION ALL SELECT owner_id, 'plan', label FROM st JOIN plans ON regexp_matches(t, a, 'i') AND regexp_matches(t, b, 'i')
  UNION ALL SELECT owner_id, 'plan', label FROM it JOIN plans ON kind = 'current_priority' AND regexp_matches(t, a, 'i') AND regexp_matches(t, b, 'i')
  UNION ALL SELECT owner_id, 'style', {tb._q(pl.STYLE_SIGNAL[0])} FROM it WHERE kind <> 'current_priority' AND {_re('t', pl.STYLE_SIGNAL[1])})"""


@query("profile_signals", f"WITH {_SIG} SELECT DISTINCT owner_id, grp, label FROM sg")
def profile_signals(spark, sf):
    flags = _flags(spark, sf)
    return pr.persona_signals(flags, pr.profile_items(flags)).drop("o")


@query("profile_summary")
def profile_summary(spark, sf):
    flags = _flags(spark, sf)
    summary = pr.profile_summary(flags, materialize(pr.profile_items(flags)))
    return summary.withColumn("evidence", F.array_join("evidence", ","))
