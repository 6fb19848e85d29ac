"""Corpus analysis over documents, owner = source.

The texts are invented words, so lexicons and relation leads that occur in them are passed as parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators import corpus as cp
from engram.operators import dedupe as dd
from engram.plans import tables as tb
from engram.plans.registry import query
from engram.session import written
from engram.sources import sinks

LEXICONS = {
    "preference": r"(rest|tone)",
    "working_style": r"(stat|lean|token)",
    "goal": r"(path|queue)",
    "constraint": r"(sad|tell)",
    "decision": r"(env|release)",
    "routine": r"(version|data|share)",
}
LEADS = (("ends_with", r"(?:that|this)\."), ("starts", r"the\."), ("lists", "and"))
TENSIONS = (
    (r"(rest|tone)", r"(stat|lean)", lx.TENSION_TESTS[0][2]),
    (r"(path|queue)", r"(env|sad)", lx.TENSION_TESTS[1][2]),
    (r"(zzzz)", r"(stat)", lx.TENSION_TESTS[2][2]),
)
CHUNK = 20

# --- SQL twins ----------------------------------------------------------------
_W = f"[{lx.WS_CLASS}]+"
_DENY = tb.sql_list(lx.THEME_DENYLIST)
_ENT = tb.sql_list(lx.ENTITY_DENYLIST)


def _meaningful(t: str) -> str:
    return (
        f"((length({t}) >= 3 AND {t} NOT IN {_DENY} AND NOT regexp_matches({t}, '^([0-9]+$|https?:|www[.])')) OR "
        f"(length({t}) = 2 AND regexp_matches({t}, '\\p{{Han}}') AND {t} NOT IN {tb.sql_list(lx.THEME_STOPWORDS_ZH)}))"
    )


def _label_ok(x: str) -> str:
    k = f"lower({x})"
    return f"({k} NOT IN {_ENT} AND length({k}) >= CASE WHEN regexp_matches({k}, '\\p{{Han}}') THEN 2 ELSE 3 END)"


UNIQUE = f"""{tb.MEM}, uniq AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY owner_id,
  sha256({tb.sql_norm('content')}) ORDER BY created_at, id) AS r FROM mem) WHERE r = 1),
u AS (SELECT *, {tb.sql_preview('content')} AS preview,
   (row_number() OVER (PARTITION BY owner_id ORDER BY created_at, id) - 1) // {CHUNK} AS chunk FROM uniq)"""

TERMS = f"""{UNIQUE}, tk AS (SELECT owner_id, chunk, id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}@#._/-]+'),
  lambda t: {_meaningful('t')}) AS toks FROM u),
terms AS (SELECT owner_id, chunk, id, 'token' AS kind, unnest(list_distinct(toks)) AS name FROM tk
  UNION ALL SELECT owner_id, chunk, id, 'phrase', unnest(list_distinct(list_filter(list_concat(
    list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]),
    list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])),
    lambda p: length(p) >= 7))) FROM tk)"""


def _themes_sql(keys: str, name: str) -> str:
    return f"""{name}_df AS (SELECT {keys}, kind, name, count(*) AS n FROM terms GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, kind ORDER BY n DESC, name) AS r FROM {name}_df WHERE n >= 2),
{name} AS (SELECT {keys}, kind, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY kind, r) AS place
  FROM {name}_r WHERE r <= CASE kind WHEN 'phrase' THEN 10 ELSE 12 END) WHERE place <= 8)"""


_DESCRIBED = """CASE kind WHEN 'phrase' THEN 'Recurring phrase found in ' || CAST(n AS VARCHAR) || ' memories.'
  ELSE 'Recurring signal across ' || CAST(n AS VARCHAR) || ' memories.' END"""

ENTITIES = f"""names AS (SELECT owner_id, chunk, id, created_at, unnest(list_distinct(regexp_extract_all(content,
    '\\b[A-Z][a-z]+(?:{_W}[A-Z][a-z]+){{0,2}}\\b'))) AS label FROM u),
teams AS (SELECT DISTINCT owner_id, chunk, id, created_at, array_to_string(list_transform(string_split(m, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM (SELECT *, {tb.sql_collapse('t')} AS m FROM
    (SELECT owner_id, chunk, id, created_at, unnest(regexp_extract_all(content, '\\b[A-Za-z][A-Za-z-]+{_W}(?:team|group)\\b', 0, 'i')) AS t FROM u))
    WHERE lower(string_split(m, ' ')[1]) NOT IN {_ENT}),
dict(kind, term) AS (VALUES {", ".join(f"('tools', '{t}')" for t in lx.TOOL_TERMS)}, {", ".join(f"('places', '{t}')" for t in lx.PLACE_TERMS)}),
tagged AS (SELECT owner_id, chunk, id, created_at, lower({tb.sql_trim("regexp_replace(t, '^#+', '')")}) AS label
  FROM (SELECT owner_id, chunk, id, created_at, unnest(tags) AS t FROM u)),
hits AS (SELECT owner_id, chunk, 'people' AS kind, label, id, created_at FROM names WHERE {_label_ok('label')}
  UNION ALL SELECT owner_id, chunk, 'teams', label, id, created_at FROM teams
  UNION ALL SELECT owner_id, chunk, kind, term, id, created_at FROM u JOIN dict ON contains(lower(content), term)
  UNION ALL SELECT owner_id, chunk, 'projects', label, id, created_at FROM tagged WHERE {_meaningful('label')}
    AND label NOT IN {tb.sql_list(lx.PROJECT_TAG_DENYLIST)} AND label NOT IN {_ENT})"""


def _groups_sql(keys: str, name: str, limit: int) -> str:
    return f"""{name}_c AS (SELECT {keys}, kind, label, count(*) AS cnt FROM hits GROUP BY ALL),
{name}_e AS (SELECT {keys}, kind, label, list(id ORDER BY r) AS evidence FROM (SELECT *, row_number() OVER
  (PARTITION BY {keys}, kind, label ORDER BY created_at, id) AS r FROM hits) WHERE r <= 6 GROUP BY ALL),
{name} AS (SELECT {keys}, kind, place, label, cnt, evidence FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, kind ORDER BY cnt DESC, label) AS place
  FROM {name}_c) JOIN {name}_e USING ({keys}, kind, label) WHERE place <= {limit})"""


_RULES = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(LEADS))
_TARGET = f"([A-Z][a-z]+(?:{_W}[A-Z][a-z]+)?)"
RELATIONS = f"""rel0 AS ({" UNION ALL ".join(
    f"SELECT owner_id, chunk, id, created_at, preview, {i} AS place, '{n}' AS relation, unnest(ts) AS target, generate_subscripts(ts, 1) AS pos "
    f"FROM (SELECT *, regexp_extract_all(content, '\\b{lead} {_TARGET}\\b', 1) AS ts FROM u)"
    for i, (n, lead) in enumerate(LEADS))}),
rel AS (SELECT * FROM rel0 WHERE {_label_ok('target')}),
drel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, id, place, pos) AS rank_in_report
  FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, relation, target, id ORDER BY place, pos) AS r FROM rel) WHERE r = 1)
  WHERE rank_in_report <= 18)"""

_SIG_ORDER = {s: i for i, s in enumerate(LEXICONS)}
SIGNALS = f"""lex(signal, pat) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LEXICONS.items())}),
sig AS (SELECT u.owner_id, u.chunk, u.id, u.created_at, u.preview AS text, lex.signal FROM u JOIN lex ON regexp_matches(u.content, lex.pat, 'i')),
firstsig AS (SELECT owner_id, signal, text, min(created_at) AS t FROM sig GROUP BY ALL),
repr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, signal ORDER BY t) AS place FROM firstsig) WHERE place <= 5),
high AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY CASE signal WHEN 'preference' THEN 0
  WHEN 'working_style' THEN 1 WHEN 'goal' THEN 2 ELSE 3 END, created_at, id) AS place FROM sig
  WHERE signal IN ('preference', 'working_style', 'goal', 'constraint')) WHERE place <= 4),
pooled AS (SELECT DISTINCT owner_id, id, lower(text) AS text FROM sig WHERE signal IN ('working_style', 'preference', 'constraint', 'decision')),
tens AS (SELECT owner_id, {", ".join(
    f"bool_or(regexp_matches(text, '{a}')) AND bool_or(regexp_matches(text, '{b}')) AS tension_{i}" for i, (a, b, _) in enumerate(TENSIONS))}
  FROM pooled GROUP BY 1),
lowq AS (SELECT owner_id, id, created_at FROM u WHERE length({tb.sql_trim('content')}) < 24
  OR regexp_matches(lower({tb.sql_trim('content')}), '{lx.ACKNOWLEDGEMENT}', 'i')),
flags AS (SELECT o.owner_id, {", ".join(f"(SELECT count(*) FROM sig s WHERE s.owner_id = o.owner_id AND s.signal = '{k}') AS n_{k}" for k in LEXICONS)},
  (SELECT count(*) FROM lowq l WHERE l.owner_id = o.owner_id) AS low_quality,
  {", ".join(f"coalesce(t.tension_{i}, false) AS tension_{i}" for i in range(3))}
  FROM (SELECT DISTINCT owner_id FROM u) o LEFT JOIN tens t USING (owner_id))"""


def _unique(spark, sf):
    return dd.distinct_texts(tb.documents(spark, sf))


def _features(spark, sf):
    return cp.extract(_unique(spark, sf), lexicons=LEXICONS, leads=LEADS)


@query(
    "token_frequency",
    f"WITH {TERMS} SELECT kind, name, count(*) AS n FROM terms GROUP BY ALL",
)
def token_frequency(spark, sf):
    features = _features(spark, sf).withColumn("all", F.lit(1))
    return cp.document_frequency(features, ["all"]).drop("all")


@query(
    "themes",
    f"WITH {TERMS}, {_themes_sql('owner_id', 'th')} SELECT owner_id, place, name, n, {_DESCRIBED} AS description FROM th",
)
def themes(spark, sf):
    return cp.themes(cp.document_frequency(_features(spark, sf), least=cp.THEME_MEMORIES))


_BOOST = f"""{TERMS}, {_themes_sql('owner_id', 'th')}, {_themes_sql('owner_id, chunk', 'ct')},
boost AS (SELECT owner_id, name, count(*) AS n FROM ct GROUP BY ALL),
brank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, name) AS r FROM boost) WHERE r <= 6),
both_themes AS (SELECT owner_id, 0 AS s, place AS r, name, n, {_DESCRIBED} AS description FROM th
  UNION ALL SELECT owner_id, 1, r, name, n, 'Cross-chunk recurring signal seen in ' || CAST(n AS VARCHAR) || ' memory references.' FROM brank
  WHERE (owner_id, name) NOT IN (SELECT (owner_id, name) FROM th)),
bt AS (SELECT owner_id, place, name, n, description FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY s, r) AS place FROM both_themes)
  WHERE place <= 8)"""


@query("theme_boosts", f"WITH {_BOOST} SELECT * FROM bt")
def theme_boosts(spark, sf):
    chunked = dd.chunked_texts(tb.documents(spark, sf), CHUNK)
    keys = ("owner_id", "chunk")
    features = written(cp.extract(chunked, keys, LEXICONS, leads=LEADS).select(*keys, "words"))
    per_chunk = cp.themes(cp.chunk_frequency(features, keys, cp.THEME_MEMORIES), keys)
    references = per_chunk.select("owner_id", "name", F.lit(0).cast("bigint").alias("references"))
    return cp.boosted_themes(cp.themes(cp.document_frequency(features, least=cp.THEME_MEMORIES)), references)


@query(
    "entities",
    f"""WITH {UNIQUE}, {ENTITIES}, {_groups_sql('owner_id', 'eg', 8)}
    SELECT owner_id, kind, place, label, cnt AS "count", array_to_string(evidence, ',') AS evidence FROM eg""",
)
def entities(spark, sf):
    groups = cp.entity_groups(cp.entity_hits(_features(spark, sf)))
    return groups.withColumn("evidence", F.array_join("evidence", ","))


@query(
    "relations",
    f"""WITH {UNIQUE}, {RELATIONS} SELECT owner_id, 'user' AS source, relation, target, 0.58 AS confidence, id, preview AS excerpt,
      rank_in_report FROM drel""",
)
def relations(spark, sf):
    return cp.distinct_relations(cp.relation_rows(_features(spark, sf))).drop("created_at", "place", "pos")


@query(
    "chunk_relations_union",
    f"""WITH {UNIQUE}, {RELATIONS},
      o AS (SELECT owner_id, 0 AS part, created_at, id, place, pos, 'user' AS source, relation, target, id AS evidence FROM rel
        UNION ALL SELECT source, 1, NULL, NULL, NULL, doc_id, 'chunk', CASE doc_id % 5 WHEN 0 THEN 'written_in' ELSE 'has' END, lang,
          CASE doc_id % 5 WHEN 0 THEN 'all' ELSE CAST(doc_id AS VARCHAR) || '|x' END FROM documents),
      f AS (SELECT *, row_number() OVER (PARTITION BY owner_id, source, relation, target, evidence ORDER BY part, created_at, id, place, pos, relation) AS r FROM o)
    SELECT owner_id, source, relation, target, evidence, place AS rank_in_report FROM (
      SELECT owner_id, source, relation, target, evidence, row_number() OVER (PARTITION BY owner_id ORDER BY part, created_at, id, place, pos, relation) AS place FROM f WHERE r = 1) WHERE place <= 18""",
)
def chunk_relations_union(spark, sf):
    docs = tb.table(spark, sf, "documents")
    whole = F.col("doc_id") % 5 == 0
    chunks = docs.select(
        F.col("source").alias("owner_id"),
        F.col("doc_id").alias("pos"),
        F.lit("chunk").alias("source"),
        F.when(whole, "written_in").otherwise("has").alias("relation"),
        F.col("lang").alias("target"),
        F.lit(0.5).alias("confidence"),
        F.lit("").alias("excerpt"),
        F.when(whole, F.array(F.lit("all"))).otherwise(F.array(F.col("doc_id").cast("string"), F.lit("x"))).alias("evidence"),
    )
    found = cp.relations_with_chunks(cp.relation_rows(_features(spark, sf)), chunks)
    return found.select("owner_id", "source", "relation", "target", F.array_join("evidence", "|").alias("evidence"), "rank_in_report")


@query("signals", f"WITH {UNIQUE}, {SIGNALS} SELECT owner_id, signal, place, text FROM repr")
def signals(spark, sf):
    return cp.representative_signals(cp.signal_rows(_features(spark, sf)))


@query(
    "evidence_highlights",
    f"""WITH {UNIQUE}, {SIGNALS} SELECT owner_id, place, 'Evidence ' || CAST(place AS VARCHAR) AS title, text AS detail,
      id AS memory_id FROM high""",
)
def evidence_highlights(spark, sf):
    return cp.evidence_highlights(cp.signal_rows(_features(spark, sf)))


@query("persona_flags", f"WITH {UNIQUE}, {SIGNALS} SELECT * FROM flags")
def persona_flags(spark, sf):
    return cp.persona_flags(_features(spark, sf), tension_tests=TENSIONS)


@query(
    "low_quality_examples",
    f"""WITH {UNIQUE}, {SIGNALS} SELECT owner_id, place, id AS memory_id, 'Very short or low-information memory' AS reason FROM
    (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, id) AS place FROM lowq) WHERE place <= 10""",
)
def low_quality_examples(spark, sf):
    return cp.low_quality_examples(_features(spark, sf))


@query(
    "overview",
    f"""WITH {UNIQUE} SELECT owner_id, (SELECT count(*) FROM mem m WHERE m.owner_id = u.owner_id) AS memory_count,
      count(*) AS deduplicated_count, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S.000Z') AS span_start,
      strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.000Z') AS span_end FROM u GROUP BY owner_id""",
)
def overview(spark, sf):
    keys = dd.memory_keys(tb.documents(spark, sf))
    frame = cp.overview(keys, dd.unique_memories(keys))
    return frame.withColumns({c: tx.iso(F.col(c)) for c in ("span_start", "span_end")})


@query(
    "chunk_insights",
    f"""WITH {TERMS}, {_themes_sql('owner_id, chunk', 'ct')}, {ENTITIES}, {_groups_sql('owner_id, chunk', 'eg', 5)}, {RELATIONS},
      lex(signal, pat) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LEXICONS.items())}),
      fs AS (SELECT u.owner_id, u.chunk, lex.signal, u.preview AS text, min(u.created_at) AS t FROM u JOIN lex
        ON regexp_matches(u.content, lex.pat, 'i') GROUP BY ALL)
    SELECT owner_id, chunk, 'theme' AS section, place, name AS value FROM ct
    UNION ALL SELECT owner_id, chunk, kind, place, label FROM eg
    UNION ALL SELECT owner_id, chunk, signal, place, text FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, chunk, signal ORDER BY t) AS place FROM fs)
      WHERE place <= 4
    UNION ALL SELECT owner_id, chunk, 'relation', n, 'user|' || relation || '|' || target FROM (SELECT *, row_number() OVER
      (PARTITION BY owner_id, chunk ORDER BY created_at, id, place, pos) AS n FROM rel) WHERE n <= 10""",
)
def chunk_insights(spark, sf):
    chunked = dd.chunked_texts(tb.documents(spark, sf), CHUNK)
    return cp.chunk_insights(written(cp.extract(chunked, ["owner_id", "chunk"], LEXICONS, leads=LEADS)))


@query(
    "chunk_annotations",
    f"""WITH {TERMS}, {_themes_sql('owner_id, chunk', 'ct')}, {ENTITIES}, {_groups_sql('owner_id, chunk', 'eg', 5)}, {RELATIONS}, {SIGNALS},
      k AS (SELECT DISTINCT owner_id, chunk FROM u),
      n AS (SELECT owner_id, chunk, list(name ORDER BY place) AS names FROM ct GROUP BY ALL),
      p AS (SELECT owner_id, chunk, string_agg(label, ',' ORDER BY place) AS people FROM eg WHERE kind = 'people' GROUP BY ALL),
      r AS (SELECT owner_id, chunk, least(count(*), 10) AS relations FROM rel GROUP BY ALL),
      s AS (SELECT owner_id, chunk, bool_or(signal IN ('working_style', 'preference')) AS style, bool_or(signal IN ('goal', 'decision')) AS goal,
        bool_or(signal = 'routine') AS routine FROM sig GROUP BY ALL),
      cpool AS (SELECT DISTINCT owner_id, chunk, id, lower(text) AS text FROM sig WHERE signal IN ('working_style', 'preference', 'constraint', 'decision')),
      t AS (SELECT owner_id, chunk, {", ".join(
        f"bool_or(regexp_matches(text, '{a}')) AND bool_or(regexp_matches(text, '{b}')) AS t{i}" for i, (a, b, _) in enumerate(TENSIONS))} FROM cpool GROUP BY ALL)
    SELECT owner_id, chunk, coalesce(array_to_string(names, ','), '') AS themes, coalesce(people, '') AS people, coalesce(relations, 0) AS relations,
      array_to_string(list_filter([{", ".join(f"CASE WHEN t{i} THEN {tb._q(text)} END" for i, (_, _, text) in enumerate(TENSIONS))}], lambda x: x IS NOT NULL), chr(10)) AS tensions,
      coalesce(nullif(array_to_string(list_filter([CASE WHEN len(names) > 0 THEN 'This corpus concentrates on ' || array_to_string(names[1:3], ', ')
        || ', with repeated memory traffic around those domains.' END, CASE WHEN style THEN {tb._q(lx.PERSONA_STYLE)} END,
        CASE WHEN goal THEN {tb._q(lx.PERSONA_GOALS)} END, CASE WHEN routine THEN {tb._q(lx.PERSONA_ROUTINES)} END], lambda x: x IS NOT NULL), ' '), ''),
        {tb._q(lx.PERSONA_EMPTY)}) AS summary
    FROM k LEFT JOIN n USING (owner_id, chunk) LEFT JOIN p USING (owner_id, chunk) LEFT JOIN r USING (owner_id, chunk)
      LEFT JOIN s USING (owner_id, chunk) LEFT JOIN t USING (owner_id, chunk)""",
)
def chunk_annotations(spark, sf):
    """The default of the annotation hook: native heuristics for every chunk."""
    chunks = dd.chunked_texts(tb.documents(spark, sf), CHUNK)
    found = cp.annotate(chunks, lexicons=LEXICONS, leads=LEADS, tension_tests=TENSIONS)
    return found.select(
        "owner_id", "chunk", F.array_join("theme", ",").alias("themes"), F.array_join("people", ",").alias("people"),
        F.size("relation").cast("bigint").alias("relations"), F.array_join("tensions", "\n").alias("tensions"), "summary",
    )


@query(
    "cleaned_insights",
    f"""WITH {tb.SES}, r AS (SELECT owner_id, conv_id AS chunk, role AS section, turn AS pos,
        {tb.sql_trim("CASE WHEN turn % 4 = 0 THEN '  ' ELSE ' ' || content || ' ' END")} AS value FROM ses)
    SELECT owner_id, chunk, section, value, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, chunk, section ORDER BY pos) AS place
      FROM r WHERE value <> '') WHERE place <= 12""",
)
def cleaned_insights(spark, sf):
    padded = F.concat(F.lit(" "), F.col("content"), F.lit(" "))
    raw = tb.sessions(spark, sf).select(
        "owner_id",
        F.col("conv_id").alias("chunk"),
        F.col("role").alias("section"),
        F.col("turn").alias("pos"),
        F.when(F.col("turn") % 4 == 0, "  ").otherwise(padded).alias("value"),
    )
    return cp.cleaned_insights(raw)


def _texts(items) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '\n')"


_REPORT = f"""{_BOOST}, {ENTITIES}, {_groups_sql('owner_id', 'eg', 8)}, {RELATIONS}, {SIGNALS},
dupg AS (SELECT owner_id, sha256({tb.sql_norm('content')}) AS h, count(*) AS c, min(created_at) AS t FROM mem GROUP BY ALL),
dup AS (SELECT owner_id, CAST(sum(c - 1) AS BIGINT) AS d FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY c DESC, t) AS r
  FROM dupg WHERE c > 1) WHERE r <= 10 GROUP BY 1),
labels AS (SELECT owner_id, count(DISTINCT label) FILTER (kind = 'people') AS l_people, count(DISTINCT label) FILTER (kind = 'projects') AS l_projects,
  count(DISTINCT label) FILTER (kind = 'tools') AS l_tools FROM hits GROUP BY 1),
tn AS (SELECT owner_id, list(name ORDER BY place) AS names FROM bt GROUP BY 1),
pe AS (SELECT owner_id, list(label ORDER BY place) AS names, first(cnt ORDER BY place) AS cnt, first(evidence ORDER BY place) AS ev FROM eg WHERE kind = 'people' GROUP BY 1),
pr AS (SELECT owner_id, list(label ORDER BY place) AS names, first(evidence ORDER BY place) AS ev FROM eg WHERE kind = 'projects' GROUP BY 1),
nrel AS (SELECT owner_id, count(*) AS n, list(relation || ' ' || target ORDER BY rank_in_report) AS edges FROM drel GROUP BY 1),
base AS (SELECT f.*, coalesce(d.d, 0) AS dups, l.*, tn.names AS themes, pe.names AS people, pe.cnt AS person_n, pe.ev AS person_ev,
   pr.names AS projects, pr.ev AS project_ev, coalesce(nrel.n, 0) AS n_rel, nrel.edges,
   (SELECT text FROM repr r WHERE r.owner_id = f.owner_id AND signal = 'routine' AND place = 1) AS routine,
   (SELECT text FROM repr r WHERE r.owner_id = f.owner_id AND signal = 'decision' AND place = 1) AS decision,
   (SELECT arg_min(relation, rank_in_report) FROM drel r WHERE r.owner_id = f.owner_id AND lower(r.target) = lower(pe.names[1])) AS related
  FROM flags f LEFT JOIN dup d USING (owner_id) LEFT JOIN (SELECT owner_id AS o, l_people, l_projects, l_tools FROM labels) l ON l.o = f.owner_id
  LEFT JOIN tn USING (owner_id) LEFT JOIN pe USING (owner_id) LEFT JOIN pr USING (owner_id) LEFT JOIN nrel USING (owner_id)),
parts AS (SELECT *, {_texts([f"CASE WHEN tension_{i} THEN {tb._q(t)} END" for i, (_, _, t) in enumerate(TENSIONS)])} AS tensions,
  {_texts([f"CASE WHEN {c} < {low} THEN {tb._q(t)} END" for c, (k, low, t) in zip(
      ['coalesce(l_people, 0)', 'coalesce(l_projects, 0)', 'coalesce(l_tools, 0)', 'n_routine', 'n_decision'], lx.COVERAGE_GAP_TESTS)])} AS gaps,
  {_texts([f"CASE WHEN dups > 0 THEN {tb._q(lx.RECOMMEND_DUPLICATES)} END", f"CASE WHEN low_quality > 0 THEN {tb._q(lx.RECOMMEND_LOW_QUALITY)} END",
      f"CASE WHEN n_rel < 4 THEN {tb._q(lx.RECOMMEND_RELATIONS)} END",
      f"CASE WHEN tension_0 OR tension_1 OR tension_2 THEN {tb._q(lx.RECOMMEND_TENSIONS)} END"])} AS recs,
  array_to_string(list_filter([CASE WHEN len(themes) > 0 THEN 'This corpus concentrates on ' || array_to_string(themes[1:3], ', ')
      || ', with repeated memory traffic around those domains.' END,
    CASE WHEN n_working_style > 0 OR n_preference > 0 THEN {tb._q(lx.PERSONA_STYLE)} END,
    CASE WHEN n_goal > 0 OR n_decision > 0 THEN {tb._q(lx.PERSONA_GOALS)} END,
    CASE WHEN n_routine > 0 THEN {tb._q(lx.PERSONA_ROUTINES)} END], lambda x: x IS NOT NULL), ' ') AS persona FROM base)"""


def _report(spark, sf):
    return cp.corpus_report(
        tb.documents(spark, sf), chunk_size=CHUNK, lexicons=LEXICONS, tension_tests=TENSIONS, leads=LEADS
    )


@query(
    "corpus_report",
    f"""WITH {_REPORT} SELECT owner_id, coalesce(nullif(persona, ''), {tb._q(lx.PERSONA_EMPTY)}) AS persona_summary,
      array_to_string(coalesce(themes, []), ',') AS themes, array_to_string(coalesce(people, []), ',') AS people,
      array_to_string(coalesce(projects, []), ',') AS projects, array_to_string(coalesce(edges[1:10], []), ',') AS edges,
      tensions, gaps AS coverage_gaps, coalesce(nullif(recs, ''), {tb._q(lx.RECOMMEND_HEALTHY)}) AS recommendations, dups AS duplicate_count,
      {_texts(["CASE WHEN projects[1] IS NOT NULL OR themes[1] IS NOT NULL THEN 'Focus area: ' || coalesce(projects[1], themes[1]) END",
        "CASE WHEN people[1] IS NOT NULL THEN 'Key collaborator: ' || people[1] END",
        "CASE WHEN routine IS NOT NULL THEN 'Stable routine detected' END",
        "CASE WHEN coalesce(decision, nullif(tensions, '')) IS NOT NULL THEN 'Decision pattern' END",
        "CASE WHEN dups > 0 OR low_quality > 0 THEN 'Memory hygiene opportunity' END",
        "CASE WHEN gaps <> '' THEN 'Coverage opportunity' ELSE 'Next enrichment opportunity' END"])} AS discovery_titles,
      CASE WHEN people[1] IS NULL THEN NULL WHEN related IS NOT NULL THEN people[1] || ' appears as a repeated collaborator with an explicit ' || related
        || ' signal, which makes this relationship strong enough to operationalize later.' ELSE people[1] || ' appears across '
        || CAST(person_n AS VARCHAR) || ' memories, which makes them one of the clearest human anchors in the corpus.' END AS collaborator,
      array_to_string(list_concat(coalesce(project_ev, []), coalesce(person_ev, []))[1:6], ',') AS focus_evidence,
      CAST(least(len(coalesce(themes, [])), 4) + least(len(coalesce(people, [])), 2) + least(len(coalesce(projects, [])), 2) AS BIGINT) AS node_count
    FROM parts""",
)
def corpus_report(spark, sf):
    def card(kind: str):
        return F.get(F.filter("discoveries", lambda d: d["kind"] == kind), F.lit(0))

    report = _report(spark, sf)
    return report.select(
        "owner_id",
        "persona_summary",
        F.array_join(F.transform("themes", lambda x: x["name"]), ",").alias("themes"),
        F.array_join(F.transform("people", lambda x: x["label"]), ",").alias("people"),
        F.array_join(F.transform("projects", lambda x: x["label"]), ",").alias("projects"),
        F.array_join(F.transform("edges", lambda x: F.concat_ws(" ", x["relation"], x["target"])), ",").alias("edges"),
        F.array_join("tensions", "\n").alias("tensions"),
        F.array_join("coverage_gaps", "\n").alias("coverage_gaps"),
        F.array_join("recommendations", "\n").alias("recommendations"),
        "duplicate_count",
        F.array_join(F.transform("discoveries", lambda x: x["title"]), "\n").alias("discovery_titles"),
        card("collaborator")["summary"].alias("collaborator"),
        F.array_join(card("focus_area")["evidence"], ",").alias("focus_evidence"),
        F.size("nodes").cast("bigint").alias("node_count"),
    )


@query("report_documents")
def report_documents(spark, sf):
    return cp.report_document(_report(spark, sf))


@query(
    "report_files",
    f"""WITH {_REPORT} SELECT (SELECT count(*) FROM mem m WHERE m.owner_id = p.owner_id) AS memory_count,
      (SELECT count(*) FROM u WHERE u.owner_id = p.owner_id) AS deduplicated_count, dups AS duplicate_count,
      array_to_string(coalesce(themes, []), ',') AS themes, coalesce(nullif(persona, ''), {tb._q(lx.PERSONA_EMPTY)}) AS persona_summary,
      coalesce(nullif(recs, ''), {tb._q(lx.RECOMMEND_HEALTHY)}) AS recommendations FROM parts p""",
)
def report_files(spark, sf):
    """The report documents written as JSON and read again."""
    path = tb.fresh_folder(spark, "reports")
    sinks.write_report_documents(cp.report_document(_report(spark, sf)), path)
    schema = """overview struct<memoryCount: bigint, deduplicatedMemoryCount: bigint>, persona struct<summary: string>,
      themeLandscape struct<highlights: array<struct<name: string>>>, quality struct<duplicateMemoryCount: bigint>, recommendations array<string>"""
    return spark.read.schema(schema).json(path).select(
        F.col("overview.memoryCount").alias("memory_count"),
        F.col("overview.deduplicatedMemoryCount").alias("deduplicated_count"),
        F.col("quality.duplicateMemoryCount").alias("duplicate_count"),
        F.array_join("themeLandscape.highlights.name", ",").alias("themes"),
        F.col("persona.summary").alias("persona_summary"),
        F.array_join("recommendations", "\n").alias("recommendations"),
    )
