"""Rules, classification, facets and batch aggregates over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions.binding import computed
from engram.functions import text as tx
from engram.functions.tokens import facet_tokens, top_tokens
from engram.operators import aggregate as ag
from engram.operators import classify as cl
from engram.operators import dedupe as dd
from engram.operators import rules as ru
from engram.plans import tables as tb
from engram.plans.registry import query
from engram.session import materialize

CATEGORIES = ru.category_order([r.category for r in tb.RULES])

# --- SQL twins ----------------------------------------------------------------

HITS = f"""{tb.MEM}, {tb.RULES_SQL}, {tb.PRIORITY_SQL},
norm AS (SELECT *, {tb.sql_norm('content')} AS nc FROM mem),
hits AS (SELECT n.id, r.category, r.weight FROM norm n JOIN rules r ON
  CASE WHEN r.match_type = 'regex' THEN regexp_matches(n.nc, r.pattern, 'i') ELSE contains(n.nc, lower(r.pattern)) END),
scores AS (SELECT id, category, CAST(sum(weight) AS BIGINT) AS score FROM hits GROUP BY ALL)"""

_TOKEN = "[\\p{L}\\p{N}]+(?:[._''][\\p{L}\\p{N}]+)*"
TOKENS = f"""facets AS (SELECT *, list_filter(list_transform(regexp_extract_all(content, '{_TOKEN}'), lambda t: lower(t)),
  lambda t: length(t) > 1 AND t NOT IN {tb.sql_list(lx.FACET_STOPWORDS)}) AS toks FROM mem),
words AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM facets),
counted AS (SELECT id, t, count(*) AS n, min(pos) AS pos FROM words GROUP BY ALL),
tags AS (SELECT id, t AS tag, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS r FROM counted)
  WHERE r <= 5)"""


def _fallback_sql(available) -> str:
    default = next((c for c in lx.DEFAULT_CATEGORIES if c in available), available[0])
    whens = " ".join(
        f"WHEN regexp_matches(joined, {tb._q(p)}, 'i') THEN {tb._q(next((c for c in cs if c in available), default))}"
        for p, cs in lx.FALLBACK_TESTS
    )
    return f"CASE {whens} ELSE {tb._q(default)} END"


CLASSIFIED = f"""{HITS}, {TOKENS},
best AS (SELECT s.id, s.category, s.score, row_number() OVER (PARTITION BY s.id ORDER BY s.score DESC, coalesce(p.p, 29), s.category) AS r,
  sum(s.score) OVER (PARTITION BY s.id) AS total FROM scores s LEFT JOIN prio p USING (category)),
classified AS (SELECT f.id, f.doc_id, f.owner_id, f.created_at, coalesce(b.category, f.fallback) AS category,
    CASE WHEN b.id IS NULL THEN 0.35 ELSE {tb.sql_ratio2('CAST(b.score AS BIGINT)', 'CAST(b.total AS BIGINT)')} END AS confidence
  FROM (SELECT *, {_fallback_sql(CATEGORIES)} AS fallback FROM (SELECT *, array_to_string(toks, ' ') AS joined FROM facets)) f
  LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (id))"""


def _classified(spark, sf, tags=5):
    return cl.classify(tb.documents(spark, sf), tb.RULES, tags)


@query("rule_match_scores", f"WITH {HITS} SELECT id, category, score FROM scores")
def rule_match_scores(spark, sf):
    return cl.rule_scores(tb.documents(spark, sf), tb.RULES).drop("owner_id")


# Many rules, taken from the benchmark texts: every pair of neighbouring words is a phrase.
_BIG = f"""bwords AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
    (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark)),
pairs AS (SELECT a.w || ' ' || b.w AS pattern, min(a.item_id) AS item FROM bwords a JOIN bwords b
    ON a.item_id = b.item_id AND b.i = a.i + 1 GROUP BY ALL)"""


def phrase_rules(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = (
        tb.table(spark, sf, "benchmark")
        .select("item_id", words.alias("ws"))
        .filter(F.size("ws") > 1)
        .select(
            "item_id",
            F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.array_join(F.slice("ws", i, 2), " "))).alias(
                "pattern"
            ),
        )
        .groupBy("pattern")
        .agg(F.min("item_id").alias("item"))
    )
    order = F.array(*[F.lit(c) for c in lx.CATEGORY_PRIORITY])
    return pairs.select(
        F.get(order, (F.col("item") % 29).cast("int")).alias("category"),
        F.lit("phrase").alias("match_type"),
        "pattern",
        (1 + F.length("pattern") % 7).alias("weight"),
    )


@query(
    "rule_match_large",
    f"""WITH {tb.MEM}, {tb.PRIORITY_SQL}, {_BIG},
    norm AS (SELECT id, {tb.sql_norm('content')} AS nc FROM mem)
    SELECT n.id, prio.category, CAST(sum(1 + length(p.pattern) % 7) AS BIGINT) AS score
    FROM norm n JOIN pairs p ON contains(n.nc, p.pattern) JOIN prio ON prio.p = p.item % 29 GROUP BY ALL""",
)
def rule_match_large(spark, sf):
    return cl.literal_scores(tb.documents(spark, sf), phrase_rules(spark, sf)).drop("owner_id")


@query("classify_confidence", f"WITH {CLASSIFIED} SELECT id, category, confidence FROM classified")
def classify_confidence(spark, sf):
    return _classified(spark, sf).select("id", "category", "confidence")


@query("low_confidence", f"WITH {CLASSIFIED} SELECT id, category, confidence FROM classified WHERE confidence < 0.4")
def low_confidence(spark, sf):
    return cl.low_confidence(_classified(spark, sf), 0.4).select("id", "category", "confidence")


@query(
    "memory_tags",
    f"WITH {tb.MEM}, {TOKENS} SELECT id, string_agg(tag, ' ' ORDER BY r) AS tags FROM tags GROUP BY id",
)
def memory_tags(spark, sf):
    df = computed(tb.documents(spark, sf).select("id", "content"), "tags", top_tokens(facet_tokens(F.col("content"))))
    return df.filter(F.size("tags") > 0).select("id", F.array_join("tags", " ").alias("tags"))


@query(
    "facet_stats",
    f"""WITH {tb.MEM}, {TOKENS}, c AS (SELECT owner_id, tag, count(*) AS n FROM tags JOIN mem USING (id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, tag) AS place FROM c)
    SELECT owner_id, tag, n AS "count", place FROM r WHERE place <= 50""",
)
def facet_stats(spark, sf):
    return ag.facet_stats(ag.tag_counts(_classified(spark, sf), ["owner_id"]), ["owner_id"], "tag")


_DEDUPED = f"""{CLASSIFIED}, kept AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY owner_id,
   {tb.sql_norm('content')} ORDER BY created_at, id) AS r FROM mem) WHERE r = 1),
cc AS (SELECT owner_id, category, count(*) AS n FROM classified JOIN kept USING (id) GROUP BY ALL),
filled AS (SELECT o.owner_id, u.category, coalesce(cc.n, 0) AS n FROM (SELECT DISTINCT owner_id FROM cc) o
   CROSS JOIN (SELECT DISTINCT category FROM rules) u LEFT JOIN cc USING (owner_id, category)),
total AS (SELECT owner_id, sum(n) AS t FROM filled GROUP BY 1)"""


@query(
    "category_cards",
    f"""WITH {_DEDUPED} SELECT f.owner_id, f.category, CAST(f.n AS BIGINT) AS "count",
      {tb.sql_ratio2('CAST(f.n AS BIGINT)', 'CAST(t.t AS BIGINT)')} AS share,
      row_number() OVER (PARTITION BY f.owner_id ORDER BY f.n DESC, prio.p) AS place
    FROM filled f JOIN total t USING (owner_id) JOIN prio USING (category)""",
)
def category_cards(spark, sf):
    """Flagship: distinct texts per owner, classified, as category cards."""
    hashed = tb.documents(spark, sf).withColumn("content_hash", tx.content_hash(tx.normalized(F.col("content"))))
    # classifying is row work, so it goes first: one scan, and no text in any shuffle
    classified = dd.first_copy(cl.classify(hashed, tb.RULES), ["category"])
    return ag.cards(ag.category_counts(classified, ["owner_id"], CATEGORIES), ["owner_id"])


_BATCH = f"""{CLASSIFIED}, cc AS (SELECT owner_id AS job_id, doc_id // 100 AS batch_index, category, count(*) AS n
   FROM classified GROUP BY ALL),
filled AS (SELECT o.job_id, o.batch_index, u.category, coalesce(cc.n, 0) AS n
   FROM (SELECT DISTINCT job_id, batch_index FROM cc) o CROSS JOIN (SELECT DISTINCT category FROM rules) u
   LEFT JOIN cc USING (job_id, batch_index, category)),
total AS (SELECT job_id, batch_index, sum(n) AS t FROM filled GROUP BY ALL),
ranked AS (SELECT f.*, t.t, row_number() OVER (PARTITION BY f.job_id, f.batch_index ORDER BY f.n DESC, prio.p) AS place
   FROM filled f JOIN total t USING (job_id, batch_index) JOIN prio USING (category))"""
_BATCH_KEYS = ["job_id", "batch_index"]


def _batches(spark, sf):
    """Verdicts without the texts, written down once because every batch result reads them several times."""
    index = F.floor(F.col("doc_id") / 100).cast("bigint")
    return materialize(
        _classified(spark, sf).select(F.col("owner_id").alias("job_id"), index.alias("batch_index"), "category", "tags")
    )


def _batch_cards(classified):
    return ag.cards(ag.category_counts(classified, _BATCH_KEYS, CATEGORIES), _BATCH_KEYS, top=3)


@query(
    "batch_cards",
    f"""WITH {_BATCH} SELECT job_id, batch_index, category, CAST(n AS BIGINT) AS "count",
      {tb.sql_ratio2('CAST(n AS BIGINT)', 'CAST(t AS BIGINT)')} AS share, place FROM ranked WHERE place <= 3""",
)
def batch_cards(spark, sf):
    return _batch_cards(_batches(spark, sf))


@query(
    "batch_summaries",
    f"""WITH {_BATCH}, tc AS (SELECT m.owner_id AS job_id, m.doc_id // 100 AS batch_index, tag, count(*) AS n
        FROM tags JOIN mem m USING (id) GROUP BY ALL),
      tt AS (SELECT job_id, batch_index, string_agg(tag, ' ' ORDER BY r) AS top_tags FROM (SELECT *, row_number() OVER
        (PARTITION BY job_id, batch_index ORDER BY n DESC, tag) AS r FROM tc) WHERE r <= 5 GROUP BY ALL)
    SELECT job_id, batch_index, string_agg(category || ':' || CAST(n AS VARCHAR), ',' ORDER BY place) AS summary, any_value(top_tags) AS top_tags
    FROM ranked JOIN tt USING (job_id, batch_index) WHERE place <= 3 AND n > 0 GROUP BY ALL""",
)
def batch_summaries(spark, sf):
    classified = _batches(spark, sf)
    summary = ag.summary_strings(_batch_cards(classified), _BATCH_KEYS)
    tags = ag.top_tags(ag.tag_counts(classified, _BATCH_KEYS), _BATCH_KEYS)
    return summary.join(tags, _BATCH_KEYS).withColumn("summary", F.array_join("summary", ","))


@query(
    "job_merge",
    f"""WITH {_BATCH}, done AS (SELECT job_id, count(DISTINCT batch_index) AS completed_batches,
        CAST(sum(n) AS BIGINT) AS processed_memories FROM cc GROUP BY 1),
      lastb AS (SELECT job_id, max(batch_index) AS batch_index FROM cc GROUP BY 1),
      summ AS (SELECT job_id, string_agg(category || ':' || CAST(n AS VARCHAR), ',' ORDER BY place) AS summary
        FROM ranked JOIN lastb USING (job_id, batch_index) WHERE place <= 3 AND n > 0 GROUP BY 1),
      k AS (SELECT job_id, 'category' AS kind, category AS key, CAST(sum(n) AS BIGINT) AS c FROM filled GROUP BY ALL
        UNION ALL SELECT owner_id, 'tag', tag, count(*) FROM tags JOIN mem USING (id) GROUP BY ALL)
    SELECT job_id, kind, key, c AS "count", completed_batches, processed_memories, completed_batches AS result_version, summary
    FROM k JOIN done USING (job_id) JOIN summ USING (job_id)""",
)
def job_merge(spark, sf):
    classified = _batches(spark, sf)
    categories = ag.category_counts(classified, _BATCH_KEYS, CATEGORIES)
    batches = (
        categories.groupBy(*_BATCH_KEYS)
        .agg(F.sum("count").alias("processed"))
        .join(ag.summary_strings(_batch_cards(classified), _BATCH_KEYS), _BATCH_KEYS)
        .withColumn("version", F.col("batch_index"))
    )
    deltas = categories.select(*_BATCH_KEYS, F.lit("category").alias("kind"), F.col("category").alias("key"), "count").unionByName(
        ag.tag_counts(classified, _BATCH_KEYS).select(*_BATCH_KEYS, F.lit("tag").alias("kind"), F.col("tag").alias("key"), "count")
    )
    progress, counts = ag.merge_job(batches, deltas)
    return counts.join(progress.withColumn("summary", F.array_join("summary", ",")), "job_id")


_COVER = [c for c in lx.CATEGORY_PRIORITY if c not in ("activity", "identity")]


@query(
    "coverage_report",
    f"""WITH {tb.MEM}, {tb.RULES_SQL}, p27(category, p) AS (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(_COVER))}),
      hits AS (SELECT m.id, r.category, sum(r.weight) AS s FROM mem m JOIN rules r ON CASE WHEN r.match_type = 'regex'
        THEN regexp_matches(m.content, r.pattern, 'i') ELSE contains(lower(m.content), lower(r.pattern)) END GROUP BY ALL),
      win AS (SELECT id, category FROM (SELECT h.*, row_number() OVER (PARTITION BY id ORDER BY s DESC, coalesce(p, 27), category) AS r
        FROM hits h LEFT JOIN p27 USING (category)) WHERE r = 1),
      tok AS (SELECT unnest(regexp_extract_all(lower(content), '[a-z][a-z0-9_./+-]{{2,}}|\\p{{Han}}{{2,}}')) AS name
        FROM mem WHERE id NOT IN (SELECT id FROM win))
    SELECT 'totals' AS section, 'total' AS name, count(*) AS n FROM mem
    UNION ALL SELECT 'totals', 'matched', count(*) FROM win
    UNION ALL SELECT 'totals', 'unmatched', count(*) FROM mem WHERE id NOT IN (SELECT id FROM win)
    UNION ALL (SELECT 'category', category, count(*) AS n FROM win GROUP BY ALL ORDER BY n DESC, category LIMIT 20)
    UNION ALL (SELECT 'unmatched_token', name, count(*) AS n FROM tok GROUP BY ALL ORDER BY n DESC, name LIMIT 30)""",
)
def coverage_report(spark, sf):
    return cl.coverage_report(cl.coverage(tb.documents(spark, sf), tb.RULES))


# --- rule generation from the part table -------------------------------------


def _terms(spark, sf):
    part = tb.table(spark, sf, "part").select(
        F.col("p_brand").alias("category"),
        F.upper("p_brand").alias("label"),
        F.when(F.col("p_size") % 2 == 0, "en-US").otherwise("zh-CN").alias("lang"),
        "p_partkey",
        "p_name",
        "p_type",
    )
    key = F.col("p_partkey")
    kind = (
        F.when(key % 5 == 0, "keyword").when(key % 5 == 1, "phrase").when(key % 5 == 2, "weak").when(key % 5 == 3, "term")
    ).otherwise("template")
    text = F.when(key % 5 == 4, F.concat(F.lit("{term} for "), F.lower("p_type"))).otherwise(
        F.when(key % 10 == 5, F.concat(F.initcap("p_name"), F.lit(" v1.2+"))).otherwise(F.col("p_name"))
    )
    return part.select("category", "label", "lang", kind.alias("kind"), key.alias("pos"), text.alias("text"))


_GEN = r"""t AS (SELECT p_brand AS category, upper(p_brand) AS label, CASE WHEN p_size % 2 = 0 THEN 'en-US' ELSE 'zh-CN' END AS lang,
    CASE p_partkey % 5 WHEN 0 THEN 'keyword' WHEN 1 THEN 'phrase' WHEN 2 THEN 'weak' WHEN 3 THEN 'term' ELSE 'template' END AS kind,
    p_partkey AS pos, CASE WHEN p_partkey % 5 = 4 THEN '{term} for ' || lower(p_type)
      WHEN p_partkey % 10 = 5 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' v1.2+'
      ELSE p_name END AS txt FROM part),
  k(kind, match_type, weight, place) AS (VALUES ('keyword','keyword',5,0),('phrase','phrase',7,1),('weak','keyword',3,2),
    ('regex','regex',7,3),('term','keyword',5,4)),
  raw AS (SELECT category, label, lang, match_type, txt AS pattern, weight, place, 0 AS tp, pos FROM t JOIN k USING (kind)
    UNION ALL SELECT a.category, a.label, a.lang, 'phrase', replace(b.txt, '{term}', a.txt), 5, 5, b.pos, a.pos
    FROM t a JOIN t b ON a.kind = 'term' AND b.kind = 'template' AND a.category = b.category AND a.lang = b.lang),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, lang, match_type, lower(pattern)
    ORDER BY place, tp, pos) AS r FROM raw) WHERE r = 1),
  slugs AS (SELECT *, 'v9-' || lang || '-' || category || '-' || regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(pattern),
    '''', ''), '+', 'plus'), '[^\p{L}\p{N}_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS base FROM firsts),
  rules AS (SELECT base || CASE WHEN c > 1 THEN '-' || CAST(c AS VARCHAR) ELSE '' END AS id, category, label, lang, match_type,
    pattern, weight FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY place, tp, pos) AS c FROM slugs))"""


def _generated(spark, sf):
    return ru.generate_rules(_terms(spark, sf), "v9")


@query("rule_generation", f"WITH {_GEN} SELECT * FROM rules")
def rule_generation(spark, sf):
    return _generated(spark, sf).drop("version", "enabled")


@query(
    "rule_qa",
    f"""WITH {_GEN}, c AS (SELECT category, count(*) AS n, count_if(lang = 'zh-CN') AS zh, count_if(lang = 'en-US') AS en,
      count_if(match_type = 'keyword') AS kw, count_if(match_type = 'phrase') AS ph, count_if(match_type = 'regex') AS rx FROM rules GROUP BY 1)
    SELECT category, n AS rule_count, 'rule_count' AS problem FROM c WHERE n NOT BETWEEN 100 AND 150
    UNION ALL SELECT category, n, 'language' FROM c WHERE zh = 0 OR en = 0
    UNION ALL SELECT category, n, 'no_keyword' FROM c WHERE kw = 0
    UNION ALL SELECT category, n, 'no_phrase' FROM c WHERE ph = 0
    UNION ALL SELECT category, n, 'no_regex' FROM c WHERE category IN ('Brand#1', 'Brand#2') AND rx = 0""",
)
def rule_qa(spark, sf):
    return ru.rule_violations(_generated(spark, sf), high_value=("Brand#1", "Brand#2"))


@query("rule_counts", f"WITH {_GEN} SELECT category, lang, count(*) AS rule_count FROM rules GROUP BY ALL")
def rule_counts(spark, sf):
    return ru.rule_counts(_generated(spark, sf))


@query(
    "category_universe",
    f"""WITH {_GEN}, {tb.PRIORITY_SQL}, x AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'policy' WHEN p_size % 3 = 1 THEN 'task'
       ELSE p_brand END AS category FROM part)
    SELECT category, coalesce(p, 29) AS priority FROM x LEFT JOIN prio USING (category)""",
)
def category_universe(spark, sf):
    size = F.col("p_size")
    rules = tb.table(spark, sf, "part").select(
        F.when(size % 3 == 0, "policy").when(size % 3 == 1, "task").otherwise(F.col("p_brand")).alias("category")
    )
    return ru.categories(rules)


@query(
    "rule_text_parse",
    """SELECT 'v3-en-' || CAST(p_partkey AS VARCHAR) AS id, 'v3' AS version, p_brand AS category, p_type AS label, 'en-US' AS lang,
      'keyword' AS match_type, p_name || '''s' AS pattern, p_size AS weight FROM part WHERE p_partkey % 3 <> 0""",
)
def rule_text_parse(spark, sf):
    key = F.col("p_partkey").cast("string")
    row = F.concat(
        F.lit("  ('v3-en-"), key, F.lit("', 'v3', '"), "p_brand", F.lit("', '"), "p_type", F.lit("', 'en-US', 'keyword', '"),
        "p_name", F.lit("''s', "), F.col("p_size").cast("string"), F.lit(", true),"),
    )
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-- "), row)).otherwise(row)
    parsed = ru.parse_rule_lines(tb.table(spark, sf, "part").select(line.alias("value")))
    return parsed.drop("enabled")
