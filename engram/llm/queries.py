"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import ann, copies, decontaminate, html_text, lines, merkle, mixing, near, quality, secrets, toxicity, urls, whitening
from engram.llm.store import small_batches, table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, by beam search in pruned graphs."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a linear scorer trained on weak labels."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 80 % of their two-word shingles, by chosen paths."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, by one automaton for all rules."""
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page by rules, or by boosted trees on the spelling of its URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, exactly or nearly, a line kept elsewhere."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document, by the cube method."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by boosted trees, calibrated."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by line-block distribution."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat ten words of a benchmark item, by a suffix automaton."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector, by a bidiagonal qd solver."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, and which rows no longer fit after tampering."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by composable fingerprints, compared piece by piece."""
    return copies.copies(table(spark, sf_dir, "documents"))


def _registered(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {
    f.__name__: _registered(f)
    for f in (
        op1_nearest,
        op2_quality,
        op3_near_duplicates,
        op4_url_filter,
        op5_dedup_lines,
        op6_mix_sources,
        op7_toxicity,
        op8_html_text,
        op9_decontaminate,
        op10_secrets,
        op11_whiten,
        op12_manifest,
        op13_exact_dedup,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = rf'''
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[k:k + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT row_id, k, n, array_to_string(words[k:k + n - 1], ' ') AS win
  FROM (SELECT row_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, sizes WHERE len(words) >= n)),
met AS (SELECT row_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY 1),
ids AS (SELECT row_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids
        FROM met GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN ids USING (row_id)'''

OP3_SQL = rf'''
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words[1] ELSE words[k] || ' ' || words[k + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id WHERE r.m < e.y),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)'''

OP13_SQL = f'''
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce({_LOWER}, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)'''

def _merkle_levels(prefix: str, count: int) -> str:
    """Levels of FAN nodes of the trees in ``prefix``_0 (tree, r, h); at each level left and right siblings of every node."""
    parts = []
    for k in range(count):
        here, up = f"{prefix}_{k}", f"{prefix}_{k + 1}"
        parts.append(f"""
{here}n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {here}),
{here}s AS (SELECT tree, r, n,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, r // 8 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, r // 8 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t
    FROM {here}n),
{up} AS (SELECT tree, r // 8 AS r, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h
    FROM {here}n GROUP BY tree, r // 8)""")
    return ",".join(parts)


def _merkle_folds(start: str, prefix: str, rank: str, tree: str, count: int) -> str:
    """``prefix``f_k: the rows of ``start`` (f, proof so far) after the first k levels."""
    parts, before = [], start
    for k in range(count):
        step = f"{prefix}f_{k + 1}"
        parts.append(f"""
{step} AS (SELECT x.* REPLACE (CASE WHEN s.n = 1 THEN x.f ELSE sha256(s.l || x.f || s.t) END AS f, x.proof || s.l || s.t AS proof)
    FROM {before} x JOIN {prefix}_{k}s s ON s.tree = x.{tree} AND s.r = x.{rank} // {8**k})""")
        before = step
    return ",".join(parts)


#: Levels that the SQL twin unrolls: 8^6 rows a language and 64 languages.
_DEEP, _WIDE = 6, 2
_CODED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in merkle.FIELDS)
_CRC_STEPS = "flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_STEPS}),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

OP12_SQL = f'''
WITH d AS (SELECT CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, doc_id, sha256({_CODED}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_CODED.replace("text", _LOWER)}) END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
a_0 AS (SELECT tree, rank AS r, leaf AS h FROM leaves),
{_merkle_levels("a", _DEEP)},
tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place FROM a_{_DEEP}),
b_0 AS (SELECT 0 AS tree, place AS r, h FROM tops),
{_merkle_levels("b", _WIDE)},
starts AS (SELECT doc_id, leaf, tree, rank, coalesce(changed, leaf) AS f, '' AS proof FROM leaves),
{_merkle_folds("starts", "a", "rank", "tree", _DEEP)},
grown AS (SELECT x.*, 0 AS over_all, t.place, t.h AS subroot FROM af_{_DEEP} x JOIN tops t USING (tree)),
{_merkle_folds("grown", "b", "place", "over_all", _WIDE)}
SELECT doc_id, leaf, subroot, (SELECT h FROM b_{_WIDE}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM b_{_WIDE}) AS verified
FROM bf_{_WIDE}'''

ORACLES: dict[str, str] = {"op3_near_duplicates": OP3_SQL, "op9_decontaminate": OP9_SQL, "op12_manifest": OP12_SQL, "op13_exact_dedup": OP13_SQL}
