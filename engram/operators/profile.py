"""User profile: which memories say something lasting, profile items, and the profile summary.

Input is the profile scan, at most 50 memories per owner, so per-owner lists below are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import profile_lexicons as pl
from engram.functions import metadata as md
from engram.functions import text as tx
from engram.functions.lexicon import mentions
from engram.operators.ranking import top_per_group, union_all
from engram.session import materialize

ITEMS_PER_KIND = 10
SUMMARY_EVIDENCE = 5
ITEM_EVIDENCE = 3
KINDS = tuple(pl.ITEM_LABELS)


def _with_terms(pattern: str, terms: Sequence[str]) -> str:
    return "|".join([pattern, *terms])


def flagged(memories: DataFrame, newest_first: bool = True, product_terms: Sequence[str] = ()) -> DataFrame:
    """Profile memories with everything their texts say, worked out once and written down.

    Adds pos, the classification flags, item kinds, facets, persona signals, score and quote.  All steps below
    read this table several times and touch no pattern again.
    """
    c, v, low = F.col("content"), F.col("__v"), F.col("__low")
    time = F.desc("created_at") if newest_first else F.asc("created_at")
    df = memories.filter(F.lower("memory_type").isin("fact", "insight", "pinned")).withColumns(
        {
            "pos": F.row_number().over(Window.partitionBy("owner_id").orderBy(time, F.asc("id"))).cast("bigint"),
            "__v": md.parsed(F.col("metadata_json")),
            "__m": F.from_json("metadata_json", "map<string,string>"),
        }
    )
    # few bytes but much work per row: deal the rows out evenly
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(slices, "owner_id", "id").withColumn("__low", F.lower(c))
    meta = F.coalesce(
        F.concat(F.map_keys("__m"), F.map_values("__m")), F.array().cast("array<string>")
    )
    df = df.withColumn("__meta", F.transform(meta, F.lower)).withColumn(
        "__labels", F.concat_ws(" ", F.lower(F.array_join("tags", " ")), F.array_join("__meta", " "))
    )
    hay = F.concat_ws(" ", low, F.col("__labels"))

    def metamentions(pattern: str) -> Column:
        return F.exists("__meta", lambda x: mentions(x, pattern))

    def either(pattern: str) -> Column:
        return mentions(low, pattern) | metamentions(pattern)

    def has(text: Column, tokens: Sequence[str]) -> Column:
        tests = [F.contains(text, F.lit(t.lower())) for t in tokens]
        out = tests[0]
        for t in tests[1:]:
            out |= t
        return out

    item_kind = F.coalesce(*[F.when(has(hay, [k, label]), k) for k, label in pl.ITEM_LABELS.items()])
    raw_kind = md.string_of(v, ["attributeKind", "profileKind", "profile_attribute", "category", "kind"])
    kind_key = F.regexp_replace(F.lower(raw_kind), r"[ -]+", "_")
    explicit = F.coalesce(
        *[F.when((kind_key == k) | (raw_kind == label), k) for k, label in pl.ATTRIBUTE_LABELS.items()]
    )
    guessed = F.when(
        ~mentions(low, pl.DISLIKE),
        F.coalesce(*[F.when(either(p), k) for k, p in pl.ATTRIBUTE_LEXICONS.items()]),
    )
    df = df.withColumns(
        {
            "is_summary": mentions(tx.collapsed(low), pl.SUMMARY_PREFIX) | has(F.col("__labels"), pl.SUMMARY_TOKENS),
            "item_kind": item_kind,
            "product_or_doc": mentions(low, pl.PRODUCT_OR_DOC) & ~mentions(low, pl.ABOUT_USER),
            "file_or_demo": mentions(low, pl.FILE_OR_DEMO),
            "fact_only": mentions(low, pl.FACT_ONLY),
            "temporal_plan": mentions(low, pl.TEMPORAL_PLAN),
            "ephemeral": mentions(low, pl.EPHEMERAL),
            "robot_constraint": mentions(low, pl.CONSTRAINT) & (mentions(low, pl.ROBOT_TARGET) | mentions(low, pl.ROBOT_BEHAVIOR)),
            "companion_style": (mentions(low, pl.PREFERENCE) | mentions(low, pl.PREFERENCE_WIDE)) & mentions(low, pl.COMPANION_TARGET),
            "explicit_attribute": explicit,
            "attribute_kind": F.coalesce(explicit, guessed),
            "lasting_words": either("|".join([pl.STABLE, *pl.ATTRIBUTE_LEXICONS.values(), pl.PERSONA, pl.PREFERENCE, pl.DISLIKE, pl.WORK_STYLE])),
            "priority_words": mentions(low, pl.PRIORITY),
            "plan_words": mentions(low, pl.PLAN_CONTENT),
            "facets": _facet_hits(either),
            "signals": text_signals(tx.collapsed(low), product_terms),
            "score": md.memory_score(v, F.col("memory_type"), F.col("tags")),
            "quote": tx.preview(c, 180),
            "m_title": md.string_of(v, ["title", "label", "name", "summary"]),
            "m_summary": md.string_of(v, ["summary", "description", "content"]),
            "m_value": md.string_of(v, ["value", "summary", "description", "content"]),
        }
    )
    usable = ~(
        F.col("is_summary")
        | F.col("item_kind").isNotNull()
        | F.col("robot_constraint")
        | F.col("product_or_doc")
        | F.col("fact_only")
        | F.col("file_or_demo")
    )
    named = F.col("explicit_attribute").isNotNull() & (F.col("explicit_attribute") != "current_project")
    lasting = F.when(named, ~F.col("ephemeral")).otherwise(
        ~F.col("temporal_plan") & ~F.col("ephemeral") & F.col("lasting_words")
    )
    return materialize(
        df.withColumn("stable", usable & lasting).drop("__v", "__m", "__meta", "__low", "__labels", "lasting_words")
    )


def _matches(kind: str) -> Column:
    free = ~(F.col("product_or_doc") | F.col("file_or_demo"))
    own = {
        "current_priority": F.col("priority_words"),
        "companion_style": free & F.col("companion_style"),
        "robot_constraint": free & F.col("robot_constraint"),
    }[kind]
    return F.when(F.col("item_kind").isNotNull(), F.col("item_kind") == kind).otherwise(own)


def _rounded(x: Column) -> Column:
    return F.floor(F.round(x, 6) + F.lit(0.5)).cast("bigint")


def _evidence_ids(rows: DataFrame, keys: Sequence[str], order: str, limit: int, name: str = "evidence") -> DataFrame:
    """First ``limit`` distinct memory ids per key by ``order``."""
    first = rows.groupBy(*keys, "id").agg(F.min(order).alias("o"))
    kept = top_per_group(first, keys, [F.asc("o")], limit, rank="r")
    return kept.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias(name)
    )


def item_candidates(flags: DataFrame) -> DataFrame:
    """Item memories grouped by title: owner_id, kind, key, title, summary, first_pos, importance, members."""
    c = F.col("content")
    rows = union_all(
        [
            flags.filter(~F.col("is_summary") & _matches(kind)).select(
                "owner_id",
                F.lit(kind).alias("kind"),
                "pos",
                "id",
                "score",
                F.coalesce("m_title", tx.first_sentence(tx.strip_label(c)), F.lit(pl.ITEM_LABELS[kind])).alias("title"),
                F.coalesce("m_summary", tx.collapsed(c)).alias("summary"),
            )
            for kind in KINDS
        ]
    )
    return rows.withColumn("key", F.lower(tx.collapsed(F.col("title")))).groupBy("owner_id", "kind", "key").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("title", "pos").alias("title"),
        F.min_by("summary", "pos").alias("summary"),
        F.sum("score").alias("importance"),
        # a title's memories: at most the 50 of the scan
        F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("members"),
    )


def _sources(candidates: DataFrame, flags: DataFrame, kind: str, extra: Column) -> DataFrame:
    """Texts pooled for made-up items: the candidates first, then the memories that pass ``extra``."""
    own = candidates.filter(F.col("kind") == kind).select(
        "owner_id",
        F.concat_ws(" ", "title", "summary").alias("text"),
        "importance",
        F.struct(F.lit(0).alias("part"), F.col("first_pos").alias("pos")).alias("place"),
        F.transform("members", lambda m: m["id"]).alias("ids"),
    )
    c = tx.collapsed(F.col("content"))
    title = F.coalesce(tx.first_sentence(F.col("content")), F.lit(""))
    more = flags.filter(~F.col("is_summary") & extra).select(
        "owner_id",
        F.concat_ws(" ", title, c).alias("text"),
        F.col("score").alias("importance"),
        F.struct(F.lit(1).alias("part"), "pos").alias("place"),
        F.array("id").alias("ids"),
    )
    return own.unionByName(more)


def _pooled(sources: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Per owner: which patterns occur in any source text, total importance and the first three evidence ids."""
    flat = sources.select("owner_id", "place", F.posexplode("ids").alias("i", "id")).withColumn("o", F.struct("place", "i"))
    ids = _evidence_ids(flat, ["owner_id"], "o", ITEM_EVIDENCE)
    hits = sources.groupBy("owner_id").agg(
        F.sum("importance").alias("importance"),
        *[F.bool_or(mentions(F.lower("text"), p)).alias(f"hit_{i}") for i, p in enumerate(patterns)],
    )
    return hits.join(ids, "owner_id")


def profile_items(flags: DataFrame, product_terms: Sequence[str] = ()) -> DataFrame:
    """Top items per owner and kind: owner_id, kind, place, title, summary, importance, evidence_count, evidence."""
    candidates = item_candidates(flags)
    plain = candidates.select(
        "owner_id",
        "kind",
        "title",
        "summary",
        "importance",
        F.col("first_pos").alias("o"),
        F.size("members").cast("bigint").alias("evidence_count"),
        F.transform(F.slice("members", 1, ITEM_EVIDENCE), lambda m: m["id"]).alias("evidence"),
    )
    free = ~(F.col("product_or_doc") | F.col("file_or_demo"))
    companion = _pooled(
        _sources(candidates, flags, "companion_style", free & F.col("plan_words")),
        [p for p, _ in pl.COMPANION_PARTS],
    )
    parts = F.array_compact(F.array(*[F.when(F.col(f"hit_{i}"), text) for i, (_, text) in enumerate(pl.COMPANION_PARTS)]))
    made = [
        companion.filter(F.size(parts) > 0).select(
            "owner_id",
            F.lit("companion_style").alias("kind"),
            F.lit(pl.COMPANION_TITLE).alias("title"),
            tx.limit_text(F.array_join(parts, "；"), 150).alias("summary"),
            "importance",
            F.lit(0).cast("bigint").alias("o"),
            F.size("evidence").cast("bigint").alias("evidence_count"),
            "evidence",
        )
    ]
    patterns = [_with_terms(p, product_terms) if i == 2 else p for i, (_, p, _) in enumerate(pl.CONSTRAINT_ITEMS)]
    pooled = _pooled(_sources(candidates, flags, "robot_constraint", F.lit(True)), patterns)
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"hit_{i}"),
                    F.struct(F.lit(i).cast("bigint").alias("o"), F.lit(title).alias("title"), F.lit(text).alias("summary")),
                )
                for i, (title, _, text) in enumerate(pl.CONSTRAINT_ITEMS)
            ]
        )
    )
    made.append(
        pooled.select("owner_id", "importance", "evidence", F.explode(rows).alias("x")).select(
            "owner_id",
            F.lit("robot_constraint").alias("kind"),
            "x.title",
            "x.summary",
            "importance",
            "x.o",
            F.size("evidence").cast("bigint").alias("evidence_count"),
            "evidence",
        )
    )
    synthetic = union_all(made)
    kept = plain.join(synthetic.select("owner_id", "kind").distinct(), ["owner_id", "kind"], "left_anti")
    ranked = top_per_group(
        kept.unionByName(synthetic),
        ["owner_id", "kind"],
        [F.desc(F.round("importance", 6)), F.asc("o")],
        ITEMS_PER_KIND,
        rank="place",
    )
    return ranked.withColumn("importance", _rounded(F.col("importance"))).drop("o")


# --- persona signals and summary ---------------------------------------------


def _label(group: str, label: str, test: Column, seq: int, cited: bool) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(group).alias("grp"), F.lit(label).alias("label"), F.lit(seq).alias("seq"), F.lit(cited).alias("cited")
        ),
    )


def _plan_labels(c: Column, first: int) -> list[Column]:
    out = []
    for i, (label, p, also) in enumerate(pl.PLAN_SIGNALS):
        test = mentions(c, p) if also is None else mentions(c, p) & mentions(c, also)
        out.append(_label("plan", label, test, first + i, False))
    return out


def text_signals(c: Column, product_terms: Sequence[str] = ()) -> Column:
    """array<struct<grp, label, seq, cited>> of the fixed labels that one lower-cased text supports."""
    frontend = mentions(c, pl.FRONTEND)
    with_ai = mentions(c, pl.AI_CONTEXT)
    role = ~frontend & mentions(c, pl.PRODUCT_ROLE) & mentions(c, _with_terms(pl.AI_PRODUCT, product_terms))
    labels = [
        _label("identity", pl.ID_AI_FRONTEND, frontend & with_ai, 0, True),
        _label("identity", pl.ID_FRONTEND, frontend & ~with_ai, 0, True),
        _label("identity", pl.ID_AI_PRODUCT, role, 0, True),
    ]
    for i, (group, label, pattern) in enumerate(pl.TEXT_SIGNALS):
        pattern = _with_terms(pattern, product_terms) if i == 0 else pattern
        labels.append(_label(group, label, mentions(c, pattern), 1 + i, True))
    return F.array_compact(F.array(*labels, *_plan_labels(c, 20)))


def persona_signals(flags: DataFrame, items: DataFrame) -> DataFrame:
    """(owner_id, grp, label, o): distinct labels with the place where each was first seen."""
    from_memories = flags.filter("stable").select("owner_id", F.lit(0).alias("part"), "pos", F.explode("signals").alias("s"))
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    style = _label("style", pl.STYLE_SIGNAL[0], (F.col("kind") != "current_priority") & mentions(text, pl.STYLE_SIGNAL[1]), 0, False)
    priority = F.when(F.col("kind") == "current_priority", text).otherwise(F.lit(""))
    from_items = items.select(
        "owner_id",
        F.lit(1).alias("part"),
        (rank * 1000 + F.col("place")).alias("pos"),
        F.explode(F.array_compact(F.array(style, *_plan_labels(priority, 20)))).alias("s"),
    )
    rows = from_memories.unionByName(from_items).select("owner_id", "s.grp", "s.label", F.struct("part", "pos", "s.seq").alias("o"))
    return rows.groupBy("owner_id", "grp", "label").agg(F.min("o").alias("o"))


def _facet_hits(either) -> Column:
    """Numbers of the facets a memory can stand for; the last one is the generic facet."""
    tests = [either(p) if deny is None else either(p) & ~either(deny) for _, p, deny in pl.FACETS]
    tests.append(either(pl.STABLE))
    return F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))


def _facets(flags: DataFrame) -> DataFrame:
    """Best-scored stable memory per facet: owner_id, f, id, text."""
    names = F.array(*[F.lit(label) for label, _, _ in pl.FACETS], F.lit(pl.GENERIC_FACET))
    rows = flags.filter("stable and not temporal_plan").select(
        "owner_id", "pos", "id", "score", "content", F.explode("facets").alias("f")
    ).withColumn("label", F.get(names, F.col("f")))
    best = top_per_group(rows, ["owner_id", "f"], [F.desc(F.round("score", 6)), F.asc("pos")], 1)
    return best.select(
        "owner_id", "f", "id", F.concat(F.col("label"), F.lit("："), tx.summary_clause(F.col("content"))).alias("text")
    )


def _descriptions(flags: DataFrame) -> DataFrame:
    """First stable memory per attribute kind, five kinds at most: owner_id, k, kind, id, value."""
    c = F.col("content")
    rank = F.array_position(F.array(*[F.lit(k) for k in pl.ATTRIBUTE_LABELS]), F.col("attribute_kind"))
    labels = F.create_map(*[x for k, v in pl.ATTRIBUTE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    value = F.coalesce("m_value", tx.first_sentence(tx.strip_label(c)), F.element_at(labels, F.col("attribute_kind")))
    first = top_per_group(
        flags.filter("stable and attribute_kind is not null"), ["owner_id", "attribute_kind"], [F.asc("pos")], 1
    ).select("owner_id", rank.alias("k"), F.col("attribute_kind").alias("kind"), "id", value.alias("value"))
    return top_per_group(first, ["owner_id"], [F.asc("k")], SUMMARY_EVIDENCE)


def profile_summary(flags: DataFrame, items: DataFrame) -> DataFrame:
    """(owner_id, text, message, evidence) for every owner with profile memories. Read ``items`` from a table."""
    owners = flags.groupBy("owner_id").agg(F.count(F.lit(1)).alias("memories"))

    # at most the fixed labels per owner
    def listed(group: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(F.col("grp") == group, F.struct("o", "label"))))
        return F.transform(pairs, lambda x: x["label"])

    signals = persona_signals(flags, items)
    s = signals.groupBy("owner_id").agg(
        F.countDistinct("label").alias("n_signals"),
        *[listed(g).alias(g) for g in ("identity", "domain", "trait", "style", "plan")],
    )
    first = F.get(F.col("identity"), F.lit(0))
    both = F.exists("identity", lambda x: F.contains(x, F.lit("前端"))) & F.exists("domain", lambda x: mentions(F.lower(x), pl.AI_CONTEXT))
    identity = F.when(both, pl.ID_AI_FRONTEND).otherwise(F.coalesce(first, F.lit(pl.ID_DEFAULT)))

    def part(column: str, lead: str, n: int) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(lead), F.array_join(F.slice(column, 1, n), "、")))

    action = F.exists("style", lambda x: mentions(x, pl.STYLE_ACTION))
    clauses = F.array_compact(
        F.array(
            F.concat(F.lit("你是一位"), identity),
            part("trait", "", 2),
            part("domain", "关注", 2),
            F.when(F.size("style") > 0, F.when(action, pl.STYLE_ACTION_TEXT).otherwise(F.get("style", F.lit(0)))),
            part("plan", "持续推进", 3),
        )
    )
    persona = s.select(
        "owner_id",
        "n_signals",
        F.when(F.col("n_signals") >= 2, tx.limit_text(F.concat(F.array_join(clauses, "，"), F.lit("。")))).alias("persona"),
    )

    d = _descriptions(flags)
    f = _facets(flags)
    by_kind = d.groupBy("owner_id").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("values"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("all_values"),
        F.count(F.lit(1)).alias("n_desc"),
    )
    leads = F.array_compact(
        F.array(
            *[
                F.when(F.col("values")[k].isNotNull(), F.concat(F.lit(lead), tx.inline_clause(F.col("values")[k])))
                for k, lead in pl.DESCRIPTION_LEADS
            ]
        )
    )
    plain = F.transform("all_values", tx.inline_clause)
    described = by_kind.select(
        "owner_id",
        "n_desc",
        tx.limit_text(F.concat(F.lit("你"), F.array_join(F.when(F.size(leads) > 0, leads).otherwise(plain), "，"))).alias("d_text"),
    )
    base = f.groupBy("owner_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("f") < len(pl.FACETS), F.struct("f", "text")))), lambda x: x["text"]
        ).alias("facets"),
        F.max(F.when(F.col("f") == len(pl.FACETS), F.col("text"))).alias("generic"),
    )
    joined = (
        owners.join(persona, "owner_id", "left").join(described, "owner_id", "left").join(base, "owner_id", "left")
    )
    nothing = F.array().cast("array<string>")
    joined = joined.withColumns({"facets": F.coalesce("facets", nothing), "n_desc": F.coalesce("n_desc", F.lit(0))})
    alone = (F.col("n_desc") == 0) & (F.size("facets") == 0) & F.col("generic").isNotNull()
    joined = joined.withColumn("facets", F.when(alone, F.array("generic")).otherwise(F.col("facets")))
    count = F.when(F.col("persona").isNotNull(), F.col("n_signals")).otherwise(F.col("n_desc") + F.size("facets"))
    fallback_text = tx.limit_text(
        F.array_join(F.filter(F.concat("facets", F.array("d_text")), lambda x: x.isNotNull() & (x != "")), "；")
    )
    message = (
        F.when(count == 0, F.when(F.col("memories") == 0, pl.MESSAGE_NONE).otherwise(pl.MESSAGE_WEAK))
        .when(count < 3, pl.MESSAGE_FEW)
    )
    texts = joined.select(
        "owner_id",
        F.col("persona").isNotNull().alias("from_signals"),
        alone.alias("generic_used"),
        F.coalesce("persona", F.when(count > 0, fallback_text), F.lit("")).alias("text"),
        message.alias("message"),
    )
    return texts.join(_summary_evidence(flags, items, texts, d, f), "owner_id", "left").select(
        "owner_id", "text", "message", F.coalesce("evidence", nothing).alias("evidence")
    )


def _summary_evidence(flags, items, texts, descriptions, facets) -> DataFrame:
    """First five distinct memory ids behind the summary text."""
    cited = flags.filter("stable").filter(F.exists("signals", lambda s: s["cited"]))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    zero = F.lit(0).cast("bigint")
    signal_rows = cited.select(
        "owner_id", "id", F.lit(True).alias("signals"), F.struct(zero.alias("a"), F.col("pos").alias("b"), zero.alias("c")).alias("o")
    ).unionByName(
        items.select(
            "owner_id", (rank * 1000 + F.col("place")).cast("bigint").alias("p"), F.posexplode("evidence").alias("i", "id")
        ).select(
            "owner_id",
            "id",
            F.lit(True).alias("signals"),
            F.struct(F.lit(1).cast("bigint").alias("a"), F.col("p").alias("b"), F.col("i").cast("bigint").alias("c")).alias("o"),
        )
    )
    last = len(pl.FACETS)
    shown = facets.join(texts.select("owner_id", "generic_used"), "owner_id").filter(
        ((F.col("f") < last) & ~F.col("generic_used")) | ((F.col("f") == last) & F.col("generic_used"))
    )
    other = descriptions.select(
        "owner_id", "id", F.lit(False).alias("signals"), F.struct(zero.alias("a"), F.col("k").cast("bigint").alias("b"), zero.alias("c")).alias("o")
    ).unionByName(
        shown.select(
            "owner_id",
            "id",
            F.lit(False).alias("signals"),
            F.struct(F.lit(1).cast("bigint").alias("a"), F.col("f").cast("bigint").alias("b"), zero.alias("c")).alias("o"),
        )
    )
    rows = signal_rows.unionByName(other).join(texts.select("owner_id", F.col("from_signals").alias("signals")), ["owner_id", "signals"])
    return _evidence_ids(rows, ["owner_id"], "o", SUMMARY_EVIDENCE)
