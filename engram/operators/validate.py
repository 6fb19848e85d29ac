"""Evidence checks, report checks and repair of proposed sections against computed fallbacks.

Proposed items are rows: owner_id, pos (order in the proposal), the item's fields, and an evidence array.
Every repair keeps the proposal's order and falls back to the computed section when nothing is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.operators.ranking import top_per_group

DISCOVERY_KINDS = ("focus_area", "collaborator", "routine", "decision", "hygiene", "opportunity")


# --- evidence -----------------------------------------------------------------


def check_evidence(refs: DataFrame, memories: DataFrame, item: Sequence[str], limit: int = 6) -> DataFrame:
    """(item, pos, id, valid): the first ``limit`` non-blank ids of every item, checked against the memories.

    The cut comes first, so an unknown id can use up a place.
    """
    cleaned = refs.withColumn("id", tx.blank_to_null(F.col("id"))).filter("id is not null")
    cut = top_per_group(cleaned, item, [F.asc("pos")], limit)
    known = memories.select("owner_id", "id").distinct().withColumn("valid", F.lit(True))
    return cut.join(known, ["owner_id", "id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def unknown_ids(checked: DataFrame, limit: int = 12) -> DataFrame:
    """First ``limit`` distinct unknown ids per owner, in order of appearance."""
    first = checked.filter(~F.col("valid")).groupBy("owner_id", "id").agg(F.min("pos").alias("pos"))
    return top_per_group(first, ["owner_id"], [F.asc("pos"), F.asc("id")], limit, rank="place").drop("pos")


def repair_diagnostics(checked: DataFrame, item: Sequence[str], others: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """(owner_id, repair_count, invalid_ids) of every owner with a repair.

    An item with unknown ids is one repair, whatever their number; ``others`` (owner_id, repaired BIGINT) adds further
    repairs, as those of text lists. ``invalid_ids`` are the first ``limit`` distinct unknown ids in order of appearance.
    """
    counts = checked.filter(~F.col("valid")).select(*item).distinct().select("owner_id", F.lit(1).cast("bigint").alias("repaired"))
    if others is not None:
        counts = counts.unionByName(others.select("owner_id", "repaired").filter("repaired > 0"))
    counts = counts.groupBy("owner_id").agg(F.sum("repaired").cast("bigint").alias("repair_count"))
    listed = unknown_ids(checked, limit).groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("ids"))
    no_ids = F.array().cast("array<string>")
    ids = F.coalesce(F.transform("ids", lambda x: x["id"]), no_ids)
    return counts.join(listed, "owner_id", "left").select("owner_id", "repair_count", ids.alias("invalid_ids"))


def _with_evidence(items: DataFrame, memories: DataFrame, keys: Sequence[str], column: str, limit: int = 6) -> DataFrame:
    """``items`` with ``valid`` (distinct known ids in order) and ``had_unknown``, replacing ``column``."""
    cut = tx.string_list(F.col(column), limit)
    refs = items.select(*keys, F.posexplode(cut).alias("ipos", "id"))
    known = memories.select("owner_id", "id").distinct().withColumn("ok", F.lit(True))
    checked = refs.join(known, ["owner_id", "id"], "left")
    # at most ``limit`` ids per item
    lists = checked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("ipos", "id")))).alias("v"),
        F.bool_or(F.col("ok").isNull()).alias("had_unknown"),
    )
    no_ids = F.array().cast("array<string>")
    return (
        items.drop(column)
        .join(lists, list(keys), "left")
        .withColumns(
            {
                "valid": F.coalesce(F.array_distinct(F.transform("v", lambda x: x["id"])), no_ids),
                "had_unknown": F.coalesce("had_unknown", F.lit(False)),
            }
        )
        .drop("v")
    )


def _or_fallback(repaired: DataFrame, fallback: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Repaired rows, and the fallback rows of every scope that has none."""
    empty = fallback.join(repaired.select(*scope).distinct(), list(scope), "left_anti")
    return repaired.unionByName(empty.select(*repaired.columns))


def _positive(c: Column, otherwise: Column) -> Column:
    return F.when(c > 0, c).otherwise(otherwise).cast("bigint")


def _key_order(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.min("pos").alias("first_pos"))


# --- sections -----------------------------------------------------------------


def repair_themes(proposed: DataFrame, fallback: DataFrame, limit: int = 8) -> DataFrame:
    """(owner_id, place, name, n, description). A repeated name keeps its first place and its last value."""
    keys = ["owner_id", "key"]
    own = fallback.select(
        "owner_id", tx.lookup_key(F.col("name")).alias("key"), F.col("n").alias("f_n"), F.col("description").alias("f_text")
    )
    named = proposed.withColumns({"name": tx.blank_to_null(F.col("name")), "key": tx.lookup_key(F.col("name"))})
    valid = named.filter(F.col("name").isNotNull() & (F.length("key") > 0) & ~F.col("key").isin(lx.THEME_DENYLIST))
    last = top_per_group(valid, keys, [F.desc("pos")], 1)
    filled = (
        last.join(_key_order(valid, keys), keys)
        .join(own, keys, "left")
        .select(
            "owner_id",
            "name",
            _positive(F.col("n"), F.coalesce("f_n", F.lit(1))).alias("n"),
            F.coalesce(
                tx.blank_to_null(F.col("description")),
                "f_text",
                F.concat(F.lit("Recurring signal around "), "name", F.lit(".")),
            ).alias("description"),
            "first_pos",
        )
    )
    ranked = top_per_group(filled, ["owner_id"], [F.asc("first_pos")], limit, rank="place").drop("first_pos")
    return _or_fallback(ranked, fallback, ["owner_id"])


def repair_entities(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 8) -> DataFrame:
    """(owner_id, kind, place, label, count, evidence). Items with the same key merge.

    ``proposed``: owner_id, kind, pos, label, count, evidence; ``fallback`` as produced by ``entity_groups``.
    """
    scope, keys = ["owner_id", "kind"], ["owner_id", "kind", "key"]
    named = proposed.withColumns({"label": tx.blank_to_null(F.col("label")), "key": tx.lookup_key(F.col("label"))})
    valid = named.filter(F.col("label").isNotNull() & (F.length("key") > 0) & ~F.col("key").isin(lx.ENTITY_DENYLIST))
    own = fallback.select(
        *scope, tx.lookup_key(F.col("label")).alias("key"), F.col("count").alias("f_count"), F.col("evidence").alias("f_ids")
    )
    items = _with_evidence(valid, memories, [*scope, "pos"], "evidence").join(own, keys, "left")
    no_ids = F.array().cast("array<string>")
    ids = F.when(F.size("valid") > 0, F.col("valid")).otherwise(F.coalesce("f_ids", no_ids))
    items = items.withColumn("ids", ids).filter(F.size("ids") > 0)
    count = _positive(F.col("count"), F.coalesce("f_count", F.size("ids").cast("bigint")))
    merged = items.groupBy(*keys).agg(
        F.min("pos").alias("first_pos"), F.min_by("label", "pos").alias("label"), F.max(count).alias("count")
    )
    ranked = top_per_group(merged, scope, [F.asc("first_pos")], limit, rank="place").drop("first_pos")
    listed = _merged_ids(items, keys, 6)
    return _or_fallback(
        ranked.join(listed, keys).select(*scope, "place", "label", "count", "evidence"), fallback, scope
    )


def _merged_ids(items: DataFrame, keys: Sequence[str], limit: int, column: str = "ids", name: str = "evidence") -> DataFrame:
    """First ``limit`` distinct array elements of all items with the same key, in item order."""
    flat = items.select(*keys, "pos", F.posexplode(column).alias("ipos", "v"))
    first = flat.groupBy(*keys, "v").agg(F.min(F.struct("pos", "ipos")).alias("o"))
    kept = top_per_group(first, keys, [F.asc("o")], limit, rank="r")
    return kept.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name)
    )


def repair_relations(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 18) -> DataFrame:
    """(owner_id, place, source, relation, target, confidence, evidence, excerpts). Same keys merge.

    ``proposed``: owner_id, pos, source, relation, target, confidence, evidence, excerpts; ``fallback`` has the
    result's columns.
    """
    keys = ["owner_id", "key"]
    fields = ["source", "relation", "target"]
    key = tx.relation_key(*[F.col(f) for f in fields])
    full = proposed.withColumns({f: tx.blank_to_null(F.col(f)) for f in fields}).filter(
        " and ".join(f"{f} is not null" for f in fields)
    )
    own = fallback.select(
        "owner_id",
        key.alias("key"),
        F.col("confidence").alias("f_conf"),
        F.col("evidence").alias("f_ids"),
        F.col("excerpts").alias("f_texts"),
    )
    items = _with_evidence(full.withColumn("key", key), memories, ["owner_id", "pos"], "evidence").join(own, keys, "left")
    nothing = F.array().cast("array<string>")
    texts = tx.string_list(F.col("excerpts"), 4)
    items = items.withColumns(
        {
            "ids": F.when(F.size("valid") > 0, F.col("valid")).otherwise(F.coalesce("f_ids", nothing)),
            "texts": F.when(F.size(texts) > 0, texts).otherwise(F.coalesce("f_texts", nothing)),
            "conf": tx.confidence_or(F.col("confidence"), F.coalesce("f_conf", F.lit(0.5))),
        }
    ).filter(F.size("ids") > 0)
    merged = items.groupBy(*keys).agg(
        F.min("pos").alias("first_pos"),
        *[F.min_by(f, "pos").alias(f) for f in fields],
        F.max("conf").alias("confidence"),
    )
    ranked = top_per_group(merged, ["owner_id"], [F.asc("first_pos")], limit, rank="place").drop("first_pos")
    result = (
        ranked.join(_merged_ids(items, keys, 6), keys)
        .join(_merged_ids(items, keys, 4, "texts", "excerpts"), keys, "left")
        .withColumn("excerpts", F.coalesce("excerpts", nothing))
        .select("owner_id", "place", *fields, "confidence", "evidence", "excerpts")
    )
    return _or_fallback(result, fallback, ["owner_id"])


def repair_discoveries(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 6) -> DataFrame:
    """(owner_id, place, id, kind, title, summary, confidence, evidence); fallback by kind, then id, then title."""
    fields = ["kind", "id", "title", "summary", "confidence", "evidence"]
    p = proposed.withColumns({f: tx.blank_to_null(F.col(f)) for f in ("kind", "id", "title", "summary")})
    p = p.withColumn("kind", F.when(F.col("kind").isin(*DISCOVERY_KINDS), F.col("kind")))
    p = _with_evidence(p, memories, ["owner_id", "pos"], "evidence")

    def own(prefix: str, key: Column) -> DataFrame:
        # the last fallback card of a key stands for it
        last = top_per_group(fallback.withColumn("k", key), ["owner_id", "k"], [F.desc("place")], 1)
        return last.select("owner_id", F.col("k").alias(f"{prefix}_key"), F.struct(*fields).alias(prefix))

    p = p.withColumns(
        {
            "kind_key": F.col("kind"),
            "id_key": F.when(F.col("id").isNotNull(), tx.lookup_key(F.col("id"))),
            "title_key": F.when(F.col("title").isNotNull(), tx.lookup_key(F.col("title"))),
        }
    )
    for prefix, key in (("kind", F.col("kind")), ("id", tx.lookup_key(F.col("id"))), ("title", tx.lookup_key(F.col("title")))):
        cards = own(prefix, key).withColumnRenamed(prefix, f"f_{prefix}")
        p = p.join(cards, ["owner_id", f"{prefix}_key"], "left")
    f = F.coalesce("f_kind", "f_id", "f_title")
    kind, title = F.coalesce("kind", f["kind"]), F.coalesce("title", f["title"])
    slug = F.regexp_replace(tx.discovery_id("x", title), "^x", "")
    made = F.when(kind.isNotNull() & title.isNotNull(), F.concat(kind, slug))
    repaired = p.select(
        "owner_id",
        "pos",
        F.coalesce("id", f["id"], made).alias("id"),
        kind.alias("kind"),
        title.alias("title"),
        F.coalesce("summary", f["summary"]).alias("summary"),
        tx.confidence_or(F.col("confidence"), F.coalesce(f["confidence"], F.lit(0.66))).alias("confidence"),
        F.when(F.size("valid") > 0, F.col("valid"))
        .otherwise(F.coalesce(f["evidence"], F.array().cast("array<string>")))
        .alias("evidence"),
    ).filter("id is not null and kind is not null and title is not null and summary is not null and size(evidence) > 0")
    unique = top_per_group(repaired, ["owner_id", "id"], [F.asc("pos")], 1)
    ranked = top_per_group(unique, ["owner_id"], [F.asc("pos")], limit, rank="place").drop("pos")
    return _or_fallback(ranked, fallback, ["owner_id"])


def repair_highlights(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 4) -> DataFrame:
    """(owner_id, place, title, detail, evidence); fallback by title, then detail, then the same place."""
    p = proposed.withColumns({f: tx.blank_to_null(F.col(f)) for f in ("title", "detail")})
    p = _with_evidence(p, memories, ["owner_id", "pos"], "evidence").withColumns(
        {
            "k_title": F.when(F.col("title").isNotNull(), tx.lookup_key(F.col("title"))),
            "k_detail": F.when(F.col("detail").isNotNull(), tx.lookup_key(F.col("detail"))),
            "k_place": F.col("pos").cast("bigint"),
        }
    )
    card = F.struct("title", "detail", "evidence")
    for name, key in (
        ("title", tx.lookup_key(F.col("title"))),
        ("detail", tx.lookup_key(F.col("detail"))),
        ("place", F.col("place").cast("bigint")),
    ):
        last = top_per_group(fallback.withColumn(f"k_{name}", key), ["owner_id", f"k_{name}"], [F.desc("place")], 1)
        p = p.join(last.select("owner_id", f"k_{name}", card.alias(f"f_{name}")), ["owner_id", f"k_{name}"], "left")
    f = F.coalesce("f_title", "f_detail", "f_place")
    repaired = p.select(
        "owner_id",
        "pos",
        F.coalesce("title", f["title"]).alias("title"),
        F.coalesce("detail", f["detail"]).alias("detail"),
        F.when(F.size("valid") > 0, F.col("valid"))
        .otherwise(F.coalesce(f["evidence"], F.array().cast("array<string>")))
        .alias("evidence"),
    ).filter("title is not null and detail is not null and size(evidence) > 0")
    ranked = top_per_group(repaired, ["owner_id"], [F.asc("pos")], limit, rank="place").drop("pos")
    return _or_fallback(ranked, fallback, ["owner_id"])


def repair_low_quality(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """(owner_id, place, memory_id, reason)."""
    known = memories.select("owner_id", F.col("id").alias("memory_id")).distinct()
    own = fallback.groupBy("owner_id", "memory_id").agg(F.max_by("reason", "place").alias("f_reason"))
    valid = (
        proposed.withColumn("memory_id", tx.blank_to_null(F.col("memory_id")))
        .join(known, ["owner_id", "memory_id"], "left_semi")
        .join(own, ["owner_id", "memory_id"], "left")
        .select(
            "owner_id",
            "pos",
            "memory_id",
            F.coalesce(tx.blank_to_null(F.col("reason")), "f_reason", F.lit("Low-information memory")).alias("reason"),
        )
    )
    ranked = top_per_group(valid, ["owner_id"], [F.asc("pos")], limit, rank="place").drop("pos")
    return _or_fallback(ranked, fallback, ["owner_id"])


def repair_clusters(proposed: DataFrame, fallback: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """(owner_id, place, canonical_id, duplicate_ids): known ids only, the canonical one not among its duplicates."""
    known = memories.select("owner_id", F.col("id").alias("canonical_id")).distinct()
    items = proposed.withColumn("canonical_id", tx.blank_to_null(F.col("canonical_id"))).join(
        known, ["owner_id", "canonical_id"], "left_semi"
    )
    items = _with_evidence(items, memories, ["owner_id", "pos"], "duplicate_ids", 12)
    others = F.filter("valid", lambda x: x != F.col("canonical_id"))
    items = items.select("owner_id", "pos", "canonical_id", others.alias("duplicate_ids")).filter(F.size("duplicate_ids") > 0)
    ranked = top_per_group(items, ["owner_id"], [F.asc("pos")], limit, rank="place").drop("pos")
    return _or_fallback(ranked, fallback, ["owner_id"])


def text_list_or(value: Column, fallback: Column, limit: int) -> Column:
    """Cleaned list, or the fallback when nothing usable was given."""
    cleaned = tx.string_list(value, limit)
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(fallback)


def repaired_text_list(value: Column, fallback: Column, limit: int) -> Column:
    """1 when ``text_list_or`` had to drop something or fall back, else 0."""
    cleaned = tx.string_list(value, limit)
    fell_back = (F.size(cleaned) == 0) & (F.size(fallback) > 0)
    dropped = F.size(cleaned) < F.least(F.size(value), F.lit(limit))
    return F.when(value.isNull(), 0).when(fell_back | dropped, 1).otherwise(0)


# --- report checks ------------------------------------------------------------


def report_violations(
    overview: DataFrame, items: DataFrame, refs: DataFrame, persona: DataFrame, actual: DataFrame, memories: DataFrame
) -> DataFrame:
    """(owner_id, problem, detail) for every broken rule of a report.

    ``overview`` / ``actual``: owner_id, memory_count, deduplicated_count; ``items``: owner_id, section (theme,
    entity, relation), name, source, relation, target; ``refs``: owner_id, section, pos, id; ``persona``:
    owner_id, summary, signal_count.
    """
    held = actual.select(
        "owner_id", F.col("memory_count").alias("a_count"), F.col("deduplicated_count").alias("a_unique")
    )
    counts = overview.join(held, "owner_id", "left").select(
        "owner_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("memory_count").eqNullSafe(F.col("a_count")), "memory_count"),
                    F.when(~F.col("deduplicated_count").eqNullSafe(F.col("a_unique")), "deduplicated_count"),
                )
            )
        ).alias("problem"),
        F.lit("").alias("detail"),
    )
    name = tx.token_key(F.col("name"))
    blank = [F.length(tx.token_key(F.col(c))) == 0 for c in ("source", "relation", "target")]
    problem = (
        F.when((F.col("section") == "theme") & ((F.length(name) == 0) | name.isin(lx.THEME_DENYLIST)), "generic_theme")
        .when((F.col("section") == "entity") & ((F.length(name) == 0) | name.isin(lx.ENTITY_DENYLIST)), "generic_entity")
        .when((F.col("section") == "relation") & (blank[0] | blank[1] | blank[2]), "empty_relation")
    )
    broken = items.select("owner_id", problem.alias("problem"), F.lit("").alias("detail")).filter("problem is not null").distinct()
    known = memories.select("owner_id", "id").distinct()
    unknown = refs.join(known, ["owner_id", "id"], "left_anti").groupBy("owner_id", "section", "id").agg(F.min("pos").alias("pos"))
    first = top_per_group(unknown, ["owner_id", "section"], [F.asc("pos"), F.asc("id")], 5, rank="r")
    listed = first.groupBy("owner_id", "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ", ").alias("detail")
    )
    references = listed.select("owner_id", F.concat(F.lit("unknown_memory:"), "section").alias("problem"), "detail")
    shallow = persona.filter(
        (F.length(tx.token_key(F.col("summary"))) == 0) | (F.coalesce("signal_count", F.lit(0)) < 1)
    ).select("owner_id", F.lit("shallow_persona").alias("problem"), F.lit("").alias("detail"))
    return counts.unionByName(broken).unionByName(references).unionByName(shallow)
