"""Corpus analysis per owner (or per owner and chunk): extract once per memory, aggregate many times.

``extract`` turns every distinct memory into one row of small arrays; everything below only explodes those
arrays, aggregates with map-side combine and keeps bounded top lists, so no owner is ever gathered whole.
Ties go by (created_at, id), then by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import lexicons as lx
from engram.functions import text as tx
from engram.functions import tokens as tk
from engram.functions.binding import let
from engram.operators.dedupe import chunked_texts, duplicate_clusters, duplicate_quality, memory_keys
from engram.operators.ranking import MAX_GROUP_ROWS, top_per_group
from engram.operators.terms import group_term_counts, term_counts
from engram.session import written

OWNER = ("owner_id",)
#: Tasks for each input split of words that meet by chunk, so that the terms of one task stay small.
CHUNK_TASKS = 8


def _by_time() -> list[Column]:
    return [F.asc("created_at"), F.asc("id")]


def is_low_quality(content: Column) -> Column:
    text = tx.trimmed(content)
    return (F.length(text) < lx.LOW_QUALITY_LENGTH) | F.lower(text).rlike("(?iu)" + lx.ACKNOWLEDGEMENT)


def _entities(c: Column, tags: Column, tools: Sequence[str], places: Sequence[str]) -> Column:
    def labelled(kind: str, labels: Column, count=None) -> Column:
        return F.transform(
            labels,
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x.alias("label"), (count(x) if count else F.lit(1)).alias("n")
            ),
        )

    def counted(projects: Column) -> Column:
        # a tag given twice counts twice
        return labelled(
            "projects", F.array_distinct(projects), lambda x: F.size(F.filter(projects, lambda t: t == x))
        )

    return F.concat(
        labelled("people", tk.proper_names(c)),
        labelled("teams", tk.team_labels(c)),
        let(tk.project_tags(tags), counted),
        labelled("tools", tk.dictionary_hits(c, tools)),
        labelled("places", tk.dictionary_hits(c, places)),
    )


def _relations(c: Column, leads: Sequence[tuple[str, str]]) -> Column:
    def found(place: int, name: str, lead: str) -> Column:
        return F.transform(
            tk.relation_targets(c, lead),
            lambda t, i: F.struct(
                F.lit(place).alias("place"), i.alias("pos"), F.lit(name).alias("relation"), t.alias("target")
            ),
        )

    return F.concat(*[found(place, name, lead) for place, (name, lead) in enumerate(leads)])


def extract(
    memories: DataFrame,
    keys: Sequence[str] = OWNER,
    lexicons: dict[str, str] | None = None,
    tools: Sequence[str] = tuple(lx.TOOL_TERMS),
    places: Sequence[str] = tuple(lx.PLACE_TERMS),
    leads: Sequence[tuple[str, str]] = lx.RELATION_LEADS,
) -> DataFrame:
    """One row of features per memory; the full text is not carried further."""
    c = F.col("content")
    return memories.select(
        *keys,
        "id",
        "created_at",
        tx.preview(c).alias("preview"),
        # the words in order; their phrases, several times as long, are made where they are counted
        tk.corpus_tokens(c).alias("words"),
        _entities(c, F.col("tags"), tools, places).alias("entities"),
        tk.signals(c, lexicons or lx.SIGNAL_LEXICONS).alias("signals"),
        _relations(c, leads).alias("relations"),
        is_low_quality(c).alias("low_quality"),
    )


# --- tokens, phrases, themes --------------------------------------------------


def document_frequency(features: DataFrame, keys: Sequence[str] = OWNER, least: int = 1) -> DataFrame:
    """(keys, kind token|phrase, name, n): number of memories with the token or phrase, where at least ``least``. See :mod:`engram.operators.terms`."""
    return term_counts(features, keys, least)


def chunk_frequency(features: DataFrame, keys: Sequence[str] = ("owner_id", "chunk"), least: int = 1) -> DataFrame:
    """:func:`document_frequency` of groups of bounded size.

    The words of a group meet in one task, where their terms are counted in arrays: the words are shuffled, not the terms, which take many
    times as much. ``features`` should be a written table; its splits say how many tasks there have to be.
    """
    splits = features.select(*keys, "words").rdd.getNumPartitions()
    parts = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), CHUNK_TASKS * splits)
    return group_term_counts(features, keys, parts, least)


#: Memories that a theme is seen in, at least.
THEME_MEMORIES = 2


def themes(frequency: DataFrame, keys: Sequence[str] = OWNER, limit: int = 8) -> DataFrame:
    """Top phrases, then top tokens, seen in at least two memories: (keys, place, name, n, description)."""
    frequent = frequency.filter(F.col("n") >= THEME_MEMORIES)
    ranked = top_per_group(frequent, [*keys, "kind"], [F.desc("n"), F.asc("name")], 12, rank="r")
    ranked = ranked.filter("kind = 'token' or r <= 10")
    first_phrases = F.when(F.col("kind") == "phrase", 0).otherwise(1)
    listed = top_per_group(ranked, keys, [first_phrases, F.asc("r")], limit, rank="place")
    n = F.col("n").cast("string")
    return listed.select(
        *keys,
        "place",
        "name",
        "n",
        F.when(F.col("kind") == "phrase", F.concat(F.lit("Recurring phrase found in "), n, F.lit(" memories.")))
        .otherwise(F.concat(F.lit("Recurring signal across "), n, F.lit(" memories.")))
        .alias("description"),
    )


def boosted_themes(own: DataFrame, chunk_themes: DataFrame, limit: int = 8) -> DataFrame:
    """Owner themes, then the top 6 chunk themes that are not among them.

    ``chunk_themes``: owner_id, name, references (memory references in that chunk, 0 counts as 1). ``own`` is written down: it is read twice.
    """
    own = written(own)
    name = tx.token_key(F.col("name"))
    boosts = (
        chunk_themes.select("owner_id", name.alias("name"), F.greatest("references", F.lit(1)).alias("refs"))
        .filter((F.length("name") > 0) & ~F.col("name").isin(lx.THEME_DENYLIST))
        .groupBy("owner_id", "name")
        .agg(F.sum("refs").cast("bigint").alias("n"))
    )
    boosts = top_per_group(boosts, OWNER, [F.desc("n"), F.asc("name")], 6, rank="r")
    new = boosts.join(own.select("owner_id", "name"), ["owner_id", "name"], "left_anti")
    text = F.concat(
        F.lit("Cross-chunk recurring signal seen in "), F.col("n").cast("string"), F.lit(" memory references.")
    )
    both = own.withColumn("source", F.lit(0)).unionByName(
        new.select(
            "owner_id", F.col("r").alias("place"), "name", "n", text.alias("description"), F.lit(1).alias("source")
        )
    )
    ranked = top_per_group(
        both.withColumnRenamed("place", "r"), OWNER, [F.asc("source"), F.asc("r")], limit, rank="place"
    )
    return ranked.select("owner_id", "place", "name", "n", "description")


# --- entities -----------------------------------------------------------------


def entity_hits(features: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    return features.select(*keys, "id", "created_at", F.explode_outer("entities").alias("e")).filter("e is not null").select(
        *keys, "id", "created_at", "e.*"
    )


def entity_groups(hits: DataFrame, keys: Sequence[str] = OWNER, limit: int = 8, evidence: int = 6) -> DataFrame:
    """Top labels per kind with their first evidence ids: (keys, kind, place, label, count, evidence)."""
    label = [*keys, "kind", "label"]
    counts = hits.groupBy(*label).agg(F.sum("n").cast("bigint").alias("count"))
    top = top_per_group(counts, [*keys, "kind"], [F.desc("count"), F.asc("label")], limit, rank="place")
    first = top_per_group(hits.select(*label, "id", "created_at"), label, _by_time(), evidence, rank="r")
    ids = first.groupBy(*label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("evidence")
    )
    return top.join(ids, label).select(*keys, "kind", "place", "label", "count", "evidence")


def label_counts(hits: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    """Number of distinct labels per kind."""
    return hits.select(*keys, "kind", "label").distinct().groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("labels"))


# --- relations ----------------------------------------------------------------


def relation_rows(features: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    return features.select(*keys, "id", "created_at", "preview", F.explode_outer("relations").alias("r")).filter("r is not null").select(
        *keys,
        "id",
        "created_at",
        "r.place",
        "r.pos",
        F.lit("user").alias("source"),
        "r.relation",
        "r.target",
        F.lit(lx.RELATION_CONFIDENCE).alias("confidence"),
        F.col("preview").alias("excerpt"),
    )


def distinct_relations(relations: DataFrame, keys: Sequence[str] = OWNER, limit: int = 18) -> DataFrame:
    """First occurrence of every (source, relation, target, evidence), the first ``limit`` per group."""
    order = [F.asc("created_at"), F.asc("id"), F.asc("place"), F.asc("pos")]
    first = top_per_group(relations, [*keys, "source", "relation", "target", "id"], order, 1)
    return top_per_group(first, keys, order, limit, rank="rank_in_report")


def relations_with_chunks(
    relations: DataFrame, chunk_relations: DataFrame, keys: Sequence[str] = OWNER, limit: int = 18
) -> DataFrame:
    """Relations found in the texts, then those of chunk insights made elsewhere; the first ``limit`` distinct ones per group.

    ``chunk_relations``: (keys), pos, source, relation, target, confidence, excerpt, evidence ARRAY<STRING>. Two are the same if
    source, relation, target and evidence agree; the first stays, text relations before chunk relations.
    """
    named = ["source", "relation", "target", "confidence", "excerpt"]
    own = relations.select(*keys, *named, F.array("id").alias("evidence"), F.lit(0).alias("part"), "created_at", "id", "place", "pos")
    missing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("created_at", "id", "place")]
    outside = chunk_relations.select(*keys, *named, "evidence", F.lit(1).alias("part"), *missing, F.col("pos").cast(own.schema["pos"].dataType))
    both = own.unionByName(outside).withColumn("same", F.array_join("evidence", "|"))
    order = [F.asc(c) for c in ("part", "created_at", "id", "place", "pos", "relation")]
    first = top_per_group(both, [*keys, "source", "relation", "target", "same"], order, 1)
    ranked = top_per_group(first, keys, order, limit, rank="rank_in_report")
    return ranked.select(*keys, "rank_in_report", *named, "evidence")


# --- persona signals ----------------------------------------------------------


def signal_rows(features: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    rows = features.select(*keys, "id", "created_at", F.col("preview").alias("text"), F.explode_outer("signals").alias("signal"))
    return rows.filter(F.col("signal").isNotNull())


def representative_signals(signals: DataFrame, keys: Sequence[str] = OWNER, limit: int = 5) -> DataFrame:
    """First ``limit`` distinct texts per signal: (keys, signal, place, text)."""
    first = signals.groupBy(*keys, "signal", "text").agg(F.min(F.struct("created_at", "id")).alias("f"))
    order = [F.col("f.created_at"), F.col("f.id")]
    return top_per_group(first, [*keys, "signal"], order, limit, rank="place").drop("f")


def evidence_highlights(signals: DataFrame, keys: Sequence[str] = OWNER, limit: int = 4) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in lx.HIGHLIGHT_SIGNALS]), F.col("signal"))
    listed = top_per_group(
        signals.filter(F.col("signal").isin(*lx.HIGHLIGHT_SIGNALS)),
        keys,
        [rank, F.asc("created_at"), F.asc("id")],
        limit,
        rank="place",
    )
    title = F.concat(F.lit("Evidence "), F.col("place").cast("string"))
    return listed.select(*keys, "place", title.alias("title"), F.col("text").alias("detail"), F.col("id").alias("memory_id"))


def persona_flags(
    features: DataFrame, keys: Sequence[str] = OWNER, tension_tests=lx.TENSION_TESTS
) -> DataFrame:
    """Per group: memories per signal, low-quality memories, and which tension tests hold on both sides."""
    text = tx.token_key(F.col("preview"))
    pooled = F.arrays_overlap("signals", F.array(*[F.lit(s) for s in lx.TENSION_SIGNALS]))
    columns = [F.count_if("low_quality").alias("low_quality")]
    columns += [F.count_if(F.array_contains("signals", s)).alias(f"n_{s}") for s in lx.SIGNAL_LEXICONS]
    for i, (left, right, _) in enumerate(tension_tests):
        both = F.bool_or(pooled & text.rlike(left)) & F.bool_or(pooled & text.rlike(right))
        columns.append(F.coalesce(both, F.lit(False)).alias(f"tension_{i}"))
    return features.groupBy(*keys).agg(*columns)


def tensions(flags: DataFrame, tension_tests=lx.TENSION_TESTS) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(f"tension_{i}"), text) for i, (_, _, text) in enumerate(tension_tests)])
    )


def low_quality_examples(features: DataFrame, keys: Sequence[str] = OWNER, limit: int = 10) -> DataFrame:
    listed = top_per_group(
        features.filter("low_quality").select(*keys, "id", "created_at"), keys, _by_time(), limit, rank="place"
    )
    return listed.select(*keys, "place", F.col("id").alias("memory_id"), F.lit(lx.LOW_QUALITY_REASON).alias("reason"))


# --- texts --------------------------------------------------------------------


def coverage_gaps(people: Column, projects: Column, tools: Column, routines: Column, decisions: Column) -> Column:
    have = {"people": people, "projects": projects, "tools": tools, "routines": routines, "decisions": decisions}
    return F.array_compact(F.array(*[F.when(have[k] < low, text) for k, low, text in lx.COVERAGE_GAP_TESTS]))


def recommendations(duplicates: Column, low_quality: Column, relations: Column, tension_list: Column) -> Column:
    listed = F.array_compact(
        F.array(
            F.when(duplicates > 0, lx.RECOMMEND_DUPLICATES),
            F.when(low_quality > 0, lx.RECOMMEND_LOW_QUALITY),
            F.when(relations < 4, lx.RECOMMEND_RELATIONS),
            F.when(F.size(tension_list) > 0, lx.RECOMMEND_TENSIONS),
        )
    )
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(lx.RECOMMEND_HEALTHY)))


def persona_summary(theme_names: Column, has: dict[str, Column]) -> Column:
    lead = F.concat(
        F.lit("This corpus concentrates on "),
        F.array_join(F.slice(theme_names, 1, 3), ", "),
        F.lit(", with repeated memory traffic around those domains."),
    )
    parts = F.array_compact(
        F.array(
            F.when(F.size(theme_names) > 0, lead),
            F.when(has["working_style"] | has["preference"], lx.PERSONA_STYLE),
            F.when(has["goal"] | has["decision"], lx.PERSONA_GOALS),
            F.when(has["routine"], lx.PERSONA_ROUTINES),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(lx.PERSONA_EMPTY)


def overview(memories: DataFrame, unique: DataFrame) -> DataFrame:
    """Per owner: memories, distinct texts, time of the first and the last distinct text."""
    total = memories.groupBy("owner_id").agg(F.count(F.lit(1)).alias("memory_count"))
    span = unique.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("deduplicated_count"),
        F.min("created_at").alias("span_start"),
        F.max("created_at").alias("span_end"),
    )
    return total.join(span, "owner_id")


# --- chunk insights -----------------------------------------------------------


def chunk_insights(features: DataFrame, keys: Sequence[str] = ("owner_id", "chunk")) -> DataFrame:
    """Long form (keys, section, place, value): themes, 5 labels per kind, 4 texts per signal, 10 relations.

    ``features`` is read four times, so it should be a written table.
    """
    hits = entity_hits(features, keys)
    listed = [
        themes(chunk_frequency(features, keys, THEME_MEMORIES), keys).select(
            *keys, F.lit("theme").alias("section"), "place", F.col("name").alias("value")
        ),
        entity_groups(hits, keys, limit=5).select(
            *keys, F.col("kind").alias("section"), "place", F.col("label").alias("value")
        ),
        representative_signals(signal_rows(features, keys), keys, limit=4).select(
            *keys, F.col("signal").alias("section"), "place", F.col("text").alias("value")
        ),
        top_per_group(
            relation_rows(features, keys),
            keys,
            [F.asc("created_at"), F.asc("id"), F.asc("place"), F.asc("pos")],
            10,
            rank="n",
        ).select(
            *keys,
            F.lit("relation").alias("section"),
            F.col("n").alias("place"),
            F.concat_ws("|", "source", "relation", "target").alias("value"),
        ),
    ]
    out = listed[0]
    for frame in listed[1:]:
        out = out.unionByName(frame)
    return out


def chunk_annotations(features: DataFrame, keys: Sequence[str] = ("owner_id", "chunk"), tension_tests=lx.TENSION_TESTS) -> DataFrame:
    """One row per chunk: summary, tensions, and the lists of :func:`chunk_insights` by section (theme, relation, kinds, signals)."""
    sections = ["theme", "relation", "people", "teams", "projects", "tools", "places", *lx.SIGNAL_LEXICONS]
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    lists = chunk_insights(features, keys).groupBy(*keys).pivot("section", sections).agg(in_order)
    rows = persona_flags(features, keys, tension_tests).join(lists, list(keys), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in sections})
    summary = persona_summary(F.col("theme"), {s: F.col(f"n_{s}") > 0 for s in lx.SIGNAL_LEXICONS})
    return rows.select(*keys, summary.alias("summary"), tensions(rows, tension_tests).alias("tensions"), *sections)


def annotate(chunks: DataFrame, fn=None, schema: str | None = None, lexicons=None, leads=lx.RELATION_LEADS, tension_tests=lx.TENSION_TESTS) -> DataFrame:
    """Annotations of chunked memories (owner_id, chunk, id, content, created_at, tags).

    By default the heuristics of this module, all native: one row per chunk, see :func:`chunk_annotations`. A user's own ``fn`` gets and
    yields pandas batches of ``schema`` instead, of memories or of whatever rows ``chunks`` has.
    """
    if fn is not None:
        return chunks.mapInPandas(fn, schema)
    keys = ("owner_id", "chunk")
    return chunk_annotations(written(extract(chunks, keys, lexicons, leads=leads)), keys, tension_tests)


def cleaned_insights(raw: DataFrame) -> DataFrame:
    """Outside chunk insights (owner_id, chunk, section, pos, value): trimmed, blanks dropped, 12 per list."""
    value = tx.blank_to_null(F.col("value"))
    kept = raw.withColumn("value", value).filter("value is not null")
    return top_per_group(kept, ["owner_id", "chunk", "section"], [F.asc("pos")], 12, rank="place").drop("pos")


# --- report -------------------------------------------------------------------


def _listed(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Bounded, already ranked rows -> one array per key in rank order."""
    items = F.sort_array(F.collect_list(F.struct(F.col("place").alias("p"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda x: x["v"]).alias(name))


def discovery_cards() -> Column:
    """Cards from the section columns of one report row, first of each id, at most six."""
    theme = F.get(F.col("themes"), 0)
    people, projects, tools = F.col("people"), F.col("projects"), F.col("tools")
    person, project = F.get(people, 0), F.get(projects, 0)
    highlights, low = F.col("highlights"), F.col("low_quality_examples")
    no_ids = F.array().cast("array<string>")

    def ids(group: Column, n: int = 6) -> Column:
        return F.slice(group["evidence"], 1, n)

    def card(test: Column, id_: Column, kind: str, title: Column, summary: Column, confidence, evidence: Column) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.when(
            test,
            F.struct(
                id_.alias("id"),
                F.lit(kind).alias("kind"),
                title.alias("title"),
                summary.alias("summary"),
                confidence.alias("confidence"),
                F.coalesce(evidence, no_ids).alias("evidence"),
            ),
        )

    focus = F.coalesce(project["label"], theme["name"])
    focus_summary = F.when(
        project.isNotNull() & theme.isNotNull(),
        F.concat(
            F.lit("Project memories around "),
            project["label"],
            F.lit(" repeatedly overlap with "),
            theme["name"],
            F.lit(", suggesting a sustained workstream rather than isolated notes."),
        ),
    ).otherwise(
        F.concat(
            F.lit("The corpus keeps returning to "),
            F.coalesce(theme["name"], project["label"]),
            F.lit(", making it one of the strongest recurring focus areas."),
        )
    )
    related = F.get(
        F.filter("relations", lambda r: tx.token_key(r["target"]) == tx.token_key(person["label"])), 0
    )
    person_summary = F.when(
        related.isNotNull(),
        F.concat(
            person["label"],
            F.lit(" appears as a repeated collaborator with an explicit "),
            related["relation"],
            F.lit(" signal, which makes this relationship strong enough to operationalize later."),
        ),
    ).otherwise(
        F.concat(
            person["label"],
            F.lit(" appears across "),
            person["count"].cast("string"),
            F.lit(" memories, which makes them one of the clearest human anchors in the corpus."),
        )
    )
    routine = F.get(F.col("s_routine"), 0)
    decision = F.coalesce(F.get(F.col("s_decision"), 0), F.get(F.col("tensions"), 0))

    def highlight_of(text: Column) -> Column:
        return F.get(F.filter(highlights, lambda h: h["detail"] == text), 0)["memory_id"]

    def one(x: Column) -> Column:
        return F.when(x.isNotNull(), F.array(x))

    duplicates, low_n = F.col("duplicate_count"), F.size(low)
    hygiene_id = F.concat(F.lit("dup-"), duplicates.cast("string"), F.lit("-low-"), low_n.cast("string"))
    hygiene = F.when(
        duplicates > 0,
        F.concat(
            duplicates.cast("string"),
            F.lit(
                " duplicate memories were detected, so cleanup would immediately improve future analysis density and "
                "reduce drift."
            ),
        ),
    ).otherwise(
        F.concat(
            low_n.cast("string"),
            F.lit(
                " low-information memories were detected, so a cleanup pass would improve future synthesis quality."
            ),
        )
    )
    gap, advice = F.get(F.col("coverage_gaps"), 0), F.get(F.col("recommendations"), 0)
    tool = F.get(tools, 0)
    cards = F.array_compact(
        F.array(
            card(
                theme.isNotNull() | project.isNotNull(),
                tx.discovery_id("focus", focus),
                "focus_area",
                F.concat(F.lit("Focus area: "), focus),
                focus_summary,
                0.78,
                F.slice(F.concat(F.coalesce(project["evidence"], no_ids), F.coalesce(person["evidence"], no_ids)), 1, 6),
            ),
            card(
                person.isNotNull(),
                tx.discovery_id("collaborator", person["label"]),
                "collaborator",
                F.concat(F.lit("Key collaborator: "), person["label"]),
                person_summary,
                F.when(related.isNotNull(), 0.82).otherwise(0.72),
                F.coalesce(one(related["memory_id"]), ids(person)),
            ),
            card(
                routine.isNotNull(),
                tx.discovery_id("routine", routine),
                "routine",
                F.lit("Stable routine detected"),
                routine,
                0.74,
                one(highlight_of(routine)),
            ),
            card(
                decision.isNotNull(),
                tx.discovery_id("decision", decision),
                "decision",
                F.lit("Decision pattern"),
                decision,
                0.7,
                one(F.coalesce(highlight_of(decision), F.get(highlights, 0)["memory_id"])),
            ),
            card(
                (duplicates > 0) | (low_n > 0),
                tx.discovery_id("hygiene", hygiene_id),
                "hygiene",
                F.lit("Memory hygiene opportunity"),
                hygiene,
                0.9,
                F.transform(F.slice(low, 1, 4), lambda x: x["memory_id"]),
            ),
            card(
                gap.isNotNull(),
                tx.discovery_id("opportunity", gap),
                "opportunity",
                F.lit("Coverage opportunity"),
                gap,
                0.68,
                F.coalesce(ids(project, 4), ids(tool, 4), ids(person, 4)),
            ),
            card(
                gap.isNull() & advice.isNotNull(),
                tx.discovery_id("opportunity", advice),
                "opportunity",
                F.lit("Next enrichment opportunity"),
                advice,
                0.66,
                F.coalesce(ids(project, 4), ids(person, 4), ids(tool, 4)),
            ),
        )
    )
    # ids start with their kind and every kind occurs once, so ids are already distinct
    return F.slice(cards, 1, 6)


def candidate_nodes() -> Column:
    def nodes(column: str, kind: str, n: int, label: str, count: str) -> Column:
        return F.transform(
            F.slice(F.col(column), 1, n),
            lambda x: F.struct(x[label].alias("label"), F.lit(kind).alias("kind"), x[count].alias("count")),
        )

    return F.concat(
        nodes("themes", "theme", 4, "name", "n"),
        nodes("people", "person", 2, "label", "count"),
        nodes("projects", "project", 2, "label", "count"),
    )


def search_seeds() -> Column:
    return F.slice(
        F.array_distinct(
            F.concat(
                F.transform(F.slice("themes", 1, 6), lambda x: x["name"]),
                F.transform(F.slice("projects", 1, 4), lambda x: x["label"]),
                F.transform(F.slice("people", 1, 4), lambda x: x["label"]),
            )
        ),
        1,
        8,
    )


_ARRAYS = {
    "themes": "array<struct<name:string,n:bigint,description:string>>",
    "people": "array<struct<label:string,count:bigint,evidence:array<string>>>",
    "relations": "array<struct<source:string,relation:string,target:string,confidence:double,memory_id:string,excerpt:string>>",
    "highlights": "array<struct<title:string,detail:string,memory_id:string>>",
    "low_quality_examples": "array<struct<memory_id:string,reason:string>>",
    "strings": "array<string>",
}


def corpus_report(
    memories: DataFrame,
    *,
    lang: str = "en",
    chunk_size: int = lx.CHUNK_SIZE,
    lexicons: dict[str, str] | None = None,
    tension_tests=lx.TENSION_TESTS,
    leads: Sequence[tuple[str, str]] = lx.RELATION_LEADS,
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_relations: DataFrame | None = None,
) -> DataFrame:
    """All report sections, one row per owner. ``memories``: owner_id, id, content, created_at, tags.

    Texts are read twice, for their hashes and for the features of the distinct ones. ``chunk_relations``, of chunk insights made elsewhere
    (see :func:`relations_with_chunks`), follow the relations found in the texts.
    """
    keys = memory_keys(memories)
    chunked = chunked_texts(memories, chunk_size, max_group_rows, keys)
    features = written(extract(chunked, ["owner_id", "chunk"], lexicons, leads=leads))

    chunk_keys = ("owner_id", "chunk")
    own = themes(document_frequency(features, least=THEME_MEMORIES))
    per_chunk = themes(chunk_frequency(features, chunk_keys, THEME_MEMORIES), chunk_keys)
    theme_rows = boosted_themes(own, per_chunk.select("owner_id", "name", F.lit(0).cast("bigint").alias("references")))
    hits = entity_hits(features)
    groups = entity_groups(hits)
    labels = label_counts(hits).groupBy("owner_id").pivot("kind", ["people", "projects", "tools"]).agg(F.first("labels"))
    signals = signal_rows(features)
    texts = representative_signals(signals)
    if chunk_relations is None:
        relations = distinct_relations(relation_rows(features))
    else:
        relations = relations_with_chunks(relation_rows(features), chunk_relations).withColumn("id", F.get("evidence", F.lit(0)))
    relations = relations.withColumn("place", F.col("rank_in_report"))

    report = overview(keys, features).join(
        duplicate_quality(keys).select("owner_id", "duplicate_count", "duplicate_ratio"), "owner_id"
    ).join(persona_flags(features, tension_tests=tension_tests), "owner_id")

    sections: list[tuple[str, str, DataFrame]] = [
        ("themes", "themes", _listed(theme_rows, OWNER, F.struct("name", "n", "description"), "themes")),
        ("relations", "relations", _listed(
            relations,
            OWNER,
            F.struct("source", "relation", "target", "confidence", F.col("id").alias("memory_id"), "excerpt"),
            "relations",
        )),
        ("highlights", "highlights", _listed(
            evidence_highlights(signals), OWNER, F.struct("title", "detail", "memory_id"), "highlights"
        )),
        ("low_quality_examples", "low_quality_examples", _listed(
            low_quality_examples(features), OWNER, F.struct("memory_id", "reason"), "low_quality_examples"
        )),
    ]
    for name, type_, frame in sections:
        report = report.join(frame, "owner_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(_ARRAYS[type_]))
        )
    kinds = ["people", "teams", "projects", "tools", "places"]
    item = F.struct("label", "count", "evidence")
    grouped = groups.groupBy("owner_id").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("place").alias("p"), item.alias("v"))))),
                lambda x: x["v"],
            ).alias(k)
            for k in kinds
        ]
    )
    names = list(lx.SIGNAL_LEXICONS)
    listed_texts = texts.groupBy("owner_id").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("signal") == s, F.struct("place", "text")))), lambda x: x["text"]
            ).alias(f"s_{s}")
            for s in names
        ]
    )
    report = report.join(grouped, "owner_id", "left").join(listed_texts, "owner_id", "left").join(
        labels.select(
            "owner_id",
            F.col("people").alias("l_people"),
            F.col("projects").alias("l_projects"),
            F.col("tools").alias("l_tools"),
        ),
        "owner_id",
        "left",
    )
    report = report.withColumns(
        {k: F.coalesce(k, F.array().cast(_ARRAYS["people"])) for k in kinds}
        | {f"s_{s}": F.coalesce(f"s_{s}", F.array().cast("array<string>")) for s in names}
        | {c: F.coalesce(c, F.lit(0)) for c in ("l_people", "l_projects", "l_tools")}
    )
    report = report.withColumn("tensions", tensions(report, tension_tests))
    report = report.withColumns(
        {
            "coverage_gaps": coverage_gaps(
                F.col("l_people"), F.col("l_projects"), F.col("l_tools"), F.col("n_routine"), F.col("n_decision")
            ),
            "recommendations": recommendations(
                F.col("duplicate_count"), F.col("low_quality"), F.size("relations"), F.col("tensions")
            ),
            "persona_summary": persona_summary(
                F.transform("themes", lambda t: t["name"]), {s: F.col(f"n_{s}") > 0 for s in names}
            ),
            "nodes": candidate_nodes(),
            "edges": F.transform(
                F.slice("relations", 1, 10), lambda r: F.struct(r["source"], r["relation"], r["target"], r["confidence"])
            ),
            "seeds": search_seeds(),
        }
    )
    report = report.withColumn("discoveries", discovery_cards())
    clusters = duplicate_clusters(keys)
    cluster_list = _listed(
        clusters.withColumn("place", F.col("cluster_index")),
        OWNER,
        F.struct("canonical_id", "duplicates"),
        "duplicate_clusters",
    )
    return report.join(cluster_list, "owner_id", "left").withColumn("lang", F.lit(lang)).drop(
        "l_people", "l_projects", "l_tools"
    )


def report_preview(report: DataFrame) -> DataFrame:
    return report.select(
        "owner_id",
        F.coalesce(tx.blank_to_null(F.col("persona_summary")), F.lit("Deep analysis report generated.")).alias("summary"),
        F.transform(F.slice("themes", 1, 3), lambda t: t["name"]).alias("top_themes"),
        F.slice("recommendations", 1, 3).alias("key_recommendations"),
    )


def report_document(report: DataFrame) -> DataFrame:
    """(owner_id, value): the nested report as one JSON text per owner, ready for a text or JSON sink."""
    persona = F.struct(
        F.col("persona_summary").alias("summary"),
        F.col("s_working_style").alias("workingStyle"),
        F.col("s_goal").alias("goals"),
        F.col("s_preference").alias("preferences"),
        F.col("s_constraint").alias("constraints"),
        F.col("s_decision").alias("decisionSignals"),
        F.col("s_routine").alias("notableRoutines"),
        F.col("tensions").alias("contradictionsOrTensions"),
        F.col("highlights").alias("evidenceHighlights"),
    )
    document = F.struct(
        F.struct(
            F.col("memory_count").alias("memoryCount"),
            F.col("deduplicated_count").alias("deduplicatedMemoryCount"),
            "lang",
            F.struct(tx.iso(F.col("span_start")).alias("start"), tx.iso(F.col("span_end")).alias("end")).alias("timeSpan"),
        ).alias("overview"),
        persona.alias("persona"),
        F.struct(F.col("themes").alias("highlights")).alias("themeLandscape"),
        F.struct("people", "teams", "projects", "tools", "places").alias("entities"),
        F.col("relations").alias("relationships"),
        F.col("discoveries"),
        F.struct(
            F.col("duplicate_ratio").alias("duplicateRatio"),
            F.col("duplicate_count").alias("duplicateMemoryCount"),
            F.size("low_quality_examples").alias("noisyMemoryCount"),
            F.col("duplicate_clusters").alias("duplicateClusters"),
            F.col("low_quality_examples").alias("lowQualityExamples"),
            F.col("coverage_gaps").alias("coverageGaps"),
        ).alias("quality"),
        F.col("recommendations"),
        F.struct(
            F.col("nodes").alias("candidateNodes"), F.col("edges").alias("candidateEdges"), F.col("seeds").alias("searchSeeds")
        ).alias("productSignals"),
    )
    return report.select("owner_id", F.to_json(document).alias("value"))
