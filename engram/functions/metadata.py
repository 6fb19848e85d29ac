"""Open metadata: a raw JSON string, read through VARIANT so that "5" and 5 stay different."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import collapsed, trimmed


def parsed(metadata_json: Column) -> Column:
    return F.try_parse_json(metadata_json)


def _field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _type(field: Column) -> Column:
    return F.schema_of_variant(field)


def _string(v: Column, key: str) -> Column:
    field = _field(v, key)
    return F.when(_type(field) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def string_of(v: Column, keys: Sequence[str]) -> Column:
    """First non-blank string among ``keys``, whitespace collapsed."""
    return F.coalesce(*[F.nullif(collapsed(_string(v, k)), F.lit("")) for k in keys])


def number_of(v: Column, keys: Sequence[str]) -> Column:
    """First finite number or numeric string among ``keys``; a blank string counts as 0."""

    def one(key: str) -> Column:
        text = trimmed(_string(v, key))
        from_text = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
        value = F.when(
            _type(_field(v, key)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
            F.try_variant_get(v, f"$.{key}", "double"),
        ).otherwise(from_text)
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)

    return F.coalesce(*[one(k) for k in keys])


def boolean_of(v: Column, key: str) -> Column:
    return F.when(_type(_field(v, key)) == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))


def json_number_of(v: Column, key: str) -> Column:
    field = _field(v, key)
    is_number = _type(field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number, F.try_variant_get(v, f"$.{key}", "double"))


def review_of(v: Column) -> Column:
    """Correctness, edited flag, version and time of a reviewed memory; null when nothing was recorded."""
    correctness = _string(v, "correctness")
    correctness = F.when(correctness.isin("correct", "incorrect"), correctness)
    edited = boolean_of(v, "edited")
    version = json_number_of(v, "edit_version").cast("bigint")
    edited_at = F.nullif(F.substring(trimmed(_string(v, "edited_at")), 1, 1000), F.lit(""))
    review = F.struct(
        correctness.alias("correctness"),
        edited.alias("edited"),
        version.alias("edit_version"),
        edited_at.alias("edited_at"),
    )
    return F.when(F.coalesce(correctness, edited.cast("string"), version.cast("string"), edited_at).isNotNull(), review)


def memory_score(v: Column, memory_type: Column, tags: Column) -> Column:
    confidence = F.coalesce(number_of(v, ["confidence", "score", "importance"]), F.lit(0.7))
    evidence = F.coalesce(number_of(v, ["evidenceCount", "evidence_count"]), F.lit(1.0))
    weight = F.when(memory_type == "fact", F.lit(1.2)).otherwise(F.lit(1.0))
    tagged = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.lit(0.2)).otherwise(F.lit(0.0))
    return (confidence * 10 + F.least(evidence, F.lit(5.0))) * weight + tagged
