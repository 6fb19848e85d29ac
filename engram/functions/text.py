"""Scalar text expressions (Column -> Column), all JVM-side."""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import lexicons as lx


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(lx.TRIM_CHARS))


def collapsed(c: Column) -> Column:
    """Whitespace runs become one space, then trimmed."""
    # printable ASCII, and the single space before it, are passed by without trying the whole class
    return F.btrim(F.regexp_replace(c, rf"(?! [!-~])(?![!-~]){lx.WS_RUN}", " "), F.lit(" "))


def normalized(c: Column) -> Column:
    return F.lower(collapsed(c))


def content_hash(normalized_content: Column) -> Column:
    return F.sha2(normalized_content, 256)


def preview(c: Column, n: int = 220) -> Column:
    return F.substring(collapsed(c), 1, n)


def head_tail(c: Column, limit: Column | int) -> Column:
    """Keep 60 % from the front and the rest from the back when ``c`` is longer than ``limit``."""
    text = trimmed(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit * F.lit(6) / F.lit(10)).cast("int")
    tail = (limit - head).cast("int")
    cut = F.concat(
        F.substring(text, F.lit(1), head),
        F.lit(lx.TRUNCATION_MARK),
        F.right(text, tail),
    )
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def head_tail_length(c: Column, limit: int = lx.CONTENT_CAP) -> Column:
    """Length of ``head_tail(c, limit)`` without building it."""
    n = F.length(trimmed(c))
    return F.when(n <= limit, n).otherwise(F.lit(limit + len(lx.TRUNCATION_MARK))).cast("bigint")


def lookup_key(c: Column) -> Column:
    words = F.regexp_replace(F.lower(trimmed(c)), r"[^\p{L}\p{N}]+", " ")
    return F.coalesce(F.btrim(words, F.lit(" ")), F.lit(""))


def relation_key(source: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws("|", lookup_key(source), lookup_key(relation), lookup_key(target))


def token_key(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


_END_MARKS = r"[。.!！?？]+$"


def plain_text(c: Column) -> Column:
    """Trim and cut at 1000; null stays empty."""
    return F.coalesce(F.substring(trimmed(c), 1, 1000), F.lit(""))


def title_or(c: Column, fallback: Column) -> Column:
    title = F.substring(F.regexp_replace(plain_text(c), _END_MARKS, ""), 1, 24)
    alternative = F.substring(F.regexp_replace(fallback, _END_MARKS, ""), 1, 12)
    return F.when(F.length(title) > 0, title).otherwise(alternative)


def summary_or(c: Column, fallback: Column) -> Column:
    summary = F.substring(plain_text(c), 1, 80)
    return F.when(F.length(summary) > 0, summary).otherwise(F.substring(fallback, 1, 20))


def dimension_or_null(c: Column) -> Column:
    name = F.lower(trimmed(c))
    return F.when(name.isin(lx.DIMENSIONS), name)


def dimension_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in lx.DIMENSIONS]), c).cast("int")


def score_or_null(c: Column, dimension: Column) -> Column:
    """Emotion scores: half-up rounding, clamped to 1..10; anything else has no score."""
    number = _try_double(c)
    whole = F.floor(number + F.lit(0.5)).cast("bigint")
    clamped = F.least(F.lit(10), F.greatest(F.lit(1), whole)).cast("bigint")
    return F.when((dimension == "emotion") & _finite(number), clamped)


def confidence_or(c: Column, fallback: Column | float) -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, float) else fallback
    number = c.cast("double")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    return F.when(number.isNotNull() & _finite(number), clamped).otherwise(fallback)


def _try_double(c: Column) -> Column:
    return trimmed(c.cast("string")).try_cast("double")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def ratio2(n: Column, d: Column) -> Column:
    """n/d to two decimals, half up, in integers so that every engine agrees; 0 when d is 0."""
    n, d = n.cast("bigint"), d.cast("bigint")
    return F.when(d == 0, F.lit(0.0)).otherwise(F.floor((n * 200 + d) / (d * 2)) / F.lit(100.0))


# --- sentences and clauses ----------------------------------------------------


def first_sentence(c: Column) -> Column:
    head = F.regexp_extract(collapsed(c), r"^[^。.!?\n]*", 0)
    return F.nullif(F.btrim(head, F.lit(" ")), F.lit(""))


def strip_label(c: Column) -> Column:
    ws = lx.WS_CLASS
    return F.regexp_replace(
        c, rf"^[{ws}]*[A-Za-z0-9_{ws}\x{{4e00}}-\x{{9fff}}-]{{1,24}}[{ws}]*[:：][{ws}]*", ""
    )


def summary_clause(c: Column) -> Column:
    text = F.coalesce(first_sentence(strip_label(c)), collapsed(c))
    text = F.regexp_replace(text, r"^(用户|这个用户|TA|ta)? *(做事风格|工作风格)(是|为)? *", "")
    text = F.regexp_replace(text, r"^(用户|这个用户|TA|ta) *(是|偏好|喜欢|不喜欢|讨厌|倾向于|重视|看重)? *", "")
    return F.btrim(text, F.lit(" "))


def inline_clause(c: Column) -> Column:
    text = F.regexp_replace(collapsed(c), r"[。.!?？！]+$", "")
    text = F.regexp_replace(text, r"^(用户|这个用户|TA|ta) *", "")
    text = F.regexp_replace(
        text, r"^(目标是|长期目标是|当前重心是|当前重心在|偏好|喜欢|更喜欢|希望|想要) *", ""
    )
    return F.btrim(text, F.lit(" "))


_TAIL_MARKS = r"[；，、。,.，:：;]+$"


def limit_text(c: Column, limit: int = 100) -> Column:
    """Cut at the last sentence mark inside ``limit``, else hard; trailing separators go."""
    text = F.regexp_replace(collapsed(c), _TAIL_MARKS, "")
    head = F.substring(text, 1, limit)
    # the mark must not be the first character, as a cut there keeps nothing
    to_mark = F.regexp_extract(head, r"(?s)^(.+[。！？.!?；;])", 1)
    kept = F.when(F.length(to_mark) > 0, to_mark).otherwise(head)
    kept = F.btrim(F.regexp_replace(kept, _TAIL_MARKS, ""), F.lit(" "))
    cut = F.when(F.length(kept) > 0, kept).otherwise(F.btrim(head, F.lit(" ")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


# --- identifiers, redaction ---------------------------------------------------


def discovery_id(prefix: str, c: Column) -> Column:
    slug = F.regexp_replace(token_key(c), r"[^a-z0-9\x{4e00}-\x{9fa5}]+", "-")
    slug = F.substring(F.btrim(slug, F.lit("-")), 1, 40)
    return F.concat(F.lit(prefix + ":"), F.when(F.length(slug) > 0, slug).otherwise(F.lit("signal")))


def rule_slug(c: Column) -> Column:
    slug = F.replace(F.lower(c), F.lit("'"), F.lit(""))
    slug = F.replace(slug, F.lit("+"), F.lit("plus"))
    slug = F.regexp_replace(slug, r"[^\p{L}\p{N}_-]+", "-")
    slug = F.regexp_replace(slug, r"-+", "-")
    return F.regexp_replace(slug, r"^-|-$", "")


def redact_map(c: Column, keys: Sequence[str] = ("x-api-key", "authorization")) -> Column:
    return F.transform_values(c, lambda k, v: F.when(k.isin(list(keys)), F.lit("[REDACTED]")).otherwise(v))


def redact_query(c: Column, parameter: str = "api_key") -> Column:
    return F.regexp_replace(c, rf"([?&]{parameter}=)[^&#]*", "$1%5BREDACTED%5D")


def string_list(c: Column, limit: int | None = None) -> Column:
    """Trim, drop blanks and nulls, keep the first ``limit``."""
    kept = F.filter(F.transform(c, trimmed), lambda x: x.isNotNull() & (F.length(x) > 0))
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    return kept if limit is None else F.slice(kept, 1, limit)


def progress_percent(done: Column, total: Column, start: int = 35, end: int = 59) -> Column:
    step = F.floor(done.cast("bigint") * (end - start) / F.greatest(total, F.lit(1)))
    return F.when(total <= 0, F.lit(start)).otherwise(F.least(F.lit(end), F.lit(start) + step)).cast("bigint")


# --- times --------------------------------------------------------------------


def day_key(c: Column) -> Column:
    """UTC day of an ISO string or timestamp; ``unknown-date`` when there is none."""
    head = F.substring(c.cast("string"), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head).otherwise(F.lit("unknown-date"))


def _zone(tz: Column) -> Column:
    return F.when(F.length(trimmed(F.coalesce(tz, F.lit("")))) > 0, trimmed(tz)).otherwise(F.lit("UTC"))


def _known_zone(zone: Column) -> Column:
    """Whether a zone is in the IANA table; a name that Java does not know must not reach the conversion."""
    return zone.isin(sorted(zoneinfo.available_timezones() - {"localtime", "Factory", "posixrules"}))


def request_day_key(ts: Column, tz: Column) -> Column:
    """Local day and zone of a request; null for an unknown zone."""
    zone = _zone(tz)
    local = F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
    return F.when(_known_zone(zone), F.concat(local, F.lit("@"), zone))


def request_zone_error(tz: Column) -> Column:
    """``INVALID_TIMEZONE`` for a zone that does not exist, else null."""
    return F.when(~_known_zone(_zone(tz)), F.lit("INVALID_TIMEZONE"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
