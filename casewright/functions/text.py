"""String, number and list column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TECHNIQUE_PATTERN = r"^T\d{4}(\.\d{3})?$"


def clean(col: Column) -> Column:
    """Trimmed text; empty text becomes null."""
    return F.nullif(F.trim(col), F.lit(""))


def folded(col: Column) -> Column:
    """Trimmed lower-case text for comparison; empty text becomes null."""
    return F.lower(clean(col))


def basename(path: Column) -> Column:
    """Last path part, for both kinds of slash."""
    return F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1)


def to_int(col: Column) -> Column:
    """Decimal or ``0x`` hexadecimal text as INT, null when it is neither."""
    text = F.trim(col.cast("string"))
    return F.when(
        text.rlike("^0x[0-9A-Fa-f]+$"), F.conv(F.substring(text, 3, 32), 16, 10).try_cast("int")
    ).otherwise(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")))


def sorted_set(col: Column) -> Column:
    """Sorted, unique, trimmed, non-empty items; null stays an empty list."""
    items = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def valid_technique(col: Column) -> Column:
    """Technique ids as the event model accepts them: T, then digits and dots."""
    return col.rlike(r"^T[0-9.]*[0-9][0-9.]*$")


def collapse_space(col: Column) -> Column:
    """Lower-case text with runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")


def band(value: Column, critical, high, medium, low) -> Column:
    """The four severity bands every threshold table of this package shares."""
    from casewright import vocab

    return (
        F.when(value >= vocab.BAND_CRITICAL, critical)
        .when(value >= vocab.BAND_HIGH, high)
        .when(value >= vocab.BAND_MEDIUM, medium)
        .otherwise(low)
    )


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null when the key is not in it."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None)


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` wildcards as an anchored regular expression."""
    import re

    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(ch, re.escape(ch)) for ch in pattern) + r"\z"


def utc_text_sql(ts: str) -> str:
    """``2024-01-31T10:20:30.000001`` of a timestamp in UTC, whatever the session's time zone, as SQL text."""
    micros = f"unix_micros({ts})"
    part = lambda per, of: f"lpad(CAST(pmod({micros}, {of}) DIV {per} AS STRING), 2, '0')"
    day, hour, minute, second = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
    return (
        f"concat(CAST(date_from_unix_date(CAST(floor({micros} / {day}) AS INT)) AS STRING), 'T', {part(hour, day)}, ':', "
        f"{part(minute, hour)}, ':', {part(second, minute)}, '.', lpad(CAST(pmod({micros}, {second}) AS STRING), 6, '0'))"
    )
