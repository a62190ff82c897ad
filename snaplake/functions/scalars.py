"""Tolerant scalar conversions: whatever the feeds put in a text field, a bad value becomes NULL.

Every function takes a column or a column name and returns a built-in Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which texts count as numbers and instants.
NUMBER_PATTERN = r"^\s*-?\d+(\.\d+)?([eE][-+]?\d+)?\s*$"
INSTANT_FORMATS = ("yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm:ssX")
ZONELESS_FORMAT = "yyyy-MM-dd HH:mm:ss"
FIRST_NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
FILLER_PATTERN = r"(?i)(the |is |was |is the |are the )"
CLOSING_PATTERN = r"[.,!?]$"
OUTER_PATTERN = r"^\s+|\s+$"
EXCERPT_CHARS = 100


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def real(value: Column | str) -> Column:
    """DOUBLE of a plainly written number; ``+5``, ``.5``, ``5.``, ``1,000`` and ``--`` are NULL."""
    text = as_column(value).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def whole(value: Column | str) -> Column:
    """BIGINT truncated toward zero; NULL outside the BIGINT range."""
    return real(value).try_cast("bigint")


def pair_part(value: Column | str, separator: str, part: int) -> Column:
    return whole(F.split_part(as_column(value), F.lit(separator), F.lit(part)))


def pair(value: Column | str, separator: str) -> tuple[Column, Column]:
    """Both counts of a text such as ``9-17``; a missing or malformed side is NULL."""
    return pair_part(value, separator, 1), pair_part(value, separator, 2)


def clock_seconds(value: Column | str) -> Column:
    """Seconds of a ``minutes:seconds`` text."""
    minutes, seconds = pair(value, ":")
    return F.try_add(F.try_multiply(minutes, F.lit(60)), seconds)


def instant(value: Column | str) -> Column:
    """TIMESTAMP of an ISO text with a zone, with or without seconds."""
    return F.coalesce(*(F.try_to_timestamp(as_column(value), F.lit(f)) for f in INSTANT_FORMATS))


def zoneless_instant(value: Column | str) -> Column:
    """TIMESTAMP of a text without a zone, read in the session zone (UTC)."""
    return F.try_to_timestamp(as_column(value), F.lit(ZONELESS_FORMAT))


def leading_date(value: Column | str) -> Column:
    """DATE in the first ten characters of an ISO text."""
    return F.try_to_date(F.substring(as_column(value), 1, 10), "yyyy-MM-dd")


def hex_color(value: Column | str) -> Column:
    return F.concat(F.lit("#"), F.lower(F.nullif(as_column(value), F.lit(""))))


def trimmed(value: Column | str) -> Column:
    return F.trim(as_column(value))


def stripped(value: Column | str) -> Column:
    """Text without outer whitespace of any kind."""
    return F.regexp_replace(as_column(value), OUTER_PATTERN, "")


def lowered(value: Column | str) -> Column:
    return F.lower(as_column(value))


def either(*values: Column | str) -> Column:
    return F.coalesce(*map(as_column, values))


def season_year(day: Column | str) -> Column:
    """Season a date belongs to: January and February still count to the year before."""
    day = as_column(day)
    return F.year(day) - (F.month(day) <= 2).cast("int")


def landing_day(moment: Column | str) -> Column:
    return F.date_format(as_column(moment), "yyyy-MM-dd")


def landing_name(prefix: str, moment: Column | str) -> Column:
    """``prefix/day/instant.json``, the name a landing file of that instant has."""
    iso = F.date_format(as_column(moment), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.concat_ws("/", F.lit(prefix), landing_day(moment), iso), F.lit(".json"))


def escape_like(text: str) -> str:
    """Literal text for a LIKE pattern whose escape character is the backslash."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in text)


def contains_text(value: Column | str, text: str) -> Column:
    """Case-insensitive containment, where ``%``, ``_`` and ``\\`` stand for themselves."""
    return F.lower(as_column(value)).contains(F.lower(F.lit(text)))


def words(value: Column | str) -> Column:
    return F.array_remove(F.split(as_column(value), r"\s+"), "")


def first_number(value: Column | str) -> Column:
    return F.regexp_extract(as_column(value), FIRST_NUMBER_PATTERN, 0).try_cast("double")


def bare_answer(value: Column | str) -> Column:
    """Answer text without filler words, closing punctuation and outer blanks."""
    text = F.regexp_replace(stripped(value), FILLER_PATTERN, "")
    return stripped(F.regexp_replace(text, CLOSING_PATTERN, ""))


def without_markdown(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_column(value)), r"\*\*|_", "")


def excerpt(value: Column | str) -> Column:
    return F.substring(as_column(value), 1, EXCERPT_CHARS)
