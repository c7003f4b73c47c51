"""Column functions on strings. All are built-in expressions; none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import rules as R


def trimmed(c: Column) -> Column:
    """Without white space at both ends, as strings are stripped of all of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Null for null, blank and 'None'; else lower-case, with spaces for underscores, not trimmed."""
    return F.when(~trimmed(c).isin("", "None"), F.translate(F.lower(c), "_", " "))


def split_values(c: Column) -> Column:
    """Lower-case values of a list in a string: split at , / ; & and the word 'and', trimmed, without empty ones. Null: empty."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[,/;&]|\band\b"), trimmed)
    return F.filter(parts, lambda x: x != "")


def clip_text(c: Column, n: int) -> Column:
    """White space as single spaces, trimmed, first ``n`` characters."""
    return F.substring(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)


def join_text(c: Column) -> Column:
    """The non-empty strings of a list, joined by spaces. Null: empty."""
    return F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), " "), F.lit(""))


def segment_of(categories: Column, depth: int = 2, other: str = "Other") -> Column:
    """The category at ``depth`` (from 0), else ``other``."""
    return F.coalesce(F.get(categories, depth), F.lit(other))


def to_number(c: Column) -> Column:
    """A double, or null if the string isn't one."""
    return c.try_cast("double")


def item_text(title: Column, features: Column, description: Column, max_chars: int) -> Column:
    """Text for an embedding: 'title. features description', trimmed, clipped. An item without texts gives '.'."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(trimmed(F.concat(blank(title), F.lit(". "), blank(features), F.lit(" "), blank(description))), 1, max_chars)


def tagged_text(title: Column, features: Column, description: Column) -> Column:
    """The title as a '[BIG] ' line, then features and description, a sentence in a line."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    body = F.regexp_replace(F.concat(blank(features), F.lit("\n"), blank(description)), r"(?U)(?<=[.!?])\s+", "\n")
    return F.concat(F.lit("[BIG] "), blank(title), F.lit("\n"), body)


def nonempty_text(c: Column) -> Column:
    """Whether a string is neither null, empty nor 'None'."""
    return F.coalesce(~c.isin("", "None"), F.lit(False))


def nonempty_list(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def ms_to_date(c: Column) -> Column:
    """The day of epoch milliseconds, in the session's time zone."""
    return F.to_date(F.timestamp_millis(c))


def strip_free(c: Column) -> Column:
    """Without 'x-free' and 'x free'."""
    return F.regexp_replace(c, "(?U)" + R.FREE_FROM, " ")


def strip_negation(c: Column) -> Column:
    """Also without what follows a negation, up to the next full stop or semicolon."""
    return F.regexp_replace(strip_free(c), "(?U)" + R.NEGATED, " ")


def normalised_words(c: Column) -> Column:
    """Lower-case, other characters than a-z, 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
