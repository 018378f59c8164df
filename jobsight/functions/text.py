"""Text functions: blanks, postcodes, multi-valued cells, yes/no answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from jobsight import fixed_values as fv

# The token before white space, or else the leading area, or else up to four characters.
_OUTWARD = r"^(?:\S+(?=\s)|[A-Z]{1,2}\d[A-Z\d]?|.{1,4})"
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left (a numeric 0 is not blank)."""
    return F.nullif(strip(c), F.lit(""))


def missing_to_null(c: Column) -> Column:
    """trimmed text; blank and the spelling ``nan`` become null."""
    return F.nullif(blank_to_null(c), F.lit("nan"))


def first_filled(*columns: Column) -> Column:
    """First non-blank text among the columns (F22 aliases)."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def any_filled(*columns: Column) -> Column:
    """True when at least one column is non-blank."""
    return first_filled(*columns).isNotNull()


def all_filled(*columns: Column) -> Column:
    """True when every column is non-blank."""
    return reduce(lambda a, b: a & b, [blank_to_null(c).isNotNull() for c in columns])


def contains_any(c: Column, words: list[str]) -> Column:
    """True when the lower-cased text holds any of the words; a null text holds none."""
    lowered = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def list_parts(c: Column) -> Column:
    """the non-blank trimmed parts of a ``|``-separated cell; null cell -> empty array."""
    parts = F.transform(F.split(c.cast("string"), "[|]"), lambda p: strip(p))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def distinct_keys(parts: Column) -> Column:
    """The parts of a cell lower-cased, each once."""
    return F.array_distinct(F.transform(parts, lambda p: F.lower(p)))


def list_keys(c: Column) -> Column:
    """Distinct lower-cased parts: what a name is matched against."""
    return distinct_keys(list_parts(c))


def has_member(cell: Column, name: Column) -> Column:
    """The trimmed lower-cased name equals one part; a blank name matches nothing."""
    key = F.lower(blank_to_null(name))
    return F.coalesce(F.array_contains(list_keys(cell), key), F.lit(False))


def same_client(client: Column, name: Column) -> Column:
    """Case-insensitive equality; only the asked name is trimmed."""
    return F.lower(F.coalesce(client, F.lit(""))) == F.lower(strip(name))


def outward_simple(c: Column) -> Column:
    """F8: first white-space token of the upper-cased postcode, null when blank."""
    return F.split(F.upper(blank_to_null(c)), r"\s+").getItem(0)


def outward_postcode(c: Column) -> Column:
    """outward part of a postcode, null when blank.

    With a space the first token; without one the leading letters-digit area, and
    failing that the first four characters. It also works on compacted postcodes,
    so the domain operators use this form.
    """
    return F.nullif(F.regexp_extract(F.upper(strip(c)), _OUTWARD, 0), F.lit(""))


def compact_postcode(c: Column) -> Column:
    """upper-cased without any white space; null stays null."""
    return F.upper(F.regexp_replace(c.cast("string"), r"\s+", ""))


def yes_no(c: Column) -> Column:
    """common yes/no spellings -> Yes/No, anything else trimmed."""
    text = strip(c)
    lowered = F.lower(text)
    return F.when(lowered.isin(fv.YES_TEXTS), "Yes").when(lowered.isin(fv.NO_TEXTS), "No").otherwise(text)
