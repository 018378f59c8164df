"""Numeric parsing and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobsight import fixed_values as fv
from jobsight.functions.text import blank_to_null, strip

# Exact enough for money with up to six decimals; decimal sums do not depend on row order.
MONEY = "decimal(28,6)"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column) -> Column:
    """Double for a plain or scientific number, null for any other text (also NaN, 5d)."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def numeric_loose(c: Column) -> Column:
    """keep digits, dot and minus, then parse; ``(500)`` reads as 500."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def numeric_strict(c: Column) -> Column:
    """drop currency signs and commas, ``(x)`` is negative, round 2, null beyond one million."""
    bare = F.regexp_replace(c.cast("string"), "[£$,]", "")
    value = F.bround(parse_number(F.regexp_replace(bare, r"\(([^)]+)\)", "-$1")), 2)
    return F.when(F.abs(value) <= fv.LARGEST_SAFE_NUMBER, value)


def numeric_text(c: Column) -> Column:
    """F3 parser: currency signs, commas and spaces are dropped, text with letters is no number."""
    return parse_number(F.regexp_replace(c.cast("string"), r"[£$€,\s]", ""))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans count as numeric."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def number_of(df: DataFrame, name: str, loose: bool = True) -> Column:
    """Column ``name`` as double: a cast for typed columns, a parse for text."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return F.col(name).cast("double")
    return numeric_loose(F.col(name)) if loose else parse_number(F.col(name))


def boolean_text(c: Column) -> Column:
    """F12 cell test: is the non-null cell one of 0, 1, 0.0, 1.0?"""
    return strip(c).isin(fv.BOOLEAN_TEXTS)


def to_boolean(c: Column) -> Column:
    """F12 cast for a column that passed the test."""
    return parse_number(c) == 1.0


def pct(c: Column) -> Column:
    """a ratio as a percentage within 0..100, one decimal."""
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * 100)), 1)


def risk_level(score: Column, high: float, medium: float) -> Column:
    """F19."""
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def variance_pct(actual: Column, budget: Column, by_size: bool = False) -> Column:
    """change against the budget in percent, 0 when the budget is nil.

    The divisor is the budget with its sign, as for revenue; ``by_size`` divides by its
    absolute value, as for margins, where a negative budget is usual.
    """
    divisor = F.abs(budget) if by_size else budget
    return F.when(F.abs(budget) > 1e-9, (actual - budget) / divisor * 100).otherwise(F.lit(0.0))


def gross_margin(price: Column, cost: Column) -> Column:
    """F26."""
    return price - cost


def gross_margin_pct(price: Column, cost: Column) -> Column:
    """null without price or cost, or for a zero price."""
    return F.when(price != 0, (price - cost) / price * 100)


def first_price(*columns: Column) -> Column:
    """first column that holds a readable price."""
    return F.coalesce(*[numeric_loose(blank_to_null(c)) for c in columns])
