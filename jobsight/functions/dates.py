"""Dates, lead times and durations.

Text is read as ISO first and then day-first, each cell on its own, so the same
cell means the same date whatever else the column holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobsight.functions.text import strip

# A date, and perhaps a time of day after it.
_SPLIT = r"^(.*?\d)(?:T|,?\s+)(\d{1,2}(?::\d{2}){1,2}.*|\d{1,2}\s*[AaPp]\.?[Mm]\.?)$"
# Dates as (pattern, year-month-day): year first; digits only; day first; day first with a short year.
_NUMERIC_DATES = [
    (r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]([0-6]\d)$", "20$3-$2-$1"),
    (r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]([7-9]\d)$", "19$3-$2-$1"),
]
# Dates with a month by name, brought to (day, first three letters, year).
_NAMED_DATES = [
    (r"^(\d{1,2})(?:st|nd|rd|th)?[ \-/.]+([A-Za-z]{3})[A-Za-z]*\.?,?[ \-/.]+(\d{4})$", "$1 $2 $3"),
    (r"^([A-Za-z]{3})[A-Za-z]*\.?[ \-]+(\d{1,2})(?:st|nd|rd|th)?,?[ \-]+(\d{4})$", "$2 $1 $3"),
]
# How any of these dates begins: one look tells most other text apart.
_BEGINS = (
    r"^(?:\d{4}[/.\-]\d|\d{8}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d|\d{1,2}(?:st|nd|rd|th)?[ \-/.]+[A-Za-z]{3}[A-Za-z]*\.?,?[ \-/.]+\d"
    r"|[A-Za-z]{3}[A-Za-z]*\.?[ \-]+\d{1,2}(?:st|nd|rd|th)?,?[ \-])"
)
_HALF_DAY = r"(?i)^(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*([ap])\.?m\.?$"


def _time_of_day(text: Column) -> Column:
    """``2:30 PM`` as ``14:30:00``; other times as they are."""
    hour = F.regexp_extract(text, _HALF_DAY, 1).try_cast("int") % 12
    later = F.when(F.lower(F.regexp_extract(text, _HALF_DAY, 4)) == "p", 12).otherwise(0)
    part = lambda i: F.lpad(F.regexp_extract(text, _HALF_DAY, i), 2, "0")  # noqa: E731  an absent part is 00
    clock = F.concat_ws(":", F.lpad((hour + later).cast("string"), 2, "0"), part(2), part(3))
    return F.when(text.rlike(_HALF_DAY), clock).otherwise(text)


def parse_datetime(c: Column) -> Column:
    """timestamp of a text cell, null for blanks, zero dates, ``NaT`` and other unreadable text.

    Year first, day first (also with two digits for the year, 1970 to 2069), digits only, and
    months by name on either side of the day; a time of day may follow, also with AM or PM.
    """
    cell = strip(c.cast("string"))
    has_time = cell.rlike(_SPLIT)
    day = strip(F.when(has_time, F.regexp_extract(cell, _SPLIT, 1)).otherwise(cell))
    time = F.when(has_time, F.concat(F.lit(" "), _time_of_day(F.regexp_extract(cell, _SPLIT, 2)))).otherwise("")
    found = F.lit(None).cast("string")
    for pattern, order in reversed(_NAMED_DATES):
        named = F.try_to_timestamp(F.initcap(F.regexp_replace(day, pattern, order)), F.lit("d MMM yyyy"))
        found = F.when(day.rlike(pattern), F.date_format(named, "yyyy-MM-dd")).otherwise(found)
    for pattern, order in reversed(_NUMERIC_DATES):
        found = F.when(day.rlike(pattern), F.regexp_replace(day, pattern, order)).otherwise(found)
    return F.when(cell.rlike(_BEGINS), F.concat(found, time).try_cast("timestamp_ntz"))


def clean_date(c: Column) -> Column:
    """the date of a text cell."""
    return parse_datetime(c).cast("date")


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def datetime_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` as timestamp: a cast for typed columns, a parse for text."""
    if is_datetime(df.schema[name].dataType):
        return F.col(name).cast("timestamp_ntz")
    return parse_datetime(F.col(name))


def _seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def whole_days(start: Column, end: Column) -> Column:
    """whole days from start to end, rounded down (-23 hours is -1 day)."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    days = F.datediff(end, start)
    return (days - F.when(_seconds_of_day(end) < _seconds_of_day(start), 1).otherwise(0)).cast("long")


def duration_hours(c: Column) -> Column:
    """``HH:MM:SS`` (hours may pass 24), ``2 days 03:00:00``, ``90 min`` -> hours.

    A plain number is taken as hours.
    """
    text = F.lower(strip(c))

    def amount(sign: str, pattern: str, group: int = 1) -> Column:
        # Every match holds the sign, and a look for one character costs far less than a pattern.
        return F.when(F.contains(text, F.lit(sign)), F.regexp_extract(text, pattern, group).try_cast("double"))

    clock = r"(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)"
    parts = [
        (amount("d", r"(\d+(?:\.\d+)?)\s*d(?:ays?)?\b"), 86400),
        (amount("h", r"(\d+(?:\.\d+)?)\s*h(?:ours?|rs?)?\b"), 3600),
        (amount("m", r"(\d+(?:\.\d+)?)\s*m(?:in(?:ute)?s?)?\b"), 60),
        (amount("s", r"(\d+(?:\.\d+)?)\s*s(?:ec(?:ond)?s?)?\b"), 1),
        (amount(":", clock), 3600),
        (amount(":", clock, 2), 60),
        (amount(":", clock, 3), 1),
    ]
    seconds = sum((F.coalesce(value, F.lit(0.0)) * unit for value, unit in parts), F.lit(0.0))
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    found = F.coalesce(*[value for value, _ in parts]).isNotNull()
    plain = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
    return F.coalesce(plain, F.when(found, sign * seconds / 3600))


def duration_hours_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` in hours: numbers are hours already, intervals and text are converted."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.col(name).cast("interval second").cast("decimal(20,6)").cast("double") / 3600
    return duration_hours(F.col(name))


def valid_date(c: Column) -> Column:
    """F23 cell test: does the cell hold a date?"""
    return parse_datetime(c).isNotNull()
