"""Status flags and event flags of one job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobsight import fixed_values as fv
from jobsight.functions.text import contains_any


def says_cancelled(status: Column) -> Column:
    return contains_any(status, fv.CANCELLED_WORDS)


def says_completed(status: Column) -> Column:
    """Completed by wording alone; a cancelled job may say so too (used by the risk scores)."""
    return contains_any(status, fv.COMPLETED_WORDS)


def is_active(status: Column) -> Column:
    """An active word and no cancelled word."""
    return contains_any(status, fv.ACTIVE_WORDS) & ~says_cancelled(status)


def is_completed(status: Column) -> Column:
    """A completed word and no cancelled word."""
    return says_completed(status) & ~says_cancelled(status)


def status_group(status: Column) -> Column:
    """P5: one label, first match wins."""
    return (
        F.when(says_cancelled(status), "cancelled")
        .when(says_completed(status), "completed")
        .when(contains_any(status, fv.ACTIVE_WORDS), "active")
        .otherwise("other")
    )
