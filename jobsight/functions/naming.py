"""Column names: normalizing, look-up and what a name says about a target."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from jobsight import fixed_values as fv


def plain_name(name: str) -> str:
    """S3: trimmed, lower case, spaces, slashes and dashes as underscores."""
    return re.sub(r"[ /\-]", "_", str(name).strip().lower())


def snake_name(name: str) -> str:
    """Every run of non-word characters becomes one underscore, none at the ends."""
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", str(name).strip().lower())).strip("_")


def _renamed(df: DataFrame, rule) -> DataFrame:
    """Rename by ``rule``; of columns that end up with one name the first is kept."""
    names = [rule(c) for c in df.columns]
    unique = df.toDF(*[f"_c{i}" for i in range(len(names))])
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return unique.select([F.col(f"_c{i}").alias(name) for name, i in first.items()])


def normalize_columns(df: DataFrame) -> DataFrame:
    """S3."""
    return _renamed(df, plain_name)


def snake_columns(df: DataFrame) -> DataFrame:
    """S4."""
    return _renamed(df, snake_name)


def resolve_target(df: DataFrame, target: str) -> str:
    """The column a user means, after normalizing the name."""
    for name in (plain_name(target), target):
        if name in df.columns:
            return name
    raise ValueError(f"Target column '{target}' not found.")


def target_hint(name: Column) -> Column:
    """``date``, ``identifier`` or ``standard`` from the column name."""
    lowered = F.lower(name)
    words = "|".join(fv.IDENTIFIER_WORDS)
    return (
        F.when(lowered.rlike("|".join(fv.DATE_TARGET_WORDS)), "date")
        .when(lowered.rlike(f"(^|_)({words})$"), "identifier")
        .otherwise("standard")
    )
