"""Columns that may be absent: one code path for full and partial inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def column_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """Column ``name``, or a typed null when the input does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def align_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Exactly the required columns in order; missing ones are typed nulls."""
    return df.select([column_or_null(df, n, t).cast(t).alias(n) for n, t in required.items()])
