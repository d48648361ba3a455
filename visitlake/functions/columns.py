"""Columns that may be missing from an inferred or partial schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.fixed import UNKNOWN_CAMPAIGN as UNKNOWN


def optional_column(df: DataFrame, name: str, default=None) -> Column:
    """``df[name]`` when the schema has it, else a literal (decided at plan time)."""
    if name in df.columns:
        col = F.col(f"`{name}`")
        return col if default is None else F.coalesce(col, F.lit(default))
    return F.lit(default)


def with_campaign_default(df: DataFrame, source: str = "utm_source", name: str = "campaign_name") -> DataFrame:
    """Add ``campaign_name`` = utm_source, or "Unknown" when null or when the column is absent."""
    return df.withColumn(name, optional_column(df, source, UNKNOWN).cast("string"))
