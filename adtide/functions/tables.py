"""Small table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-key totals on every row: an equi-join, or one scalar subquery where there are no keys."""
    if keys:
        return df.join(totals, list(keys), "left")
    packed = totals.select(F.struct(*totals.columns).alias("_totals")).scalar()
    return df.withColumn("_totals", packed).select("*", "_totals.*").drop("_totals")
