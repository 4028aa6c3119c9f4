"""One revenue of record for several sources of the same sales."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.functions.exprs import safe_ratio
from adtide.functions.tables import attach
from adtide.functions.text import parse_date
from adtide.session import checkpoint

WEIGHT_ORDER = ["revenue", "conversions", "spend", "clicks", "impressions"]


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def date_key(value: Column) -> Column:
    """ISO day of a date text; unreadable text keeps its first ten characters."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.coalesce(parse_date(text).cast("string"), F.substring(text, 1, 10))


def revenue_authority(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: the source kind whose revenue counts, or NULL for a plain union."""
    kind = F.col("source_schema")

    def has(*names: str) -> Column:
        return F.max(kind.isin(*names))

    shop = has("shopify") & has("ga4", "ads", "generic_marketing", "mixed")
    web = has("ga4") & has("ads", "mixed")
    return rows.groupBy(*keys).agg(F.when(shop, "shopify").when(web, "ga4").alias("authority"))


def allocation_weights(support: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each row in its date by the first measure with a positive total, else equal shares.

    Totals come from a partial aggregation and are written, one row a date, so rows meet them without a shuffle while the
    dates are few; otherwise the skew handling of the join splits a date with a large part of all rows.
    """
    totals = checkpoint(
        support.groupBy(*by).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_total_{c}") for c in WEIGHT_ORDER])
    )
    joined = support.join(totals, list(by))
    weight = F.when(F.lit(False), F.lit(0.0))
    for c in WEIGHT_ORDER:
        weight = weight.when(F.col(f"_total_{c}") > 0, safe_ratio(c, f"_total_{c}"))
    weight = weight.otherwise(F.lit(1.0) / F.col("_rows"))
    return joined.withColumn("weight", weight).drop("_rows", *[f"_total_{c}" for c in WEIGHT_ORDER])


def reconcile(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spread the authority's revenue over the supporting rows of the same date.

    Authority rows remain only on dates without support; support-only dates are kept as they are.
    Keys without an authority pass through unchanged.

    The totals of both sides come from one aggregation and are written, one row a date, so rows meet them in a single join
    that needs no shuffle of the rows while the dates are few and splits a hot date otherwise.
    """
    tagged = attach(rows, revenue_authority(rows, keys), keys)
    on = [*keys, "date"]
    known = F.col("authority").isNotNull()
    leads = known & (F.col("source_schema") == F.col("authority"))
    of_support = lambda c: F.sum(F.when(~leads, F.col(c)))
    totals = checkpoint(
        tagged.filter(known).groupBy(*on).agg(
            F.sum(F.when(leads, F.col("revenue"))).alias("_authority_revenue"), F.count_if(leads).alias("_leads"), F.count_if(~leads).alias("_rows"),
            *[of_support(c).alias(f"_total_{c}") for c in WEIGHT_ORDER])
    )
    weight = F.when(F.lit(False), F.lit(0.0))
    for c in WEIGHT_ORDER:
        weight = weight.when(F.col(f"_total_{c}") > 0, safe_ratio(c, f"_total_{c}"))
    weight = weight.otherwise(F.lit(1.0) / F.col("_rows"))
    joined = tagged.join(totals, on, "left").filter(~known | ~leads | (F.col("_rows") == 0))
    spread = known & ~leads & (F.col("_leads") > 0)
    label = F.concat(F.lit("reconciled_"), F.col("authority"))
    revenue = F.when(spread, weight * F.col("_authority_revenue")).otherwise(F.col("revenue"))
    kind = F.when(spread, F.concat(label, F.lit("_with_media"))).when(leads, label).otherwise(F.col("source_schema"))
    return joined.withColumns({"revenue": revenue, "source_schema": kind}).select(*rows.columns)


def date_overlap(rows: DataFrame, source: str, keys: Sequence[str] = ()) -> DataFrame:
    """Shared dates over all dates of the sources, in percent (100 for one source)."""
    pairs = rows.filter(F.col("date").isNotNull()).groupBy(*keys, "date", source).agg(F.lit(1).alias("one"))
    per_day = pairs.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    sources = pairs.groupBy(*keys, source).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("sources"))
    joined = attach(per_day, sources, keys)
    return joined.groupBy(*keys).agg(
        (F.sum((F.col("n") == F.col("sources")).cast("int")) * 100.0 / F.count("*")).alias("date_overlap_pct")
    )


def duplicate_sources(rows: DataFrame, source: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sources whose content equals another's, whatever the row order: an additive and an xor content hash."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.xxhash64(*text)
    prints = rows.groupBy(*keys, source).agg(
        F.count("*").alias("n"),
        F.sum(digest.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit("salt"), *text)).alias("mixed"),
    )
    groups = prints.groupBy(*keys, "n", "total", "mixed").agg((F.count("*") - 1).alias("extra"))
    return groups.groupBy(*keys).agg(F.sum("extra").alias("duplicate_sources"))
