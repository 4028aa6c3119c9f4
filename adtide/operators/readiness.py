"""Data-readiness scorecard: one aggregate row per key, then component rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.functions.exprs import freshness, present, round_score, round_to, safe_ratio
from adtide.functions.tables import attach
from adtide.operators.quality import campaign_inconsistency
from adtide.operators.rollup import daily_channel
from adtide.operators.signals import detect_anomalies
from adtide.schema import CANONICAL_COLUMNS, MEASURES, PLACEHOLDER_TEXT, READINESS_WEIGHTS, SCHEMA_CONFIDENCE, TEXT_DIMS

INVALID_ISSUES = ["invalid_date", "invalid_number", "missing", "negative_spend", "invalid_revenue", "campaign_inconsistency"]


def placeholder(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin(PLACEHOLDER_TEXT)


def missing_rate(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Missing cells over all canonical cells: placeholder text, and numbers that are absent or not finite."""
    text = [placeholder(c).cast("int") for c in ["date", *TEXT_DIMS]]
    numbers = [
        (F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in [*MEASURES, "roas"]
    ]
    cells = sum([*text, *numbers], F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), (F.sum(cells) / (F.count("*") * len(CANONICAL_COLUMNS))).alias("missing_rate")
    )


def coverage_rates(clean: DataFrame, as_of: str, keys: Sequence[str] = ()) -> DataFrame:
    """History, freshness, breadth and positive shares of the valid rows."""
    known = ~placeholder("channel")
    today = F.to_date(F.lit(as_of))
    return clean.groupBy(*keys).agg(
        F.count("*").alias("valid_rows"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("history_days"),
        F.datediff(today, F.max("date")).alias("freshness_days"),
        F.count(F.when(F.col("date") > today, 1)).alias("future_rows"),
        *[
            F.countDistinct(F.when(known, F.col(c))).alias(n)
            for c, n in (("channel", "channels"), ("campaign_name", "campaigns"), ("campaign_type", "campaign_types"))
        ],
        F.avg((F.col("spend") > 0).cast("double")).alias("spend_coverage"),
        F.avg((F.col("revenue") > 0).cast("double")).alias("revenue_coverage"),
    )


def outlier_rate(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days of a channel with a critical anomaly over all days of channels."""
    daily = daily_channel(clean, keys)
    severe = detect_anomalies(daily, keys).filter(F.col("severity") == "critical").select(*keys, "date", "channel").distinct()
    total = daily.groupBy(*keys).agg(F.count("*").alias("channel_days"))
    hits = severe.groupBy(*keys).agg(F.count("*").alias("severe_days"))
    joined = attach(total, hits, keys).withColumn("severe_days", F.coalesce("severe_days", F.lit(0)))
    return joined.withColumn("outlier_rate", F.col("severe_days") / F.greatest("channel_days", F.lit(1)))


def issue_rates(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with a blocking issue, duplicate rows, and unreadable numbers.

    A row's issues are two bits; only rows that have one are shuffled, a number and its bits each, so that equal numbers
    count once. A campaign's mapping conflict blocks its first row.
    """
    types = F.transform("issues", lambda i: i["type"])
    blocked = F.arrays_overlap(types, F.array(*map(F.lit, INVALID_ISSUES)))
    bits = F.when(blocked, 1).otherwise(0) + F.when(F.array_contains(types, "duplicate"), 2).otherwise(0)
    listed = flagged.filter(F.size("issues") > 0).select(*keys, "row", bits.alias("_bits"))
    conflicts = campaign_inconsistency(flagged, keys).select(*keys, "row", F.lit(1).alias("_bits"))
    rows = listed.unionByName(conflicts).groupBy(*keys, "row").agg(F.bit_or("_bits").alias("_bits"))
    count = lambda bit, name: F.count_if(F.col("_bits").bitwiseAND(bit) > 0).alias(name)
    by_row = rows.groupBy(*keys).agg(count(1, "invalid_rows"), count(2, "duplicate_rows"))
    cells = flagged.groupBy(*keys).agg(F.sum(F.size("invalid_fields")).alias("invalid_cells"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("invalid_rows", "duplicate_rows")}
    return attach(cells, by_row, keys).withColumns(zero)


def schema_scores(kinds: DataFrame, issue_lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mapped core fields and schema confidence over the sources of a key.

    ``kinds`` is the source profile; ``issue_lines`` has one row per source and adapter issue.
    """
    base = F.coalesce(*[F.when(F.col("source_kind") == k, v) for k, v in SCHEMA_CONFIDENCE.items()], F.lit(70.0))
    agg = kinds.groupBy(*keys).agg(
        F.avg(base).alias("_confidence"),
        *[F.max(F.array_contains("mapped", f).cast("int")).alias(f"_{f}") for f in ("date", "spend", "revenue")],
    )
    lines = issue_lines.groupBy(*keys).agg(F.count("*").alias("_issues"))
    joined = attach(agg, lines, keys)
    penalty = F.least(F.coalesce("_issues", F.lit(0)) * 3.0, F.lit(25.0))
    return joined.select(
        *keys,
        ((F.col("_date") + F.col("_spend") + F.col("_revenue")) * 100.0 / 3.0).alias("required_completeness"),
        F.greatest(F.col("_confidence") - penalty, F.lit(0.0)).alias("schema_confidence"),
    )


def breadth(n: str) -> Column:
    c = F.col(n)
    return F.when(c <= 0, 0.0).when(c == 1, 50.0).when(c == 2, 75.0).otherwise(100.0)


def readiness_values(
    normalized: DataFrame,
    flagged: DataFrame,
    clean: DataFrame,
    schema: DataFrame,
    overlap: DataFrame,
    as_of: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """All readiness figures of a key in one row, with the seven component scores."""
    df = missing_rate(normalized, keys)
    for part in (
        issue_rates(flagged, keys),
        coverage_rates(clean, as_of, keys),
        outlier_rate(clean, keys),
        schema,
        overlap,
    ):
        df = attach(df, part, keys)
    invalid = F.greatest(
        F.least(F.col("invalid_cells") / (F.col("rows") * (len(MEASURES) + 2)), F.lit(1.0)), F.col("invalid_rows") / F.col("rows")
    )
    df = df.withColumns({"invalid_rate": invalid, "duplicate_rate": F.col("duplicate_rows") / F.col("rows")})
    values = {
        "schema_required": F.col("required_completeness") * 0.7 + F.col("schema_confidence") * 0.3,
        "completeness_validity": F.greatest(1.0 - F.col("missing_rate") * 0.55 - F.col("invalid_rate") * 0.45, F.lit(0.0)) * 100.0,
        "historical_coverage": F.least(F.col("history_days") / 180.0 * 100.0, F.lit(100.0)) * 0.8 + F.col("date_overlap_pct") * 0.2,
        "freshness": freshness("freshness_days", "future_rows"),
        "channel_campaign_coverage": breadth("channels") * 0.4 + breadth("campaigns") * 0.35 + breadth("campaign_types") * 0.25,
        "spend_revenue_consistency": F.col("spend_coverage") * 50.0 + F.col("revenue_coverage") * 50.0,
        "outliers_duplicates": F.greatest(100.0 - F.col("duplicate_rate") * 200.0, F.lit(0.0)) * 0.5
        + F.greatest(100.0 - F.col("outlier_rate") * 500.0, F.lit(0.0)) * 0.5,
    }
    df = df.withColumns({f"c_{k}": v for k, v in values.items()})
    total = sum((F.col(f"c_{k}") * (w / 100.0) for k, w in READINESS_WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("score", round_score(total))
    return df.withColumn(
        "rating",
        F.when(F.col("score") >= 90, "Excellent")
        .when(F.col("score") >= 75, "Good")
        .when(F.col("score") >= 60, "Usable with caution")
        .otherwise("Needs attention"),
    )


def readiness_components(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("component"), round_score(f"c_{k}").alias("component_score"), F.lit(w).alias("weight"))
                for k, w in READINESS_WEIGHTS.items()
            ]
        )
    )
    return values.select(*keys, "score", "rating", rows)


def confidence_factors(values: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What supports and what reduces trust in a forecast.

    ``forecast`` has ``interval_width_pct`` and the plan ``zone`` (NULL without a plan) per key.
    """
    df = attach(values, forecast, keys)
    good = [
        ("readiness", F.col("score") >= 75),
        ("history", F.col("history_days") >= 180),
        ("freshness", F.col("freshness_days") <= 7),
        ("missing", F.col("missing_rate") * 100.0 <= 1),
        ("width", F.col("interval_width_pct") <= 25),
        ("sample", F.col("valid_rows") >= 180),
        ("zone", F.coalesce(F.col("zone") == "SUPPORTED", F.lit(True))),
    ]
    return df.select(
        *keys,
        F.array_join(present([(c, F.lit(n)) for n, c in good]), ",").alias("positive"),
        F.array_join(present([(~c, F.lit(n)) for n, c in good]), ",").alias("reducing"),
    )
