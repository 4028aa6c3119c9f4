"""Anomalies, trend breaks and spend-response associations per channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import correlation, round_to, spend_response
from adtide.operators.rollup import month_over_month
from adtide.operators.windows import delta_lag, pct_change_3, zscore
from adtide.schema import (
    ANOMALY_CRITICAL_Z,
    ANOMALY_Z,
    CUSUM_MIN_ROWS,
    CUSUM_SLACK_SD,
    CUSUM_THRESHOLD_SD,
    ROAS_FALL,
    ROAS_FALL_CRITICAL,
)

METRICS = ["revenue", "spend", "roas", "ctr"]


def metric_zscores(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each metric of a channel against its 28 rows before. The metric is a column of its own window key."""
    long = daily.unpivot([*keys, "channel", "date"], METRICS, "metric", "actual")
    return long.withColumns(zscore([*keys, "channel", "metric"], "actual"))


def detect_anomalies(daily: DataFrame, keys: Sequence[str] = (), threshold: float = ANOMALY_Z) -> DataFrame:
    """Points outside their rolling range, and ROAS falls over three rows."""
    out = [*keys, "date", "channel", "metric", "actual", "expected", "z_score", "severity"]
    scored = metric_zscores(daily, keys).filter(F.abs("z") > threshold)
    outliers = scored.select(
        *keys,
        "date",
        "channel",
        "metric",
        round_to("actual", 4).alias("actual"),
        round_to("expected", 4).alias("expected"),
        round_to("z", 2).alias("z_score"),
        F.when(F.abs("z") > ANOMALY_CRITICAL_Z, "critical").otherwise("warning").alias("severity"),
    )
    change = F.col("roas_change_3")
    falls = pct_change_3(daily, [*keys, "channel"]).filter(change < ROAS_FALL).select(
        *keys,
        "date",
        "channel",
        F.lit("roas").alias("metric"),
        round_to("roas", 4).alias("actual"),
        round_to("roas_past_3", 4).alias("expected"),
        round_to(change * 10.0, 2).alias("z_score"),
        F.when(change <= ROAS_FALL_CRITICAL, "critical").otherwise("warning").alias("severity"),
    )
    return outliers.select(*out).unionByName(falls.select(*out))


def trend_breaks(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sided CUSUM of channel revenue that restarts after each alarm.

    The restart makes it a fold over time. It runs as one ``aggregate`` over the channel's ordered days,
    which is at most one value per calendar day.
    """
    by = [*keys, "channel"]
    series = daily.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("date", "revenue"))).alias("days"),
        F.avg("revenue").alias("mean"),
        F.stddev_samp("revenue").alias("sd"),
    ).filter(F.size("days") >= CUSUM_MIN_ROWS)
    series = series.withColumn("sd", F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd")))
    start = F.struct(
        F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("alarms"),
    )

    def step(acc: Column, day: Column) -> Column:
        centred = day["revenue"] - F.col("mean")
        up = F.greatest(acc["up"] + centred - F.col("sd") * CUSUM_SLACK_SD, F.lit(0.0))
        down = F.least(acc["down"] + centred + F.col("sd") * CUSUM_SLACK_SD, F.lit(0.0))
        limit = F.col("sd") * CUSUM_THRESHOLD_SD
        alarm = (up > limit) | (-down > limit)
        return F.struct(
            F.when(alarm, 0.0).otherwise(up).alias("up"),
            F.when(alarm, 0.0).otherwise(down).alias("down"),
            (acc["i"] + 1).alias("i"),
            F.when(alarm, F.concat(acc["alarms"], F.array(acc["i"]))).otherwise(acc["alarms"]).alias("alarms"),
        )

    alarms = series.withColumn("i", F.explode(F.aggregate("days", start, step)["alarms"]))
    i = F.col("i")

    def mean(first: Column, n: Column) -> Column:
        part = F.slice("days", first + 1, n)
        total = F.aggregate(part, F.lit(0.0), lambda a, d: a + d["revenue"])
        return total / F.size(part)

    low = F.greatest(i - 14, F.lit(0))
    previous = mean(low, F.greatest(i - 1, F.lit(1)) - low)
    rows = alarms.select(
        *by,
        F.element_at("days", i + 1)["date"].alias("date"),
        F.when(previous == 0, 1.0).otherwise(previous).alias("_previous"),
        mean(i, F.lit(7)).alias("_current"),
    )
    size = F.try_divide(F.col("_current") - F.col("_previous"), F.col("_previous")) * 100.0
    return rows.select(
        *by,
        "date",
        F.when(size >= 0, "up").otherwise("down").alias("direction"),
        round_to(size, 2).alias("magnitude_pct"),
    )


def channel_vs_blended(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Channel days with the revenue and spend of all channels on the day: a window, not a join."""
    w = Window.partitionBy(*keys, "date")
    return daily.withColumns(
        {"blended_spend": F.sum("spend").over(w), "blended_revenue": F.sum("revenue").over(w)}
    )


def driver_evidence(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Correlations of spend changes with channel and blended revenue changes."""
    days = daily.groupBy(*keys, "date").agg(F.sum("revenue").alias("total"))
    blended = days.select(
        *keys, "date",
        (F.col("total") - F.lag("total").over(Window.partitionBy(*keys).orderBy("date"))).alias("blended_delta"),
    )
    own = delta_lag(daily.select(*keys, "channel", "date", "spend", "revenue"), [*keys, "channel"], ["spend", "revenue"])
    joined = own.join(blended, [*keys, "date"])
    stats = joined.groupBy(*keys, "channel").agg(
        F.count(F.when(F.col("spend_delta").isNotNull() & F.col("revenue_delta").isNotNull(), 1)).alias("observations"),
        correlation("spend_delta", "revenue_delta").alias("channel_corr"),
        correlation("spend_delta", "blended_delta").alias("blended_corr"),
        correlation("spend_delta_lag", "blended_delta").alias("lagged_corr"),
    )
    ref = F.coalesce("blended_corr", "channel_corr")
    size = F.abs(ref)
    return stats.filter((F.col("observations") >= 6) & ref.isNotNull()).select(
        *keys,
        "channel",
        "observations",
        round_to(ref, 3).alias("spend_revenue_corr"),
        round_to("channel_corr", 3).alias("channel_revenue_corr"),
        round_to("lagged_corr", 3).alias("lagged_revenue_corr"),
        F.when(ref >= 0.1, "positive").when(ref <= -0.1, "negative").otherwise("mixed").alias("direction"),
        F.when(size >= 0.6, "strong").when(size >= 0.3, "moderate").otherwise("weak").alias("strength"),
    )


def elasticity_cases(fact: DataFrame, keys: Sequence[str] = (), threshold: float = 0.15) -> DataFrame:
    """Months with a material spend change: revenue predicted by the response curve against the actual."""
    mom = month_over_month(fact, keys).filter((F.col("previous_spend") > 1e-9) & (F.col("previous_revenue") > 1e-9))
    ratio = F.col("spend") / F.col("previous_spend")
    cases = mom.filter(F.abs(ratio - 1.0) >= threshold).withColumn(
        "predicted_revenue", F.col("previous_revenue") * spend_response(ratio)
    )

    def direction(new: str) -> Column:
        return F.signum(F.col(new) - F.col("previous_revenue"))

    error = F.abs(F.col("predicted_revenue") - F.col("revenue"))
    return cases.withColumns(
        {
            "absolute_error": error,
            "ape": error / F.greatest(F.col("revenue"), F.lit(1.0)) * 100.0,
            "direction_match": direction("revenue") == direction("predicted_revenue"),
        }
    )


def elasticity_check(fact: DataFrame, keys: Sequence[str] = (), threshold: float = 0.15) -> DataFrame:
    return elasticity_cases(fact, keys, threshold).groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.avg("absolute_error").alias("mae"),
        F.avg("ape").alias("mape"),
        (F.avg(F.col("direction_match").cast("double")) * 100.0).alias("direction_accuracy"),
    )
