"""As-of feature vectors per segment, cut date and horizon, built in one windowed pass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, clean_number, safe_ratio
from adtide.operators.rollup import sums, with_roas
from adtide.operators.windows import SEGMENT, trailing, trailing_sums, with_half_trends
from adtide.schema import FEATURES, HORIZONS, MEASURES, TREND_WEIGHT

LEVEL_CODES = {"overall": 0.0, "channel": 1.0, "campaign_type": 2.0, "campaign": 3.0}

def segment_series(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The four-grain daily series with each day's last channel and type and the campaigns new on it."""
    dims = ["channel", "campaign_type", "campaign_name"]
    marked = fact.withColumns({"_c": F.col("channel"), "_t": F.col("campaign_type")})
    sets = [[*keys, "date"], *[[*keys, "date", d] for d in dims]]
    daily = marked.groupingSets(sets, *keys, "date", *dims).agg(
        F.grouping_id().alias("gid"), *sums(), F.max("_c").alias("last_channel"), F.max("_t").alias("last_type")
    )
    # First day of each campaign within each segment; counted per day, so a running sum gives the distinct count.
    pairs = fact.groupBy(*keys, *dims).agg(F.min("date").alias("_first")).withColumn("_m", F.col("campaign_name"))
    groups = [[*keys, "_m"], *[[*keys, "_m", d] for d in dims]]
    firsts = pairs.groupingSets(groups, *keys, "_m", *dims).agg(F.grouping_id().alias("gid"), F.min("_first").alias("date"))

    def named(df: DataFrame) -> DataFrame:
        gid = F.col("gid")
        level = F.when(gid == 7, "overall").when(gid == 3, "channel").when(gid == 5, "campaign_type").otherwise("campaign")
        segment = F.when(gid == 7, "all").otherwise(F.coalesce(*[F.col(d) for d in dims]))
        return df.withColumns({"level": level, "segment": segment}).drop("gid", *dims).filter(F.col("segment") != "")

    new = named(firsts).groupBy(*keys, *SEGMENT, "date").agg(F.count("*").alias("new_campaigns"))
    joined = with_roas(named(daily)).join(new, [*keys, *SEGMENT, "date"], "left")
    return joined.select(
        *keys, *SEGMENT, "date", *MEASURES, "roas", "last_channel", "last_type",
        F.coalesce("new_campaigns", F.lit(0)).alias("new_campaigns"),
    )


def asof_base(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trailing sums, trends and deviations at every row; one sort per segment."""
    by = [*keys, *SEGMENT]
    df = trailing_sums(series, by, MEASURES)
    df = with_half_trends(df, by, ["spend", "revenue", "roas"])
    order = Window.partitionBy(*by).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"n": F.row_number().over(order), "unique_campaigns": F.sum("new_campaigns").over(upto).cast("double")})

    def std(c: str, rows: int, least: int) -> Column:
        return F.when(F.col("n") >= least, F.coalesce(F.stddev_samp(c).over(trailing(by, rows)), F.lit(0.0))).otherwise(0.0)

    return df.withColumns(
        {
            "rev_std_14": std("revenue", 14, 4),
            "rev_std_28": std("revenue", 28, 7),
            "rev_std_56": std("revenue", 56, 14),
            "roas_std_56": std("roas", 56, 14),
        }
    )


def with_references(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of the whole account and of the row's channel and campaign type at the same cut.

    The reference segment always has a row on the cut day, so these are equi-joins on the day.
    """
    ref = base.select(*keys, *SEGMENT, "date", "spend_28", "spend_56", "revenue_56")

    def side(level: str, prefix: str, key: str | None) -> DataFrame:
        out = ref.filter(F.col("level") == level).select(
            *keys, "date", F.col("segment").alias("_seg"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("spend_28", "spend_56", "revenue_56")],
        )
        return out.drop("_seg") if key is None else out.withColumnRenamed("_seg", key)

    df = base.withColumns(
        {
            "ref_channel": F.when(F.col("level") == "channel", F.col("segment")).otherwise(F.col("last_channel")),
            "ref_type": F.when(F.col("level") == "campaign_type", F.col("segment")).otherwise(F.col("last_type")),
        }
    )
    df = df.join(side("overall", "all", None), [*keys, "date"], "left")
    df = df.join(side("channel", "channel", "ref_channel"), [*keys, "date", "ref_channel"], "left")
    return df.join(side("campaign_type", "type", "ref_type"), [*keys, "date", "ref_type"], "left")


def with_codes(df: DataFrame, channel_codes: DataFrame, type_codes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Category codes of the reference channel and type; unseen values are 0."""
    for codes, column, name in ((channel_codes, "ref_channel", "channel_code"), (type_codes, "ref_type", "campaign_type_code")):
        side = codes.select(*[k for k in keys if k in codes.columns], F.col("value").alias(column), F.col("code").alias(name))
        on = [*[k for k in keys if k in codes.columns], column]
        df = df.join(side, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("double"))
    return df


def segment_features(
    fact: DataFrame,
    channel_codes: DataFrame,
    type_codes: DataFrame,
    keys: Sequence[str] = (),
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """The feature vector at every (segment, day, horizon), from rows up to that day only."""
    base = with_codes(with_references(asof_base(segment_series(fact, keys), keys), keys), channel_codes, type_codes, keys)
    df = base.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return feature_columns(df)


def feature_columns(df: DataFrame) -> DataFrame:
    h, n = F.col("horizon_days"), F.col("n")

    def days(w: int) -> Column:
        return F.least(n, F.lit(w))

    def ratio(num: str, den: str) -> Column:
        return safe_ratio(num, den)

    def momentum(c: str, w: int) -> Column:
        base = F.col(f"{c}_56") / days(56)
        return safe_ratio(F.col(f"{c}_{w}") / days(w) - base, base)

    def stability(a: Column, b: Column) -> Column:
        return 1.0 - F.least(F.abs(a - b) / F.greatest(F.abs(b), F.lit(0.001)), F.lit(1.0))

    df = df.withColumns(
        {
            "_d7": F.col("spend_7") / days(7),
            "_d28": F.col("spend_28") / days(28),
            **{f"_roas_{w}": ratio(f"revenue_{w}", f"spend_{w}") for w in (7, 14, 28, 56)},
            **{f"_cr_{w}": ratio(f"conversions_{w}", f"clicks_{w}") for w in (14, 28, 56)},
            **{f"_ctr_{w}": ratio(f"clicks_{w}", f"impressions_{w}") for w in (14, 28, 56)},
            "_channel_roas": ratio("channel_revenue_56", "channel_spend_56"),
            "_type_roas": ratio("type_revenue_56", "type_spend_56"),
            "_end": F.date_add("date", h),
            "_index": (n + h).cast("double"),
            "_trend": clamp(F.col("revenue_trend_28"), -0.25, 0.25),
        }
    )
    end, idx, turn = F.col("_end"), F.col("_index"), 2 * math.pi
    run_spend = F.col("_d28") * h
    lift = clamp(F.col("_trend") * TREND_WEIGHT * F.least(h / 90.0, F.lit(1.0)) + 1.0, 0.65, 1.35)
    df = df.withColumn("_expected", F.greatest(F.col("revenue_28") / days(28) * h * lift, F.lit(0.0)))
    year = F.sin(F.dayofyear(end) * turn / 365.25)
    share = ratio("spend_28", "all_spend_28")
    values = {
        "horizon": h.cast("double"),
        "history_days": n.cast("double"),
        **{f"recent_spend_{w}": F.col(f"spend_{w}") for w in (7, 28, 56)},
        "projected_spend_horizon": F.col("_d7") * h,
        "planned_spend_delta_7_28": safe_ratio(F.col("_d7") - F.col("_d28"), "_d28"),
        "planned_spend_delta_28_horizon": safe_ratio(F.col("_d7") * h - run_spend, run_spend),
        **{f"recent_revenue_{w}": F.col(f"revenue_{w}") for w in (7, 14, 28, 56)},
        **{f"recent_roas_{w}": F.col(f"_roas_{w}") for w in (7, 14, 28, 56)},
        **{f"rps_{w}": F.col(f"_roas_{w}") for w in (7, 14, 28)},
        "rps_trend_7_28": safe_ratio(F.col("_roas_7") - F.col("_roas_28"), "_roas_28"),
        "baseline_revenue_forecast": clean_number("_expected"),
        "baseline_roas_forecast": clean_number(F.when(run_spend > 1e-9, safe_ratio("_expected", run_spend)).otherwise(0.0)),
        **{f"recent_{c}_28": F.col(f"{c}_28") for c in ("clicks", "impressions", "conversions")},
        "ctr_28": F.col("_ctr_28"),
        "conversion_rate_28": F.col("_cr_28"),
        "cpc_28": ratio("spend_28", "clicks_28"),
        "revenue_per_conversion_28": ratio("revenue_28", "conversions_28"),
        **{f"revenue_momentum_{w}_56": momentum("revenue", w) for w in (14, 28)},
        **{f"roas_momentum_{w}_56": safe_ratio(F.col(f"_roas_{w}") - F.col("_roas_56"), "_roas_56") for w in (14, 28)},
        "conversion_rate_14": F.col("_cr_14"),
        "conversion_rate_56": F.col("_cr_56"),
        "conversion_rate_stability_14_56": stability(F.col("_cr_14"), F.col("_cr_56")),
        "ctr_stability_14_56": stability(F.col("_ctr_14"), F.col("_ctr_56")),
        "dow_end": F.weekday(end).cast("double"),
        "month_end": F.month(end).cast("double"),
        **{f"{f.__name__}_{p}": f(idx * turn / p) for p in (7, 30, 365) for f in (F.sin, F.cos)},
        "sin_year_end": year,
        "cos_year_end": F.cos(F.dayofyear(end) * turn / 365.25),
        "quarter_end": F.quarter(end).cast("double"),
        "dow_channel_interaction": F.weekday(end) * F.col("channel_code"),
        "dow_campaign_type_interaction": F.weekday(end) * F.col("campaign_type_code"),
        "month_channel_interaction": F.month(end) * F.col("channel_code"),
        "month_campaign_type_interaction": F.month(end) * F.col("campaign_type_code"),
        "sin_year_x_channel_code": year * F.col("channel_code"),
        "spend_share_28": share,
        "spend_share_drift_28_56": share - ratio("spend_56", "all_spend_56"),
        "channel_roas_56": F.col("_channel_roas"),
        "campaign_type_roas_56": F.col("_type_roas"),
        "segment_vs_channel_roas_56": safe_ratio(F.col("_roas_56") - F.col("_channel_roas"), "_channel_roas"),
        "segment_vs_campaign_type_roas_56": safe_ratio(F.col("_roas_56") - F.col("_type_roas"), "_type_roas"),
        "campaign_spend_share_of_channel_28": ratio("spend_28", "channel_spend_28"),
        "spend_x_sin7": F.col("_d28") * F.sin(idx * turn / 7),
        "level_code": F.coalesce(*[F.when(F.col("level") == k, v) for k, v in LEVEL_CODES.items()]),
    }
    out = df.withColumns(values)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def last_features(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The vectors at each segment's latest day."""
    latest = F.max("date").over(Window.partitionBy(*keys, *SEGMENT))
    return features.withColumn("_last", latest).filter(F.col("date") == F.col("_last")).drop("_last")


def training_set(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling samples: every step-th cut with a full future window, and its targets.

    Targets look ahead, features look back; both are windows over the same sort.
    """
    parts = []
    for h in HORIZONS:
        one = features.filter(F.col("horizon_days") == h)
        by = [*keys, *SEGMENT]
        order = Window.partitionBy(*by).orderBy("date")
        ahead = order.rowsBetween(1, h)
        least = max(6, min(10, h // 3))
        step = max(7, h // 3)
        rows = one.withColumns(
            {
                "_ahead": F.count("*").over(ahead),
                "future_revenue": F.sum("revenue").over(ahead),
                "future_spend": F.sum("spend").over(ahead),
                "target_end": F.max("date").over(ahead),
                "_total": F.count("*").over(Window.partitionBy(*by)),
            }
        )
        keep = (F.col("_ahead") == h) & (F.col("n") >= least) & ((F.col("n") - least) % step == 0) & (F.col("_total") >= 35)
        parts.append(rows.filter(keep).drop("_ahead", "_total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns(
        {
            "revenue_target": F.log1p(F.greatest("future_revenue", F.lit(0.0)))
            - F.log1p(F.greatest("baseline_revenue_forecast", F.lit(0.0))),
            "roas_target": F.greatest(safe_ratio("future_revenue", "future_spend"), F.lit(0.0)),
        }
    )
