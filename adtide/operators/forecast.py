"""Run-rate planning ranges: baseline, intervals, rounding and strict widening over the horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import (
    clamp,
    clean_number,
    confidence_label,
    lookup,
    non_negative,
    safe_ratio,
    spend_response,
)
from adtide.operators.rollup import segment_daily
from adtide.operators.windows import SEGMENT, dow_seasonality, half_trend, one_step_residuals, trailing
from adtide.schema import (
    HORIZON_Z,
    HORIZONS,
    INTERVAL_FLOOR_PCT,
    OUTPUT_COLUMNS,
    SAFE_BASELINE,
    STRICT_GAP_PP,
    TREND_WEIGHT,
)

POINTS = ["expected_revenue", "lower_revenue", "upper_revenue", "expected_roas", "lower_roas", "upper_roas"]


def horizon_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))


def segment_state(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per segment: history length, last-28 run rates, half means and residual deviations.

    The windows and the aggregation share one partitioning, so the series is shuffled once.
    """
    by = [*keys, *SEGMENT]
    spec = Window.partitionBy(*by)
    numbered = one_step_residuals(daily, by).withColumns(
        {"_rn": F.row_number().over(spec.orderBy(F.col("date").desc())), "_n": F.count("*").over(spec)}
    )
    span = F.least(F.col("_n"), F.lit(28))
    mid = F.greatest(F.floor(span / 2), F.lit(1))
    recent = F.col("_rn") <= span
    early, late = recent & (F.col("_rn") > span - mid), F.col("_rn") <= span - mid

    def mean(cond: Column, column: str) -> Column:
        return F.coalesce(F.avg(F.when(cond, F.col(column))), F.lit(0.0))

    return numbered.groupBy(*by).agg(
        F.max("_n").alias("history_days"),
        F.max("date").alias("last_date"),
        F.sum(F.when(recent, F.col("revenue")).otherwise(0.0)).alias("revenue_28"),
        F.sum(F.when(recent, F.col("spend")).otherwise(0.0)).alias("spend_28"),
        mean(early, "revenue").alias("_first"),
        mean(late, "revenue").alias("_second"),
        F.coalesce(
            F.when(F.max("_n") >= 3, F.coalesce(F.stddev_samp("revenue_residual"), F.stddev_samp("revenue")))
            .otherwise(F.stddev_pop("revenue")),
            F.lit(0.0),
        ).alias("revenue_sd"),
        F.count("roas_residual").alias("roas_residuals"),
        F.coalesce(F.stddev_samp("roas_residual"), F.lit(0.0)).alias("roas_sd"),
    ).withColumn("trend", trend_of(F.col("_first"), F.col("_second"))).drop("_first", "_second")


def trend_of(first: Column, second: Column) -> Column:
    change = clamp(F.try_divide(second - first, first), -0.25, 0.25)
    return F.when((F.col("history_days") < 4) | (first <= 0), 0.0).otherwise(change)


def asof_state(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The state of ``segment_state`` at every row, from rows up to it only.

    Deviations use growing frames, which Spark updates row by row. ``next_date`` is the following observed day.
    """
    by = [*keys, *SEGMENT]
    order = Window.partitionBy(*by).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = one_step_residuals(daily, by).withColumn("_rn", F.row_number().over(order))
    df = df.withColumn("trend", half_trend(by, "revenue", 28, -0.25, 0.25))
    sd = F.when(
        F.col("_rn") >= 3, F.coalesce(F.stddev_samp("revenue_residual").over(upto), F.stddev_samp("revenue").over(upto))
    ).otherwise(F.stddev_pop("revenue").over(upto))
    return df.select(
        *by,
        F.col("date").alias("last_date"),
        F.lead("date").over(order).alias("next_date"),
        F.col("_rn").alias("history_days"),
        F.sum("revenue").over(trailing(by, 28)).alias("revenue_28"),
        F.sum("spend").over(trailing(by, 28)).alias("spend_28"),
        F.coalesce(sd, F.lit(0.0)).alias("revenue_sd"),
        F.count("roas_residual").over(upto).alias("roas_residuals"),
        F.coalesce(F.stddev_samp("roas_residual").over(upto), F.lit(0.0)).alias("roas_sd"),
        "trend",
    )


def planned_spend(fact: DataFrame, budgets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per segment: 30-day planned spend from channel budgets, run-rate for channels without one.

    ``budgets`` holds (keys, channel, budget) with one row per channel.
    """
    cells = fact.groupBy(*keys, "date", "channel", "campaign_type", "campaign_name").agg(F.sum("spend").alias("spend"))
    dims = ["campaign_type", "campaign_name"]
    sets = [[*keys, "date", "channel"], *[[*keys, "date", "channel", d] for d in dims]]
    daily = cells.groupingSets(sets, *keys, "date", "channel", *dims).agg(
        F.grouping_id().alias("gid"), F.sum("spend").alias("spend")
    )
    # The channel rows serve both the overall segment and the channel's own segment.
    levels = F.when(F.col("gid") == 3, F.array(F.lit("overall"), F.lit("channel"))).when(
        F.col("gid") == 1, F.array(F.lit("campaign_type"))
    ).otherwise(F.array(F.lit("campaign")))
    rows = daily.select(
        *keys, F.explode(levels).alias("level"), "date", "channel", "campaign_type", "campaign_name", "spend"
    ).withColumn(
        "segment",
        F.when(F.col("level") == "overall", "all")
        .when(F.col("level") == "channel", F.col("channel"))
        .otherwise(F.coalesce("campaign_type", "campaign_name")),
    )
    by = [*keys, *SEGMENT, "channel"]
    rate = (
        rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc())))
        .filter(F.col("_rn") <= 7)
        .groupBy(*by)
        .agg((F.sum("spend") / F.count("*")).alias("daily_spend"))
        .withColumn("_ch", F.lower(F.trim("channel")))
    )
    plan = budgets.select(
        *keys, F.lower(F.trim("channel")).alias("_ch"), non_negative("budget").alias("budget")
    ).filter(F.col("_ch") != "")
    joined = rate.join(plan, [*keys, "_ch"], "left")
    return joined.groupBy(*keys, *SEGMENT).agg(
        F.sum(F.when(F.col("budget").isNull(), F.col("daily_spend")).otherwise(F.col("budget") / 30.0)).alias(
            "planned_daily_spend"
        ),
        F.max(F.col("budget").isNotNull()).alias("has_budget"),
    )


def baseline_points(state: DataFrame, planned: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Unrounded baseline centre and bounds per segment and horizon."""
    df = state
    if planned is not None:
        df = df.join(planned, [*keys, *SEGMENT], "left")
    if "horizon_days" not in df.columns:
        df = horizon_rows(df)
    h = F.col("horizon_days")
    days = F.least(F.col("history_days"), F.lit(28))
    df = df.withColumns(
        {
            "historical_spend": F.col("spend_28") / days * h,
            "trend_multiplier": clamp(F.col("trend") * TREND_WEIGHT * F.least(h / 90.0, F.lit(1.0)) + 1.0, 0.65, 1.35),
            "run_rate_revenue": F.col("revenue_28") / days * h,
        }
    )
    if planned is None:
        df = df.withColumn("expected_spend", F.col("historical_spend")).withColumn("response", F.lit(1.0))
    else:
        spend = F.when(F.coalesce("has_budget", F.lit(False)), F.col("planned_daily_spend") * h).otherwise(
            F.col("historical_spend")
        )
        df = df.withColumn("expected_spend", F.greatest(spend, F.lit(0.0)))
        scale = F.when(F.col("historical_spend") > 0, safe_ratio("expected_spend", "historical_spend")).otherwise(1.0)
        df = df.withColumn("response", spend_response(scale))
    z, floor = lookup(h, HORIZON_Z), lookup(h, INTERVAL_FLOOR_PCT)
    expected = F.greatest(F.col("run_rate_revenue") * F.col("trend_multiplier") * F.col("response"), F.lit(0.0))
    df = df.withColumn("expected_revenue", expected)
    half = F.greatest(z * F.col("revenue_sd") * F.sqrt(h.cast("double")), F.col("expected_revenue") * floor)
    df = df.withColumns(
        {
            "interval": half,
            "lower_revenue": F.greatest(F.col("expected_revenue") - half, F.lit(0.0)),
            "upper_revenue": F.col("expected_revenue") + half,
        }
    )
    return roas_interval(df, safe_ratio("expected_revenue", "expected_spend"))


def roas_interval(df: DataFrame, centre: Column) -> DataFrame:
    """ROAS bounds from ROAS residuals; all 0 where there is no spend basis."""
    h = F.col("horizon_days")
    floor = clamp(lookup(h, INTERVAL_FLOOR_PCT) * 0.45, 0.035, 0.30)
    df = df.withColumn("_centre", F.greatest(centre, F.lit(0.0)))
    stat = F.when(F.col("roas_residuals") >= 3, lookup(h, HORIZON_Z) * F.col("roas_sd") * F.sqrt(h / 30.0)).otherwise(0.0)
    margin = F.greatest(stat, F.col("_centre") * floor, F.when(F.col("_centre") > 0, 0.02).otherwise(0.0))
    paid = F.col("expected_spend") > 1e-9

    def held(value: Column) -> Column:
        return F.when(paid, value).otherwise(0.0)

    return df.withColumns(
        {
            "expected_roas": held(F.col("_centre")),
            "lower_roas": held(F.greatest(F.col("_centre") - margin, F.lit(0.0))),
            "upper_roas": held(F.col("_centre") + margin),
        }
    ).drop("_centre")


def roas_from_revenue_bounds(df: DataFrame) -> DataFrame:
    """ROAS bounds as revenue bounds over spend, kept in order."""
    paid = F.col("expected_spend") > 1e-9
    low = F.greatest(safe_ratio("lower_revenue", "expected_spend"), F.lit(0.0))
    mid = F.greatest(low, safe_ratio("expected_revenue", "expected_spend"))
    high = F.greatest(mid, safe_ratio("upper_revenue", "expected_spend"))
    return df.withColumns(
        {
            "lower_roas": F.when(paid, low).otherwise(0.0),
            "expected_roas": F.when(paid, mid).otherwise(0.0),
            "upper_roas": F.when(paid, high).otherwise(0.0),
        }
    )


def sanitize_monotone(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Round, repair ROAS order, and widen revenue bands by at least two points per horizon step.

    The three horizons of a segment become columns of one row, are repaired in order, and become rows again.
    """
    by = [*keys, *SEGMENT]
    fields = [*POINTS, "model_type"]
    wide = rows.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("horizon_days") == h, F.struct(*fields))).alias(f"h{h}")
            for h in HORIZONS
        ]
    )
    wide = wide.withColumn("width", F.lit(0.0))
    for h in HORIZONS:
        r = F.col(f"h{h}")
        wide = wide.withColumns({f"{p}_{h}": clean_number(r[p]) for p in POINTS})
        e, lo, up = (F.col(f"{p}_revenue_{h}") for p in ("expected", "lower", "upper"))
        target = F.col("width") + F.when(F.col("width") > 0, STRICT_GAP_PP).otherwise(0.0)
        wide = wide.withColumns(
            {
                f"pct_{h}": safe_ratio(up - lo, e) * 100.0,
                f"need_{h}": target / 100.0 * e,
                f"widen_{h}": (e > 0) & (safe_ratio(up - lo, e) * 100.0 < target),
                f"mid_{h}": (up + lo) / 2.0,
            }
        )
        need, mid = F.col(f"need_{h}"), F.col(f"mid_{h}")
        wide = wide.withColumns(
            {
                f"nlo_{h}": F.least(F.greatest(mid - need / 2.0, F.lit(0.0)), e),
                f"nup_{h}": F.greatest(mid + need / 2.0, e),
            }
        )
        nlo, nup = F.col(f"nlo_{h}"), F.col(f"nup_{h}")
        wide = wide.withColumn(f"nup_{h}", F.when(nup - nlo < need, nlo + need).otherwise(nup))
        actual = (
            F.when(F.col(f"widen_{h}"), safe_ratio(nup - nlo, e) * 100.0)
            .when(e > 0, F.col(f"pct_{h}"))
            .otherwise(0.0)
        )
        wide = wide.withColumn(f"actual_{h}", F.when(r.isNull(), 0.0).otherwise(actual))
        wide = wide.withColumn("width", F.greatest(F.col("width"), F.col(f"actual_{h}")))

    def out(h: int) -> Column:
        roas = F.col(f"expected_roas_{h}")
        low, high = F.least(F.col(f"lower_roas_{h}"), roas), F.greatest(F.col(f"upper_roas_{h}"), roas)
        width = clean_number(F.col(f"actual_{h}"))
        return F.struct(
            F.lit(h).alias("horizon_days"),
            F.col(f"expected_revenue_{h}").alias("expected_revenue"),
            F.when(F.col(f"widen_{h}"), clean_number(F.col(f"nlo_{h}")))
            .otherwise(F.col(f"lower_revenue_{h}")).alias("lower_revenue"),
            F.when(F.col(f"widen_{h}"), clean_number(F.col(f"nup_{h}")))
            .otherwise(F.col(f"upper_revenue_{h}")).alias("upper_revenue"),
            roas.alias("expected_roas"),
            low.alias("lower_roas"),
            high.alias("upper_roas"),
            F.coalesce(F.col(f"h{h}.model_type"), F.lit(SAFE_BASELINE)).alias("model_type"),
            width.alias("interval_width_pct"),
            confidence_label(width, F.col(f"expected_revenue_{h}"), roas, low, high).alias("forecast_confidence"),
        )

    present = F.filter(
        F.array(*[F.when(F.col(f"h{h}").isNotNull(), out(h)) for h in HORIZONS]), lambda s: s.isNotNull()
    )
    return wide.select(*by, F.inline(present)).select(*keys, *OUTPUT_COLUMNS)


def baseline_forecast(
    fact: DataFrame, keys: Sequence[str] = (), budgets: DataFrame | None = None
) -> DataFrame:
    """All segments x 30/60/90 days on the run-rate path, in the output contract."""
    state = segment_state(segment_daily(fact, keys), keys)
    planned = planned_spend(fact, budgets, keys) if budgets is not None else None
    points = baseline_points(state, planned, keys).withColumn("model_type", F.lit(SAFE_BASELINE))
    rounded = points.withColumns({p: clean_number(p) for p in POINTS})
    return sanitize_monotone(rounded, keys)


def projection_state(daily: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean and deviation of the last 30 rows and the daily trend against the 30 before."""
    spec = Window.partitionBy(*by)
    numbered = daily.withColumn("_rn", F.row_number().over(spec.orderBy(F.col("date").desc())))
    recent, prior = F.col("_rn") <= 30, (F.col("_rn") > 30) & (F.col("_rn") <= 60)
    value = F.col(column)
    agg = numbered.groupBy(*by).agg(
        F.max("date").alias("last_date"),
        F.avg(F.when(recent, value)).alias("recent_mean"),
        F.avg(value).alias("all_mean"),
        F.avg(F.when(prior, value)).alias("prior_mean"),
        F.count(F.when(recent, 1)).alias("n_recent"),
        F.stddev_samp(F.when(recent, value)).alias("recent_sd"),
    )
    start = F.when(F.col("recent_mean") != 0, F.col("recent_mean")).otherwise(F.col("all_mean"))
    prior_mean = F.coalesce("prior_mean", F.col("start"))
    rel = F.when(prior_mean > 0, F.try_divide(F.col("start") - prior_mean, prior_mean)).otherwise(0.0)
    sd = F.when(F.col("n_recent") < 2, F.abs("recent_mean") * 0.1).otherwise(F.col("recent_sd"))
    return agg.withColumn("start", start).withColumns(
        {"daily_trend": clamp(rel / F.col("n_recent"), -0.015, 0.015), "recent_sd": sd}
    )


def trend_points(state: DataFrame, horizon: int) -> DataFrame:
    """Compounded daily projection as one row per future day, in closed form."""
    days = state.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("start") * F.pow(F.col("daily_trend") + 1.0, F.col("day").cast("double"))
    return days.withColumn("value", F.greatest(value, F.lit(0.0))).withColumn(
        "date", F.date_add("last_date", F.col("day").cast("int"))
    )


def trend_projection(daily: DataFrame, by: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Horizon sums of the revenue projection with margin max(12%, 1.96 sd sqrt h)."""
    points = trend_points(projection_state(daily, by, "revenue"), max(horizons))
    sized = points.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons]))).filter(
        F.col("day") <= F.col("horizon_days")
    )
    total = sized.groupBy(*by, "horizon_days").agg(
        F.sum("value").alias("projected"), F.max("recent_sd").alias("recent_sd")
    )
    margin = F.greatest(
        F.col("projected") * 0.12, F.col("recent_sd") * 1.96 * F.sqrt(F.col("horizon_days").cast("double"))
    )
    return total.withColumn("margin", margin).drop("recent_sd")


def flat_projection(daily: DataFrame, by: Sequence[str], horizon: int, column: str = "revenue") -> DataFrame:
    """Constant projection of the last 28 rows' mean with a slowly widening margin."""
    spec = Window.partitionBy(*by)
    recent = daily.withColumn("_rn", F.row_number().over(spec.orderBy(F.col("date").desc()))).filter(
        F.col("_rn") <= 28
    )
    state = recent.groupBy(*by).agg(
        F.max("date").alias("last_date"),
        F.avg(column).alias("mean"),
        F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"),
    )
    days = state.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    margin = F.greatest(F.col("sd"), F.col("mean") * 0.08) * 1.96 * F.sqrt(F.col("day") / 30.0 + 1.0)
    return days.select(
        *by,
        F.date_add("last_date", F.col("day").cast("int")).alias("date"),
        F.greatest("mean", F.lit(0.0)).alias("value"),
        F.greatest(F.col("mean") - margin, F.lit(0.0)).alias("lower"),
        F.greatest(F.col("mean") + margin, F.lit(0.0)).alias("upper"),
    )


def project_exogenous(
    daily: DataFrame, by: Sequence[str], horizon: int, forced_daily_spend: Column | None = None
) -> DataFrame:
    """Future spend, clicks, impressions and conversions: recent means times the weekday factor of spend."""
    measures = ["spend", "clicks", "impressions", "conversions"]
    profile = dow_seasonality(daily, by, measures).select(*by, "weekday", "spend_factor", *[f"{m}_mean" for m in measures])
    last = daily.groupBy(*by).agg(F.max("date").alias("last_date"))
    days = last.select(
        *by, F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon))).alias("date")
    ).withColumn("weekday", F.weekday("date"))
    out = days.join(profile, [*by, "weekday"]).withColumns(
        {m: F.greatest(F.col(f"{m}_mean") * F.col("spend_factor"), F.lit(0.0)) for m in measures}
    )
    if forced_daily_spend is not None:
        base = F.when(F.col("spend") > 0, F.col("spend")).otherwise(F.col("spend_mean"))
        out = out.withColumn("_ratio", F.when(base > 0, safe_ratio(forced_daily_spend, base)).otherwise(1.0))
        out = out.withColumns({m: F.col(m) * F.col("_ratio") for m in measures[1:]}).withColumn(
            "spend", F.greatest(forced_daily_spend, F.lit(0.0))
        )
    return out.select(*by, "date", *measures)


def prediction_cap(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Upper limits of daily revenue and ROAS predictions from the last 28 rows."""
    recent = daily.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc()))
    ).filter(F.col("_rn") <= 28)
    agg = recent.groupBy(*by).agg(
        *[F.greatest(F.avg(c), F.lit(0.0)).alias(f"{c}_mean") for c in ("revenue", "roas")],
        *[
            F.when(F.count("*") > 1, F.stddev_samp(c)).otherwise(F.avg(c) * 0.2).alias(f"{c}_sd")
            for c in ("revenue", "roas")
        ],
    )

    def cap(c: str, lift: float) -> Column:
        return F.greatest(F.col(f"{c}_mean") * lift, F.col(f"{c}_mean") + F.col(f"{c}_sd"), F.lit(1.0))

    return agg.select(*by, cap("revenue", 1.08).alias("revenue_cap"), cap("roas", 1.15).alias("roas_cap"))


def fit_metrics(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and 1.96-sd coverage of the one-step run-rate prediction."""
    rows = one_step_residuals(daily, by).filter(F.col("revenue_residual").isNotNull())
    error = F.col("revenue_residual")
    sd = F.stddev_samp("revenue_residual").over(Window.partitionBy(*by))
    rows = rows.withColumn("_in", (F.abs("revenue_residual") <= sd * 1.96).cast("double"))
    return rows.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error) / F.greatest(F.abs("revenue"), F.lit(1.0))) * 100.0).alias("mape"),
        F.when(F.var_pop("revenue") > 0, 1.0 - F.try_divide(F.avg(error * error), F.var_pop("revenue"))).otherwise(0.0).alias("r2"),
        (F.avg("_in") * 100.0).alias("coverage"),
    )


def forecast_signals(daily: DataFrame, predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per forecast row: recent trends, ROAS stability, the end of the horizon and reason flags."""
    by = [*keys, *SEGMENT]
    spec = Window.partitionBy(*by)
    rows = daily.withColumns(
        {"_rn": F.row_number().over(spec.orderBy(F.col("date").desc())), "_n": F.count("*").over(spec)}
    )
    span = F.least(F.col("_n"), F.lit(28))
    mid = F.greatest(F.floor(span / 2), F.lit(1))
    recent = F.col("_rn") <= span

    def mean(cond: Column, c: str) -> Column:
        return F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))

    paid = recent & (F.col("spend") > 0)
    state = rows.groupBy(*by).agg(
        F.max("_n").alias("history_days"),
        F.max("date").alias("last_date"),
        *[mean(recent & (F.col("_rn") > span - mid), c).alias(f"_a_{c}") for c in ("revenue", "spend")],
        *[mean(F.col("_rn") <= span - mid, c).alias(f"_b_{c}") for c in ("revenue", "spend")],
        F.avg(F.when(paid, F.col("roas"))).alias("roas_mean"),
        F.stddev_pop(F.when(paid, F.col("roas"))).alias("_roas_sd"),
    )

    def change(c: str) -> Column:
        first, second = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        value = clamp(F.try_divide(second - first, first), -0.9, 2.0)
        return F.when((F.col("history_days") < 4) | (first <= 0), 0.0).otherwise(value) * 100.0

    out = predictions.join(state, by)
    end = F.date_add("last_date", F.col("horizon_days"))
    n, width = F.col("history_days"), F.col("interval_width_pct")
    flags = F.array_compact(
        F.array(
            F.when(F.col("model_type") == "trained_model_estimated_spend", "spend_inferred"),
            F.when(F.col("model_type") == SAFE_BASELINE, "baseline_model"),
            F.when(n < 30, "short_history").when(n >= 90, "long_history").otherwise("moderate_history"),
            F.when(F.col("horizon_days") >= 90, "horizon_90").when(F.col("horizon_days") >= 60, "horizon_60"),
            F.when(width >= 90, "wide_interval").when(width <= 70, "tight_interval").otherwise("moderate_interval"),
        )
    )
    return out.select(
        *by,
        "horizon_days",
        n.alias("history_days"),
        change("revenue").alias("revenue_trend_pct"),
        change("spend").alias("spend_trend_pct"),
        "roas_mean",
        (safe_ratio("_roas_sd", "roas_mean") * 100.0).alias("roas_cv_pct"),
        F.month(end).alias("end_month"),
        F.weekday(end).alias("end_weekday"),
        flags.alias("reasons"),
    )


def history_plus_forecast(daily: DataFrame, points: DataFrame, by: Sequence[str], history: int = 60) -> DataFrame:
    """Last ``history`` rows, then the forecast points re-dated from the last of them."""
    ranked = daily.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc())))
    past = ranked.filter(F.col("_rn") <= history)
    last = past.groupBy(*by).agg(F.max("date").alias("_last"))
    value = F.col("revenue")
    is_last = F.col("_rn") == 1
    old = past.select(
        *by, "date", value.alias("historical"), *[F.when(is_last, value).alias(c) for c in ("forecast", "lower", "upper")]
    )
    k = F.row_number().over(Window.partitionBy(*by).orderBy("date"))
    new = points.withColumn("_k", k).join(last, list(by)).select(
        *by,
        F.date_add("_last", F.col("_k")).alias("date"),
        F.lit(None).cast("double").alias("historical"),
        F.col("value").alias("forecast"),
        "lower",
        "upper",
    )
    return old.unionByName(new)


def daily_trend_across(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast points summed over the channels of a day."""
    return points.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in ("value", "lower", "upper")])


def historical_vs_forecast(daily: DataFrame, predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last h observed rows against the forecast of the same length, per segment and horizon."""
    by = [*keys, *SEGMENT]
    ranked = daily.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc())))
    recent = horizon_rows(ranked.filter(F.col("_rn") <= max(HORIZONS))).filter(F.col("_rn") <= F.col("horizon_days"))
    past = recent.groupBy(*by, "horizon_days").agg(
        F.sum("revenue").alias("historical_revenue"), safe_ratio(F.sum("revenue"), F.sum("spend")).alias("historical_roas")
    )
    joined = past.join(predictions.select(*by, "horizon_days", "expected_revenue", "expected_roas"), [*by, "horizon_days"], "full")
    change = safe_ratio(F.col("expected_revenue") - F.col("historical_revenue"), "historical_revenue") * 100.0
    return joined.withColumn("revenue_change_pct", change)
