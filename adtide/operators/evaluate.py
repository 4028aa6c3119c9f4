"""Walk-forward scoring, error metrics, paired comparison, selection and interval calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, lookup, round_to, safe_ratio
from adtide.functions.tables import attach
from adtide.operators.forecast import POINTS, asof_state, baseline_points
from adtide.operators.windows import SEGMENT
from adtide.schema import (
    ALT_INTERVAL_FLOOR_PCT,
    BOOTSTRAP_PAIRED_DRAWS,
    CONFORMAL_TARGET,
    HORIZONS,
    INTERVAL_FLOOR_PCT,
    SAFE_BASELINE,
    TRAINED,
)

# Cumulative Poisson(1) probabilities 0..6: a bootstrap weight is the number of them below the draw.
POISSON_1 = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def fold_list(last: Column, folds: int, offset: int = 0) -> Column:
    """All (horizon, fold, start, end) windows that end ``offset`` days before the last date."""
    return F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_days"),
                F.lit(k + 1).alias("fold"),
                F.date_sub(last, h * (k + 1) - 1 + offset).alias("start"),
                F.date_sub(last, h * k + offset).alias("end"),
            )
            for h in HORIZONS
            for k in range(folds)
        ]
    )


def fold_states(daily: DataFrame, keys: Sequence[str] = (), folds: int = 4, offset: int = 0) -> DataFrame:
    """As-of state of every segment at the start of every fold, from earlier rows only.

    Each row knows its next observed day, so it picks the folds that start in between: no history is copied
    per fold.
    """
    last = daily.groupBy(*keys).agg(F.max("date").alias("_last"))
    state = attach(asof_state(daily, keys), last, keys)
    mine = F.filter(
        fold_list(F.col("_last"), folds, offset),
        lambda f: (f["start"] > F.col("last_date")) & (F.col("next_date").isNull() | (f["start"] <= F.col("next_date"))),
    )
    return state.withColumn("_f", F.explode(mine)).select("*", "_f.*").drop("_f", "_last", "next_date")


def fold_actuals(daily: DataFrame, keys: Sequence[str] = (), folds: int = 4, offset: int = 0) -> DataFrame:
    last = daily.groupBy(*keys).agg(F.max("date").alias("_last"))
    rows = attach(daily, last, keys)
    mine = F.filter(
        fold_list(F.col("_last"), folds, offset), lambda f: (f["start"] <= F.col("date")) & (f["end"] >= F.col("date"))
    )
    hit = rows.withColumn("_f", F.explode(mine))
    return hit.groupBy(*keys, *SEGMENT, F.col("_f.horizon_days").alias("horizon_days"), F.col("_f.fold").alias("fold")).agg(
        F.sum("revenue").alias("actual_revenue"), safe_ratio(F.sum("revenue"), F.sum("spend")).alias("actual_roas")
    )


def walk_forward(daily: DataFrame, keys: Sequence[str] = (), folds: int = 4, offset: int = 0) -> DataFrame:
    """Safe-baseline forecasts at every fold start beside the fold's actuals; segments without actuals drop out."""
    states = fold_states(daily, keys, folds, offset)
    points = baseline_points(states, None, keys)
    scored = points.join(fold_actuals(daily, keys, folds, offset), [*keys, *SEGMENT, "horizon_days", "fold"])
    return scored.select(
        *keys,
        *SEGMENT,
        "horizon_days",
        "fold",
        "start",
        "actual_revenue",
        "actual_roas",
        *[F.col(p).alias(f"safe_{p}") for p in POINTS],
        F.col("run_rate_revenue").alias("_run_rate"),
    )


def with_challenger(scored: DataFrame, revenue: Column, floors: dict[int, float]) -> DataFrame:
    """Adds ``trained_*`` columns from a challenger's revenue with a floor-only interval."""
    half = revenue * lookup(F.col("horizon_days"), floors)
    return scored.withColumns(
        {
            "trained_expected_revenue": revenue,
            "trained_lower_revenue": F.greatest(revenue - half, F.lit(0.0)),
            "trained_upper_revenue": revenue + half,
            **{f"trained_{b}_roas": F.col(f"safe_{b}_roas") for b in ("expected", "lower", "upper")},
        }
    )


def long_scores(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per scored forecast, model and target."""
    parts = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("model"),
                    F.lit(t).alias("target"),
                    F.col(f"actual_{t}").alias("actual"),
                    *[F.col(f"{m}_{b}_{t}").alias(n) for b, n in (("expected", "predicted"), ("lower", "lower"), ("upper", "upper"))],
                )
                for m in ("trained", "safe")
                for t in ("revenue", "roas")
            ]
        )
    )
    return scored.select(*keys, *SEGMENT, "horizon_days", "fold", parts)


def error_metrics(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE, MAPE, coverage and interval width of long score rows."""
    e = F.col("actual") - F.col("predicted")
    width = F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0))
    inside = (F.col("lower") <= F.col("actual")) & (F.col("actual") <= F.col("upper"))
    return long.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs("actual"), F.lit(1.0))) * 100.0).alias("mape"),
        (F.avg(inside.cast("double")) * 100.0).alias("coverage"),
        F.avg(width).alias("width"),
        (F.avg(width / F.greatest(F.abs("predicted"), F.lit(1.0))) * 100.0).alias("width_pct"),
    )


METRICS = ["mae", "rmse", "mape", "coverage", "width", "width_pct"]


def fold_average(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of the fold metrics."""
    per_fold = error_metrics(long, [*keys, "horizon_days", "fold", "model", "target"])
    return per_fold.groupBy(*keys, "horizon_days", "model", "target").agg(
        F.count("*").alias("folds"), *[F.avg(m).alias(m) for m in METRICS]
    )


def paired_bootstrap(
    scored: DataFrame, keys: Sequence[str] = (), target: str = "revenue", draws: int = BOOTSTRAP_PAIRED_DRAWS
) -> DataFrame:
    """Resampled mean of trained minus safe absolute error per horizon: interval, p-value and verdict.

    Rows get Poisson(1) weights from a hash of the row and the draw, so a group of any size is resampled where
    its rows are, and only one sum per draw is shuffled.
    """
    by = [*keys, "horizon_days"]
    delta = F.abs(F.col(f"actual_{target}") - F.col(f"trained_expected_{target}")) - F.abs(
        F.col(f"actual_{target}") - F.col(f"safe_expected_{target}")
    )
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "level", "segment", F.col("fold").cast("string"))
    rows = scored.select(
        *by, delta.alias("delta"), F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint").alias("pos")
    )
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    m = F.lit(1000003)
    base = F.pmod(F.col("rep").cast("bigint") * 7919 + F.col("pos") * 104729 + 12345, m)
    drawn = drawn.withColumn("_b", base)
    drawn = drawn.withColumn("_u", F.pmod(F.col("_b") * F.col("_b") + F.col("_b") * 31 + 17, m) / 1000003.0)
    weight = sum(((F.col("_u") >= p).cast("int") for p in POISSON_1), F.lit(0))
    drawn = drawn.withColumn("_w", weight)
    means = drawn.groupBy(*by, "rep").agg(
        safe_ratio(F.sum(F.col("_w") * F.col("delta")), F.sum("_w")).alias("mean")
    )
    boot = means.groupBy(*by).agg(
        F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
        F.avg((F.col("mean") <= 0).cast("double")).alias("_low"),
        F.avg((F.col("mean") >= 0).cast("double")).alias("_high"),
    )
    observed = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("delta").alias("observed"), F.stddev_pop("delta").alias("sd")
    )
    df = observed.join(boot, by)
    flat = (F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) <= 1e-12)
    df = df.withColumns(
        {
            "ci_low": F.when(flat, F.col("observed")).otherwise(F.col("ci")[0]),
            "ci_high": F.when(flat, F.col("observed")).otherwise(F.col("ci")[1]),
            "p_value": F.when(flat, F.when(F.abs("observed") <= 1e-12, 1.0).otherwise(0.0)).otherwise(
                F.least(F.least("_low", "_high") * 2.0, F.lit(1.0))
            ),
        }
    )
    verdict = F.when(F.col("ci_high") < 0, TRAINED).when(F.col("ci_low") > 0, SAFE_BASELINE).otherwise("statistical_tie")
    return df.select(*by, "n", "observed", "ci_low", "ci_high", "p_value", verdict.alias("verdict"))


def blend_sweep(scored: DataFrame, weights: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Revenue errors of each blend weight per horizon, with the best by (RMSE, MAE, MAPE)."""
    by = [*keys, "horizon_days"]
    rows = scored.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    mixed = F.col("trained_expected_revenue") * F.col("weight") + F.col("safe_expected_revenue") * (1.0 - F.col("weight"))
    e = F.col("actual_revenue") - mixed
    agg = rows.groupBy(*by, "weight").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs("actual_revenue"), F.lit(1.0))) * 100.0).alias("mape"),
    )
    rounded = agg.withColumns({c: round_to(c, 2) for c in ("mae", "rmse", "mape")})
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("rmse", "mae", "mape", "weight"))
    return rounded.withColumn("is_best", rank == 1)


def champion_challenger(metrics: DataFrame, paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Planning method and revenue weight per horizon from the paired evidence."""
    by = [*keys, "horizon_days"]
    mape = metrics.filter(F.col("target") == "revenue").groupBy(*by).agg(
        *[F.max(F.when(F.col("model") == m, F.col("mape"))).alias(f"{m}_mape") for m in ("trained", "safe")]
    )
    df = paired.join(mape, by)
    gap = F.abs(F.col("trained_mape") - F.col("safe_mape")) / F.greatest(F.col("safe_mape"), F.lit(0.01)) * 100.0
    clear = F.col("p_value") < 0.05
    few = F.col("n") < 12
    trained = clear & (F.col("ci_high") < 0) & (F.col("observed") < 0)
    safe = clear & (F.col("ci_low") > 0) & (F.col("observed") > 0)
    tie = (gap <= 3.0) | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    better = F.col("trained_mape") < F.col("safe_mape")
    method = F.when(few, "baseline").when(trained, "trained").when(safe, "baseline").when(tie | better, "blend").otherwise("baseline")
    weight = F.when(few, 0.0).when(trained, 0.60).when(safe, 0.0).when(tie, 0.25).when(better, 0.35).otherwise(0.0)
    return df.select(*by, "n", "trained_mape", "safe_mape", method.alias("selected_method"), weight.alias("revenue_weight"))


def winner_evidence(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE winner and the difference in percent per target."""
    wide = metrics.groupBy(*by, "target").agg(
        *[F.max(F.when(F.col("model") == m, F.col("mae"))).alias(f"{m}_mae") for m in ("trained", "safe")]
    )
    t, s = F.col("trained_mae"), F.col("safe_mae")
    tie = F.abs(t - s) <= F.greatest(F.greatest(F.abs(t), F.abs(s)) * 1e-9, F.lit(1e-9))
    return wide.withColumns(
        {
            "mae_difference_pct": F.when(s != 0, F.try_divide(t - s, s) * 100.0).otherwise(0.0),
            "winner": F.when(tie, "tie").when(t < s, TRAINED).otherwise(SAFE_BASELINE),
        }
    )


def conformal_scores(scored: DataFrame) -> DataFrame:
    expected = F.greatest(F.col("safe_expected_revenue"), F.lit(1.0))
    return scored.withColumn("score", F.abs(F.col("actual_revenue") - expected) / expected)


def values_at_ranks(df: DataFrame, by: Sequence[str], column: str, ranks: DataFrame) -> DataFrame:
    """(by, name, value): the value at each ``rank`` (from 1, in ascending order) of a group of any size.

    ``ranks`` has by, name and rank. Two passes: counts by narrow ranges of the value say which range holds the rank and how
    many values lie below, then only that range is counted value by value. No task sees more of a group than the counts.
    """
    # Grows with the value: 64 ranges for each doubling of its size, from 2^-20 on, on either side of 0.
    range_of = F.floor(F.signum(column) * F.log2(F.abs(F.col(column)) * float(1 << 20) + 1.0) * 64.0)
    rows = df.filter(F.col(column).isNotNull()).withColumn("_range", range_of)
    upto = lambda order, part: F.sum("_n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_upto", upto("_range", by))
    held = sizes.join(ranks, list(by)).filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_n") < F.col("rank")))
    held = held.select(*by, "_range", "name", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_left"))
    inside = rows.join(held.select(*by, "_range").distinct(), [*by, "_range"]).groupBy(*by, "_range", column).agg(F.count("*").alias("_n"))
    inside = inside.withColumn("_upto", upto(column, [*by, "_range"])).join(held, [*by, "_range"])
    return inside.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))).select(*by, "name", F.col(column).alias("value"))


def conformal_quantiles(scores: DataFrame, by: Sequence[str], target: float = CONFORMAL_TARGET) -> DataFrame:
    """Split-conformal quantile of the scores, the next higher observed value."""
    n = F.col("n")
    # alpha is 1 - target, as the level is defined on it.
    level = F.least(F.ceil((n + 1) * (1.0 - (1.0 - target))) / n, F.lit(1.0))
    sizes = scores.groupBy(*by).agg(F.count("*").alias("n")).withColumn("quantile_level", level)
    ranks = sizes.select(*by, F.lit("q").alias("name"), (F.ceil(F.col("quantile_level") * (n - 1)) + 1).alias("rank"))
    return sizes.join(values_at_ranks(scores, by, "score", ranks), list(by)).select(*by, "n", "quantile_level", F.col("value").alias("quantile"))


def interpolated_quantiles(df: DataFrame, by: Sequence[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, one column per quantile), linear between the two neighbouring values, by exact ranks."""
    sizes = df.groupBy(*by).agg(F.count(column).alias("n"))
    at = {name: (F.col("n") - 1) * q for name, q in quantiles.items()}
    wanted = F.inline(F.array(*[F.struct(F.lit(f"{name}{i}").alias("name"), (f(x) + 1).cast("long").alias("rank")) for name, x in at.items() for i, f in enumerate((F.floor, F.ceil))]))
    found = values_at_ranks(df, by, column, sizes.select(*by, "n", wanted).drop("n"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == f"{name}{i}", F.col("value"))).alias(f"_{name}{i}") for name in at for i in (0, 1)])
    low, high = (lambda name: F.col(f"_{name}0")), (lambda name: F.col(f"_{name}1"))
    return sizes.join(wide, list(by)).select(*by, "n", *[(low(k) + (high(k) - low(k)) * (x - F.floor(x))).alias(k) for k, x in at.items()])


def calibration(quantiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Floors that never shrink with the horizon, and the interval multipliers derived from them."""
    wide = quantiles.groupBy(*keys).agg(
        *[F.greatest(F.max(F.when(F.col("horizon_days") == h, F.col("quantile"))), F.lit(0.01)).alias(f"q{h}") for h in HORIZONS]
    )
    df = wide.withColumn("f30", F.col("q30"))
    df = df.withColumn("f60", F.greatest(F.col("q60"), F.col("f30") + 0.005))
    df = df.withColumn("f90", F.greatest(F.col("q90"), F.col("f60") + 0.005))

    def ratio(h: int) -> Column:
        return F.greatest(F.col(f"f{h}") / F.sqrt(F.lit(h / 30.0)) / F.greatest(F.col("f30"), F.lit(1e-9)), F.lit(1.0))

    df = df.withColumn("m30", F.lit(2.5))
    df = df.withColumn("m60", F.greatest(ratio(60), F.col("m30")))
    df = df.withColumn("m90", F.greatest(ratio(90), F.col("m60")))
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon_days"),
                    round_to(f"f{h}", 4).alias("floor_pct"),
                    round_to(f"m{h}", 4).alias("multiplier"),
                    round_to(F.col(f"m{h}") * 1.25, 4).alias("low_sample_multiplier"),
                )
                for h in HORIZONS
            ]
        )
    )
    return df.select(*keys, rows)


def interval_profiles(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage and width of the two floor profiles over the same scores."""
    h = F.col("horizon_days")
    profiles = F.inline(
        F.array(
            F.struct(F.lit("residual_conformal").alias("method"), lookup(h, INTERVAL_FLOOR_PCT).alias("floor")),
            F.struct(F.lit("cv_quantile_conformal").alias("method"), lookup(h, ALT_INTERVAL_FLOOR_PCT).alias("floor")),
        )
    )
    return scores.select(*keys, "horizon_days", "score", profiles).groupBy(*keys, "horizon_days", "method").agg(
        F.count("*").alias("n"),
        (F.avg((F.col("score") <= F.col("floor")).cast("double")) * 100.0).alias("coverage_pct"),
        (F.max("floor") * 200.0).alias("mean_width_pct"),
    )


def z_calibration(residuals: DataFrame, by: Sequence[str], column: str = "revenue_residual", fallback: float = 1.0) -> DataFrame:
    """72% quantile of standardised absolute residuals per group, held to [0.75, 1.65]; short groups fall back."""
    rows = residuals.filter(F.col(column).isNotNull())
    stats = rows.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_sd"), F.count("*").alias("n"))
    joined = rows.join(stats, list(by)).withColumn("_s", F.abs(F.try_divide(F.col(column) - F.col("_m"), F.col("_sd"))))
    agg = joined.groupBy(*by).agg(F.max("n").alias("n"), F.max("_sd").alias("_sd"), F.percentile("_s", F.lit(0.72)).alias("_q"))
    usable = (F.col("n") >= 8) & (F.coalesce("_sd", F.lit(0.0)) > 1e-9)
    return agg.select(*by, "n", F.when(usable, round_to(clamp("_q", 0.75, 1.65), 4)).otherwise(fallback).alias("z"))


def parent_channel_pool(fact_rows: DataFrame, residuals: DataFrame, keys: Sequence[str] = (), thin: int = 30) -> DataFrame:
    """(keys, segment, n, total, z) of campaigns with fewer than ``thin`` rows: their residuals pooled with those of the
    channel of their last row.

    ``fact_rows`` gives each campaign's row count and last channel; ``residuals`` is the segment residual series. z is that of
    ``z_calibration`` over the pool, 0 for a constant pool or one under 8 values. Either side is one sorted list (fewer
    than ``thin`` values, and one a day of the channel), so no row per campaign and channel day is shuffled.
    """
    last = fact_rows.groupBy(*keys, F.col("campaign_name").alias("segment")).agg(
        F.count("*").alias("_rows"), F.max_by("channel", F.struct("date", "channel")).alias("_channel")
    ).filter(F.col("_rows") < thin)
    known = residuals.filter(F.col("revenue_residual").isNotNull())

    def values(rows: DataFrame, segment: str, name: str) -> DataFrame:
        return rows.groupBy(*keys, F.col("segment").alias(segment)).agg(F.sort_array(F.collect_list("revenue_residual")).alias(name))

    own = known.filter(F.col("level") == "campaign").join(last.select(*keys, "segment"), [*keys, "segment"])
    channels = values(known.filter(F.col("level") == "channel"), "_channel", "_theirs")
    df = last.join(values(own, "segment", "_own"), [*keys, "segment"], "left").join(channels, [*keys, "_channel"], "left")
    none = F.array().cast("array<double>")
    df = df.select(*keys, "segment", F.concat(F.coalesce("_own", none), F.coalesce("_theirs", none)).alias("_e"))
    df = df.withColumn("n", F.size("_e").cast("bigint")).filter(F.col("n") > 0)
    df = df.withColumn("total", F.aggregate("_e", F.lit(0.0), lambda t, e: t + e)).withColumn("_m", F.col("total") / F.col("n"))
    df = df.withColumn("_d", F.array_sort(F.transform("_e", lambda e: F.abs(e - F.col("_m"))))).drop("_e")
    df = df.withColumn("_sd", F.sqrt(F.try_divide(F.aggregate("_d", F.lit(0.0), lambda t, d: t + d * d), F.col("n") - 1)))
    at = (F.col("n") - 1) * 0.72
    low, high = (F.element_at("_d", (f(at) + 1).cast("int")) for f in (F.floor, F.ceil))
    q = F.try_divide(low + (high - low) * (at - F.floor(at)), F.col("_sd"))
    usable = (F.col("n") >= 8) & (F.coalesce("_sd", F.lit(0.0)) > 1e-9)
    return df.select(*keys, "segment", "n", "total", F.when(usable, round_to(clamp(q, 0.75, 1.65), 4)).otherwise(0.0).alias("z"))


def path_consistency(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gap and agreement of direction of two forecast tables against a baseline (3% dead band)."""

    def direction(v: str) -> Column:
        change = safe_ratio(F.col(v) - F.col("baseline"), "baseline")
        return F.when(change > 0.03, "up").when(change < -0.03, "down").otherwise("flat")

    joined = left.select(*by, "baseline", F.col("expected_revenue").alias("_a")).join(
        right.select(*by, F.col("expected_revenue").alias("_b")), list(by)
    )
    return joined.select(
        *by,
        (F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_b"), F.lit(1.0)) * 100.0).alias("gap_pct"),
        direction("_a").alias("direction_a"),
        direction("_b").alias("direction_b"),
    )


def validation_table(metrics: DataFrame, winners: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per horizon: headline revenue metrics of both models and the winner."""
    by = [*keys, "horizon_days"]
    wide = metrics.filter(F.col("target") == "revenue").groupBy(*by).agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
            for m in ("trained", "safe")
            for c in ("mae", "mape", "coverage", "width_pct")
        ],
    )
    return wide.join(winners.filter(F.col("target") == "revenue").select(*by, "winner"), by)
