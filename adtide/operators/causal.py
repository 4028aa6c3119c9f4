"""Difference-in-differences around events, with significance, evidence and hypothesis rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import draw_index, evidence_hash, normal_two_sided_p, present, round_to, safe_ratio
from adtide.functions.tables import attach
from adtide.operators.rollup import top_n
from adtide.schema import (
    BOOTSTRAP_EFFECT_DRAWS,
    EVENT_WINDOW_DAYS,
    PARALLEL_GAP_PCT,
    POWER_MAX_P,
    POWER_MIN_DAYS,
)

EVENT = ["event_date", "event_channel", "metric"]


def default_events(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Without given events: the account's latest day for every channel."""
    last = daily.groupBy(*keys).agg(F.max("date").alias("date"))
    return attach(daily.select(*keys, "channel").distinct(), last, keys).withColumn("metric", F.lit("revenue"))


def event_days(daily: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Affected and control sums per event and day of its window.

    Each event becomes its 28 window days first, so the range join is an equi-join on the day.
    """
    by = [*keys, *EVENT]
    offsets = F.explode(F.sequence(F.lit(-EVENT_WINDOW_DAYS), F.lit(EVENT_WINDOW_DAYS - 1)))
    windows = events.select(*keys, "date", "channel", "metric").distinct().select(
        *keys, F.col("date").alias("event_date"), F.col("channel").alias("event_channel"), "metric", offsets.alias("offset")
    ).withColumn("date", F.date_add("event_date", F.col("offset")))
    own = daily.groupBy(*keys, "date", F.col("channel").alias("event_channel")).agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(f"own_{c}") for c in ("revenue", "spend")]
    )
    total = daily.groupBy(*keys, "date").agg(F.count("*").alias("_all"), *[F.sum(c).alias(f"_{c}") for c in ("revenue", "spend")])
    joined = windows.join(total, [*keys, "date"]).join(own, [*keys, "date", "event_channel"], "left")
    others = F.col("_all") > F.coalesce("_rows", F.lit(0))

    def control(c: str) -> Column:
        return F.when(others, F.col(f"_{c}") - F.coalesce(f"own_{c}", F.lit(0.0))).alias(f"control_{c}")

    return joined.select(*by, "offset", "date", "own_revenue", "own_spend", control("revenue"), control("spend"))


def did_effects(daily: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unrounded effect, interval, significance and power per event with enough days on both sides."""
    by = [*keys, *EVENT]
    days = event_days(daily, events, keys).withColumn("after", F.col("offset") >= 0)
    order = Window.partitionBy(*by, "after").orderBy("date")
    # Slopes and draws count observed rows, separately for the channel and its controls.
    days = days.withColumns(
        {
            "own_i": F.count("own_revenue").over(order),
            "control_i": F.count("control_revenue").over(order),
            "own_roas": F.when(F.col("own_revenue").isNotNull(), safe_ratio("own_revenue", "own_spend")),
            "control_roas": F.when(F.col("control_revenue").isNotNull(), safe_ratio("control_revenue", "control_spend")),
        }
    )
    pre, post = ~F.col("after"), F.col("after")

    def val(cond: Column, c: str) -> Column:
        return F.when(cond, F.col(c))

    agg = days.groupBy(*by).agg(
        F.count(val(pre, "own_revenue")).alias("pre_days"),
        F.count(val(post, "own_revenue")).alias("post_days"),
        F.count(val(pre, "control_revenue")).alias("control_pre_days"),
        F.count(val(post, "control_revenue")).alias("control_post_days"),
        *[
            F.avg(val(cond, f"{who}_{c}")).alias(f"{side}_{who}_{c}")
            for side, cond in (("pre", pre), ("post", post))
            for who in ("own", "control")
            for c in ("revenue", "roas")
        ],
        F.regr_slope(val(pre, "own_revenue"), val(pre & F.col("own_revenue").isNotNull(), "own_i")).alias("own_slope"),
        F.regr_slope(val(pre, "control_revenue"), val(pre & F.col("control_revenue").isNotNull(), "control_i")).alias("control_slope"),
        F.stddev_samp(val(post, "own_revenue")).alias("post_sd"),
        F.transform(
            F.array_sort(F.collect_list(F.when(post & F.col("own_revenue").isNotNull(), F.struct("own_i", "own_revenue")))),
            lambda s: s["own_revenue"],
        ).alias("post_values"),
    )
    least = max(5, EVENT_WINDOW_DAYS // 2)
    agg = agg.filter((F.col("pre_days") >= least) & (F.col("post_days") >= least))
    paired = (F.col("control_pre_days") >= 5) & (F.col("control_post_days") >= 5) & (F.col("pre_control_revenue") > 0)
    control_change = F.when(paired, safe_ratio("post_control_revenue", "pre_control_revenue") - 1.0).otherwise(
        F.col("own_slope") * F.col("post_days") / F.greatest(F.col("pre_own_revenue"), F.lit(1.0))
    )
    scale = F.greatest(F.abs("pre_own_revenue"), F.abs("pre_control_revenue"), F.lit(1.0))
    gap = F.when(F.col("control_pre_days") >= 5, F.abs(F.col("own_slope") - F.col("control_slope")) / scale * 100.0).otherwise(100.0)
    df = agg.withColumns(
        {
            "control_change": control_change,
            "control_roas_change": F.when(paired, F.col("post_control_roas") - F.col("pre_control_roas")).otherwise(0.0),
            "parallel_pct": gap,
            "parallel_passed": (F.col("control_pre_days") >= 5) & (gap <= PARALLEL_GAP_PCT),
        }
    )
    df = df.withColumn("expected_daily", F.col("pre_own_revenue") * (F.col("control_change") + 1.0))
    df = df.withColumns(
        {
            "incremental_revenue": (F.col("post_own_revenue") - F.col("expected_daily")) * F.col("post_days"),
            "roas_effect": F.col("post_own_roas") - F.col("pre_own_roas") - F.col("control_roas_change"),
            "effect_se": F.col("post_sd") / F.sqrt(F.col("post_days").cast("double")) * F.col("post_days"),
        }
    )
    ci = bootstrap_ci(df, by)
    df = df.join(ci, by).drop("post_values")
    flat = F.col("post_sd") <= 1e-9
    df = df.withColumns(
        {
            "lower_revenue": F.when(flat, F.col("incremental_revenue")).otherwise(F.col("lower_draw")),
            "upper_revenue": F.when(flat, F.col("incremental_revenue")).otherwise(F.col("upper_draw")),
            "t_statistic": F.when(F.col("effect_se") > 1e-9, F.try_divide("incremental_revenue", "effect_se")).otherwise(0.0),
        }
    ).drop("lower_draw", "upper_draw")
    return significance(df)


def bootstrap_ci(effects: DataFrame, by: Sequence[str], draws: int = BOOTSTRAP_EFFECT_DRAWS) -> DataFrame:
    """Percentiles of resampled sums of the post-window residuals (at most 14 values per event)."""
    # Both explodes keep the events' partitioning, so the sums and percentiles need no further shuffle.
    n = F.size("post_values")
    rows = effects.select(
        *by, "post_values", "expected_daily", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("rep")
    ).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    drawn = F.element_at("post_values", (draw_index("rep", "pos", n) + 1).cast("int"))
    sums = rows.groupBy(*by, "rep").agg(F.sum(drawn - F.col("expected_daily")).alias("total"))
    bounds = sums.groupBy(*by).agg(F.percentile("total", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    return bounds.select(*by, F.col("b")[0].alias("lower_draw"), F.col("b")[1].alias("upper_draw"))


def significance(df: DataFrame) -> DataFrame:
    """p-value, strength, power check and confidence from the effect and its error."""
    df = df.withColumn(
        "p_value",
        F.when(F.col("effect_se") > 1e-9, normal_two_sided_p("t_statistic")).otherwise(1.0),
    )
    p = F.least(F.greatest(F.col("p_value"), F.lit(0.0)), F.lit(1.0))
    weight = F.least(F.greatest(F.col("post_days") / 14.0, F.lit(0.35)), F.lit(1.0))
    crosses = (F.col("lower_revenue") <= 0) & (F.col("upper_revenue") >= 0)
    enough = (F.col("pre_days") >= POWER_MIN_DAYS) & (F.col("post_days") >= POWER_MIN_DAYS)
    df = df.withColumns(
        {
            "effect_strength": F.abs("t_statistic") * (1.0 - p) * F.when(F.col("parallel_passed"), 1.0).otherwise(0.6) * weight,
            "ci_crosses_zero": crosses,
            "power_passed": enough & F.col("parallel_passed") & (F.col("p_value") <= POWER_MAX_P) & ~crosses,
            "low_power_reasons": F.array_join(
                present(
                    [
                        (~enough, F.lit("minimum sample check failed")),
                        (F.col("p_value") > POWER_MAX_P, F.lit("p-value exceeds 0.15")),
                        (crosses, F.lit("95% confidence interval crosses zero")),
                        (~F.col("parallel_passed"), F.lit("parallel-trends check is weak")),
                    ]
                ),
                "; ",
            ),
        }
    )
    narrow = F.abs(F.col("upper_revenue") - F.col("lower_revenue")) <= F.abs("incremental_revenue") * 2.5
    strong = F.col("power_passed") & (F.col("post_days") >= 12) & (F.col("p_value") <= 0.05) & narrow
    return df.withColumns(
        {
            "confidence": F.when(strong, "high").when(F.col("power_passed"), "medium").otherwise("low"),
            "effect_direction": F.when(F.col("incremental_revenue") >= 0, "positive").otherwise("negative"),
        }
    )


def present_estimates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The published columns, rounded."""
    money = ["incremental_revenue", "lower_revenue", "upper_revenue", "roas_effect", "parallel_pct", "effect_se"]
    return df.select(
        *keys,
        F.col("event_date").alias("date"),
        F.col("event_channel").alias("channel"),
        "metric",
        "pre_days",
        "post_days",
        *[round_to(c, 2).alias(c) for c in money],
        "parallel_passed",
        round_to("t_statistic", 3).alias("t_statistic"),
        round_to("p_value", 4).alias("p_value"),
        round_to("effect_strength", 3).alias("effect_strength"),
        "effect_direction",
        "power_passed",
        "low_power_reasons",
        "confidence",
    )


def top_estimates(estimates: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    order = [F.col("effect_strength").desc(), F.abs("incremental_revenue").desc(), F.col("date"), F.col("channel")]
    return top_n(estimates, order, n, keys)


def structured_evidence(
    estimates: DataFrame, metrics: DataFrame, anomalies: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One evidence row per key: the strongest estimate with its channel's before-and-after figures."""
    best = top_estimates(estimates, keys, 1)
    df = best.join(metrics.select(*keys, "channel", "campaign_type", "baseline_revenue", "baseline_roas", "observed_roas"), [*keys, "channel"], "left")
    if anomalies is None:
        df = df.withColumn("has_anomaly", F.lit(False))
    else:
        seen = anomalies.select(*keys, "channel").distinct().withColumn("has_anomaly", F.lit(True))
        df = df.join(seen, [*keys, "channel"], "left").withColumn("has_anomaly", F.coalesce("has_anomaly", F.lit(False)))
    crosses = (F.col("lower_revenue") <= 0) & (F.col("upper_revenue") >= 0)
    share = F.when(
        F.coalesce("baseline_revenue", F.lit(0.0)) != 0, safe_ratio("incremental_revenue", "baseline_revenue") * 100.0
    ).otherwise(F.col("roas_effect") * 100.0)
    limits = present(
        [
            (F.lit(True), F.lit("observational DiD, not randomized incrementality")),
            (crosses, F.lit("95% confidence interval crosses zero")),
            (~F.col("parallel_passed"), F.lit("parallel-trends check is weak")),
            (F.col("p_value") > POWER_MAX_P, F.lit("p-value is not statistically strong")),
            (~F.col("power_passed"), F.lit("minimum sample or power check did not pass")),
            (~F.col("has_anomaly"), F.lit("no material anomaly supported the event timing")),
        ]
    )
    df = df.withColumns({"delta_percent": round_to(share, 2), "limitations": limits})
    df = df.withColumn("evidence_label", evidence_label())
    return df.withColumn("evidence_hash", evidence_hash(F.struct("channel", "date", "incremental_revenue", "p_value")))


def evidence_label(planned: Column | None = None, detected: Column | None = None) -> Column:
    """Decision table from an evidence row to its label.

    ``detected`` tells whether anything happened at all; without an estimate that is whether there is an anomaly.
    """
    crosses = (F.col("lower_revenue") <= 0) & (F.col("upper_revenue") >= 0)
    noisy = (F.col("confidence") == "low") | crosses
    effect, p, strength = F.col("incremental_revenue"), F.col("p_value"), F.col("effect_strength")
    down = (F.col("effect_direction") == "negative") | (effect < 0)
    return (
        F.when(planned if planned is not None else F.lit(False), "budget_reallocation")
        .when(~F.col("power_passed") | (F.col("low_power_reasons") != ""), "underpowered_sample_watch")
        .when(~(detected if detected is not None else F.lit(True)), "stable_run_rate")
        .when(noisy & F.col("has_anomaly") & (F.col("effect_direction") == "positive") & (effect > 0), "noisy_positive_signal")
        .when(noisy & F.col("has_anomaly"), "anomaly_timing_watch")
        .when(noisy, "volatility_watch")
        .when(down & (p <= 0.10) & (strength >= 0.20), "statistically_supported_decline")
        .when(down, "efficiency_compression")
        .when((p <= 0.10) & ((F.abs("delta_percent") >= 15) | (strength >= 0.35)), "statistically_supported_lift")
        .otherwise("incremental_growth")
    )


def without_estimate(df: DataFrame) -> DataFrame:
    """The label of rows with has_anomaly but no estimate: low confidence, no effect, an interval at zero."""
    zero = {c: F.lit(0.0) for c in ("incremental_revenue", "lower_revenue", "upper_revenue", "effect_strength", "delta_percent")}
    text = {"confidence": F.lit("low"), "effect_direction": F.lit("neutral"), "low_power_reasons": F.lit("")}
    full = df.withColumns({**zero, **text, "p_value": F.lit(1.0), "power_passed": F.lit(True)})
    return full.withColumn("evidence_label", evidence_label(detected=F.col("has_anomaly"))).drop(*zero, *text, "p_value", "power_passed")


def confidence_score(label: Column, strength: Column, p: Column) -> Column:
    base = F.when(label == "high", 0.82).when(label == "medium", 0.58).otherwise(0.32)
    lift = F.least(F.greatest(strength * 0.03, F.lit(0.0)), F.lit(0.12))
    sure = F.least(F.greatest((0.2 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))) * 0.4, F.lit(0.0)), F.lit(0.08))
    return round_to(F.least(F.greatest(base + lift + sure, F.lit(0.05)), F.lit(0.95)), 2)


def rank_hypotheses(
    estimates: DataFrame, anomalies: DataFrame, mix: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Competing explanations as rows: largest estimate, latest anomaly, ROAS spread, concentration; at most 5."""
    did = top_n(estimates, [F.abs("incremental_revenue").desc(), F.col("date").desc(), F.col("channel")], 1, keys)
    rows = did.select(
        *keys, F.lit(1).alias("slot"), F.lit("budget shift").alias("hypothesis"), "channel", "confidence",
        confidence_score(F.col("confidence"), F.col("effect_strength"), F.col("p_value")).alias("score"),
    )
    order = [F.col("date").desc(), F.col("channel"), F.col("metric"), F.col("z_score")]
    signal = top_n(anomalies, order, 1, keys)
    level = F.when(F.col("severity") == "critical", "high").otherwise("medium")
    rows = rows.unionByName(
        signal.select(
            *keys, F.lit(2).alias("slot"), F.lit("platform algorithm change").alias("hypothesis"), "channel",
            level.alias("confidence"), confidence_score(level, F.abs("z_score"), F.lit(0.2)).alias("score"),
        )
    )
    wide = mix.groupBy(*keys).agg(
        (F.max("roas") - F.min("roas")).alias("spread"),
        F.min_by("channel", F.struct(-F.col("roas"), F.col("channel"))).alias("best"),
        F.min_by("channel", F.struct(-F.col("spend"), F.col("channel"))).alias("dominant"),
        (safe_ratio(F.max("spend"), F.sum("spend")) * 100.0).alias("share"),
        F.count("*").alias("channels"),
    )
    level = F.when(F.col("spread") >= 1.25, "medium").otherwise("low")
    rows = rows.unionByName(
        wide.filter(F.col("spread") >= 0.75).select(
            *keys, F.lit(3).alias("slot"), F.lit("budget reallocation implication").alias("hypothesis"),
            F.col("best").alias("channel"), level.alias("confidence"),
            confidence_score(level, F.col("spread") / 2.0, F.lit(0.18)).alias("score"),
        )
    )
    level = F.when(F.col("spread") < 1.0, "low").otherwise("medium")
    rows = rows.unionByName(
        wide.filter((F.col("share") >= 45.0) & (F.col("channels") >= 2)).select(
            *keys, F.lit(4).alias("slot"), F.lit("channel cannibalization risk").alias("hypothesis"),
            F.col("dominant").alias("channel"), level.alias("confidence"),
            confidence_score(level, F.col("share") / 50.0, F.lit(0.22)).alias("score"),
        )
    )
    # With fewer than two candidates the two generic explanations join in.
    few = (
        mix.select(*keys).distinct() if keys else mix.agg(F.lit(1).alias("_one")).drop("_one").limit(1)
    )
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    generic = F.inline(
        F.array(
            F.struct(F.lit(5).alias("slot"), F.lit("seasonality").alias("hypothesis"), F.lit(0.35).alias("score")),
            F.struct(F.lit(6).alias("slot"), F.lit("creative fatigue").alias("hypothesis"), F.lit(0.31).alias("score")),
        )
    )
    lonely = (few.join(counted, list(keys), "left") if keys else counted).filter(F.coalesce("n", F.lit(0)) < 2)
    extra = lonely.select(*keys, generic).select(
        *keys, "slot", "hypothesis", F.lit(None).cast("string").alias("channel"), F.lit("low").alias("confidence"), "score"
    )
    every = rows.unionByName(extra)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("slot")).cast("bigint")
    return every.withColumn("rank", rank).filter(F.col("rank") <= 5).drop("slot")
