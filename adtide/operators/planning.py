"""Budget planning tables: scenario projection, evidence zones, exact allocation, the capped optimizer.

Everything here works on channel-level frames (one row per account and channel), so window partitions
hold one account's channels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import (
    clamp,
    elasticity_plan,
    elasticity_simulation,
    lookup,
    non_negative,
    pct_change,
    power_response,
    round_score,
    round_to,
    safe_ratio,
)
from adtide.functions.tables import attach
from adtide.operators.windows import comparable_windows
from adtide.schema import SPEND_MULTIPLIERS, ZONE_MIN_WINDOWS, ZONE_SEVERITY


def over(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def baselines(summary: DataFrame, horizon: int) -> DataFrame:
    """Horizon spend and revenue at the recent daily rate, or at the whole history's where that is 0."""

    def rate(recent: str, total: str) -> Column:
        now = safe_ratio(recent, "recent_days")
        daily = F.when(now != 0, now).otherwise(safe_ratio(total, "days_active"))
        return F.greatest(daily * horizon, F.lit(0.0))

    return summary.withColumns(
        {
            "baseline_spend": rate("recent_spend", "spend"),
            "baseline_revenue": rate("recent_revenue", "revenue"),
            "sim_elasticity": elasticity_simulation(pct_change("recent_revenue", "previous_revenue")),
        }
    )


def projected(new_spend: Column) -> Column:
    """Revenue at a new horizon spend; channels without baseline spend use their historical ROAS."""
    ratio = safe_ratio(new_spend, "baseline_spend")
    return (
        F.when(new_spend <= 0, 0.0)
        .when(F.col("baseline_spend") <= 0, new_spend * F.greatest(F.col("roas"), F.lit(1.0)))
        .otherwise(F.col("baseline_revenue") * F.pow(ratio, F.col("sim_elasticity")))
    )


def simulate_channels(
    summary: DataFrame, budgets: DataFrame | None, horizon: int = 30, keys: Sequence[str] = ()
) -> DataFrame:
    """Channel x plan: projected revenue with bounds that widen with the spend shift."""
    df = baselines(summary, horizon)
    if budgets is None:
        df = df.withColumn("budget", F.lit(None).cast("double"))
    else:
        df = df.join(budgets.select(*keys, "channel", "budget"), [*keys, "channel"], "left")
    df = df.withColumn("new_spend", non_negative(F.coalesce("budget", "baseline_spend")))
    df = df.withColumn("projected_revenue", projected(F.col("new_spend")))
    shift = F.abs(F.col("new_spend") - F.col("baseline_spend")) / F.greatest(F.col("baseline_spend"), F.lit(1.0))
    df = df.withColumn("uncertainty", F.least(shift * 0.08, F.lit(0.18)) + 0.15)
    return df.select(
        *keys,
        "channel",
        F.lit(horizon).alias("horizon_days"),
        "budget",
        *[round_to(c, 2).alias(c) for c in ("baseline_spend", "new_spend", "baseline_revenue", "projected_revenue")],
        round_to(F.greatest(F.col("projected_revenue") * (1.0 - F.col("uncertainty")), F.lit(0.0)), 2).alias("lower_revenue"),
        round_to(F.col("projected_revenue") * (F.col("uncertainty") + 1.0), 2).alias("upper_revenue"),
        round_to(safe_ratio("baseline_revenue", "baseline_spend"), 2).alias("baseline_roas"),
        round_to(safe_ratio("projected_revenue", "new_spend"), 2).alias("projected_roas"),
    )


def simulation_totals(sim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = ["new_spend", "baseline_spend", "projected_revenue", "lower_revenue", "upper_revenue", "baseline_revenue"]
    totals = sim.groupBy(*keys).agg(*[round_to(F.sum(c), 2).alias(f"total_{c}") for c in cols])
    roas, base = safe_ratio("total_projected_revenue", "total_new_spend"), safe_ratio("total_baseline_revenue", "total_baseline_spend")
    return totals.withColumns(
        {
            "plan_roas": round_to(roas, 2),
            "plan_baseline_roas": round_to(base, 2),
            "revenue_change_pct": round_to(pct_change("total_projected_revenue", "total_baseline_revenue"), 2),
            "roas_change_pct": round_to(pct_change(roas, base), 2),
        }
    )


def spend_uncertainty(daily: DataFrame, sim: DataFrame, horizon: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Share by which bounds widen: spend volatility of the last horizon rows and the planned shift, at most 35%."""
    by = [*keys, "channel"]
    recent = daily.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc()))
    ).filter(F.col("_rn") <= horizon)
    vol = recent.groupBy(*by).agg(
        (F.coalesce(F.stddev_samp("spend"), F.lit(0.0)) / F.greatest(F.avg("spend"), F.lit(1.0))).alias("volatility")
    )
    shift = F.abs(F.col("new_spend") - F.col("baseline_spend")) / F.greatest(F.col("baseline_spend"), F.lit(1.0))
    return sim.join(vol, by).select(*by, "volatility", F.least(F.col("volatility") * 0.18 + shift * 0.10, F.lit(0.35)).alias("uncertainty_pct"))


def roas_decomposition(sim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    blend = safe_ratio(F.sum("projected_revenue").over(over(keys)), F.sum("new_spend").over(over(keys)))
    df = sim.withColumn("blend", blend)
    lift = F.when(F.col("blend") > 0, clamp(safe_ratio(F.col("projected_roas") - F.col("blend"), "blend") * 50.0, -35, 35)).otherwise(0.0)
    return df.select(
        *keys,
        "channel",
        F.col("new_spend").alias("spend"),
        F.col("projected_revenue").alias("revenue"),
        F.col("projected_roas").alias("roas"),
        round_to(F.col("projected_roas") - F.col("blend"), 2).alias("roas_vs_blend"),
        round_to(F.col("projected_roas") * 0.82, 2).alias("marginal_roas"),
        round_score(lift + 50.0).alias("efficiency_score"),
    )


def spend_curve(summary: DataFrame, budgets: DataFrame | None, horizon: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue at six spend multipliers per channel, the first spend whose marginal ROAS is under 1.5, and
    the return of 1,000 more."""
    by = [*keys, "channel"]
    df = baselines(summary, horizon)
    if budgets is None:
        df = df.withColumn("budget", F.lit(0.0))
    else:
        df = df.join(budgets.select(*by, "budget"), by, "left")
    now = non_negative("budget")
    df = df.withColumn("current_spend", F.when(now > 0, now).otherwise(F.col("baseline_spend")))
    df = df.withColumn("plus_marginal", (projected(F.col("current_spend") + 1000.0) - projected(F.col("current_spend"))) / 1000.0)
    curve = df.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in SPEND_MULTIPLIERS])))
    curve = curve.withColumn("curve_spend", F.col("current_spend") * F.col("multiplier"))
    curve = curve.withColumn("curve_revenue", projected(F.col("curve_spend")))
    w = Window.partitionBy(*by).orderBy("multiplier")
    marginal = safe_ratio(
        F.col("curve_revenue") - F.lag("curve_revenue").over(w), F.col("curve_spend") - F.lag("curve_spend").over(w)
    )
    curve = curve.withColumn("marginal", F.when(F.lag("multiplier").over(w).isNotNull(), marginal))
    whole = over(by)
    first = F.min(F.when(F.col("marginal") < 1.5, F.col("curve_spend"))).over(whole)
    saturation = F.coalesce(F.nullif(first, F.lit(0.0)), F.max("curve_spend").over(whole))
    return curve.select(
        *by,
        "multiplier",
        round_to("curve_spend", 2).alias("spend"),
        round_to("curve_revenue", 2).alias("revenue"),
        round_to(safe_ratio("curve_revenue", "curve_spend"), 2).alias("roas"),
        round_to("marginal", 4).alias("marginal"),
        round_to(saturation, 2).alias("saturation_spend"),
        round_to("plus_marginal", 2).alias("marginal_roas"),
    )


# --- zones ----------------------------------------------------------------------------------------
def classify_zone(planned: Column) -> Column:
    """Zone of a planned budget against the historical windows of its channel."""
    evidence = (F.col("window_count") >= ZONE_MIN_WINDOWS) & (F.col("historical_max") > 0)
    return (
        F.when(~evidence, "UNSUPPORTED")
        .when(planned <= F.col("historical_p90") + 1e-9, "SUPPORTED")
        .when(planned <= F.col("historical_max") * 1.10 + 1e-9, "CAUTION")
        .when(planned <= F.col("historical_max") * 1.50 + 1e-9, "HIGH_EXTRAPOLATION")
        .otherwise("UNSUPPORTED")
    )


def channel_zones(daily: DataFrame, plan: DataFrame, horizon: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Planned spend per channel against all full calendar windows of the horizon.

    ``plan`` has (keys, channel, planned); channels without a full window stay, without evidence.
    """
    by = [*keys, "channel"]
    windows = comparable_windows(daily, "channel", keys, (horizon,))
    stats = windows.groupBy(*by).agg(
        F.count("*").alias("window_count"),
        F.percentile("window_spend", F.lit(0.9)).alias("historical_p90"),
        F.max("window_spend").alias("historical_max"),
        F.max_by("window_spend", "date").alias("recent_baseline"),
    )
    df = plan.join(stats, by, "left").withColumns(
        {
            "planned": non_negative("planned"),
            "window_count": F.coalesce("window_count", F.lit(0)),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("historical_p90", "historical_max", "recent_baseline")},
        }
    )
    evidence = (F.col("window_count") >= ZONE_MIN_WINDOWS) & (F.col("historical_max") > 0)
    df = df.withColumn("zone", classify_zone(F.col("planned")))
    overshoot = F.greatest((F.col("planned") / F.col("historical_max") - 1.0) * 100.0, F.lit(0.0))
    return df.select(
        *by,
        round_to("planned", 2).alias("planned"),
        round_to("recent_baseline", 2).alias("recent_baseline"),
        round_to("historical_p90", 2).alias("historical_p90"),
        round_to("historical_max", 2).alias("historical_max"),
        F.when(evidence, round_to("historical_p90", 2)).otherwise(0.0).alias("safe_ceiling"),
        F.when(F.col("historical_p90") > 0, round_to(F.try_divide("planned", "historical_p90"), 4)).alias("ratio_vs_p90"),
        F.when(F.col("historical_max") > 0, round_to(overshoot, 2)).alias("overshoot_pct"),
        "window_count",
        "zone",
        lookup(F.col("zone"), {"SUPPORTED": "none", "CAUTION": "moderate", "HIGH_EXTRAPOLATION": "material", "UNSUPPORTED": "severe"}).alias("confidence_impact"),
        ((F.col("recent_baseline") > 0) & (F.col("planned") < F.col("recent_baseline") * 0.25)).alias("underinvestment"),
    )


def severity(zone: Column) -> Column:
    return lookup(zone, ZONE_SEVERITY, 3)


def zone_name(score: Column) -> Column:
    return (
        F.when(score < 0.5, "SUPPORTED").when(score < 1.25, "CAUTION").when(score < 2.25, "HIGH_EXTRAPOLATION").otherwise("UNSUPPORTED")
    )


def weighted_severity(planned: Column, baseline: Column, zone: Column) -> Column:
    """Aggregate: severity weighted by plan, else by recent baseline, else equally."""
    sev = severity(zone)
    return (
        F.when(F.sum(planned) > 0, safe_ratio(F.sum(planned * sev), F.sum(planned)))
        .when(F.sum(baseline) > 0, safe_ratio(F.sum(baseline * sev), F.sum(baseline)))
        .otherwise(F.avg(sev.cast("double")))
    )


def overall_zone(zones: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    df = zones.groupBy(*keys).agg(
        weighted_severity(F.col("planned"), F.col("recent_baseline"), F.col("zone")).alias("score"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("zone") == "UNSUPPORTED", F.col("channel")))), ",").alias("unsupported_channels"),
        round_to(F.sum("planned"), 2).alias("planned"),
        round_to(F.sum("safe_ceiling"), 2).alias("max_supported"),
    )
    return df.select(
        *keys, zone_name(F.col("score")).alias("zone"), round_to("score", 3).alias("weighted_severity"),
        "unsupported_channels", "planned", "max_supported",
    )


# --- allocation -----------------------------------------------------------------------------------
def water_level(target: str, weight: str, cap: str, by: Sequence[str], order: str, among: Column) -> Column:
    """Level L with sum(min(cap, L * weight)) = target over the rows that take part; NULL if all reach their caps.

    Rows fill up in order of cap / weight; running sums give the level each row would see.
    """
    ratio = F.when(among, F.try_divide(F.col(cap), F.col(weight)))
    spec = Window.partitionBy(*by).orderBy(F.col("_ratio"), F.col(order))
    # The caller adds ``_ratio`` first: a window cannot order by another window's input expression twice.
    used = F.coalesce(F.sum(F.when(among, F.col(cap))).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum(F.when(among, F.col(weight))).over(spec.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.col(target) - used, open_weight)
    return F.when(among & (ratio > level), level)


def fill(df: DataFrame, out: str, target: str, weight: str, cap: str, by: Sequence[str], order: str, among: Column) -> DataFrame:
    """``out`` = min(cap, L * weight) for the rows that take part, 0 for the others."""
    df = df.withColumn("_ratio", F.when(among, F.try_divide(F.col(cap), F.col(weight))))
    df = df.withColumn("_seen", water_level(target, weight, cap, by, order, among))
    df = df.withColumn("_level", F.max("_seen").over(over(by)))
    amount = F.when(F.col("_level").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_level") * F.col(weight)))
    return df.withColumn(out, F.when(among, amount).otherwise(0.0)).drop("_ratio", "_seen", "_level")


def capped_allocation(
    df: DataFrame, total: str, weight: str, cap: str | None, by: Sequence[str], order: str = "channel"
) -> DataFrame:
    """Proportional shares of ``total`` under caps, exact to the cent; adds ``allocation``.

    Weighted rows fill first; rows of weight 0 share what is left equally. Cents left by rounding down go
    one by one to the largest fractions with room.
    """
    whole = over(by)
    cap_col = non_negative(cap) if cap else non_negative(total)
    df = df.withColumns({"_w": non_negative(weight), "_cap": cap_col, "_one": F.lit(1.0)})
    limit = F.least(non_negative(total), F.sum("_cap").over(whole)) if cap else non_negative(total)
    df = df.withColumn("_target", limit)
    weighted = F.col("_w") > 0
    df = df.withColumn("_sum_w", F.coalesce(F.sum(F.when(weighted, F.col("_cap"))).over(whole), F.lit(0.0)))
    df = df.withColumn("_t1", F.least(F.col("_target"), F.col("_sum_w")))
    df = fill(df, "_a1", "_t1", "_w", "_cap", by, order, weighted)
    df = df.withColumn("_t2", F.greatest(F.col("_target") - F.col("_t1"), F.lit(0.0)))
    df = fill(df, "_a2", "_t2", "_one", "_cap", by, order, ~weighted)
    raw = (F.col("_a1") + F.col("_a2")) * 100.0
    df = df.withColumn("_raw", raw)
    df = df.withColumns(
        {
            "_cents": F.floor(F.col("_raw") + 1e-9).cast("double"),
            "_room_cents": F.floor(F.col("_cap") * 100.0 + 1e-9).cast("double"),
        }
    )
    df = df.withColumns(
        {
            "_room": F.greatest(F.col("_room_cents") - F.col("_cents"), F.lit(0.0)),
            "_left": F.greatest(
                F.floor(F.col("_target") * 100.0 + 0.5).cast("double") - F.sum("_cents").over(whole), F.lit(0.0)
            ),
            "_frac": F.col("_raw") - F.col("_cents"),
        }
    )
    # Whole rounds of one cent each, as a level over the rooms, then one last partial round.
    open_rows = F.col("_room") > 0
    df = fill(df, "_even", "_left", "_one", "_room", by, order, open_rows)
    df = df.withColumn("_rounds", F.floor("_even").cast("double"))
    df = df.withColumn("_left", F.col("_left") - F.sum("_rounds").over(whole))
    still = F.col("_room") > F.col("_rounds")
    rank = F.row_number().over(
        Window.partitionBy(*by, "_still").orderBy(F.col("_frac").desc(), F.col(order))
    )
    df = df.withColumn("_still", still).withColumn("_rank", rank)
    extra = F.when(F.col("_still") & (F.col("_rank") <= F.col("_left")), 1.0).otherwise(0.0)
    df = df.withColumn("allocation", (F.col("_cents") + F.col("_rounds") + extra) / 100.0)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# --- channel stats, health, optimizer -------------------------------------------------------------
def channel_stats(summary: DataFrame, sim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shares, trends and projected figures per channel."""
    by = [*keys, "channel"]
    whole = over(keys)
    s = summary.select(
        *by,
        F.when(F.col("recent_revenue") != 0, F.col("recent_revenue")).otherwise(F.col("revenue")).alias("recent_revenue"),
        F.when(F.col("recent_spend") != 0, F.col("recent_spend")).otherwise(F.col("spend")).alias("recent_spend"),
        "previous_revenue",
        "previous_spend",
    )
    df = s.join(sim.select(*by, F.col("budget").alias("_given"), "new_spend", "projected_revenue", "projected_roas"), by)
    df = df.withColumn("budget", non_negative(F.coalesce("_given", "new_spend")))
    given = F.coalesce(F.sum(non_negative("_given")).over(whole), F.lit(0.0))
    total = F.when(given > 0, given).otherwise(F.sum("new_spend").over(whole))
    df = df.withColumns(
        {
            "budget_share": safe_ratio("budget", total),
            "recent_revenue_share": safe_ratio("recent_revenue", F.sum("recent_revenue").over(whole)),
            "recent_roas": safe_ratio("recent_revenue", "recent_spend"),
            "previous_roas": safe_ratio("previous_revenue", "previous_spend"),
            "projected_profit": F.col("projected_revenue") - F.col("budget"),
        }
    )
    trends = {f"{c}_trend_pct": pct_change(f"recent_{c}", f"previous_{c}") for c in ("revenue", "spend", "roas")}
    return df.withColumns(trends).drop("_given", "new_spend")


def blended_roas(keys: Sequence[str]) -> Column:
    w = F.greatest(F.col("budget"), F.lit(1.0))
    return safe_ratio(F.sum(F.col("projected_roas") * w).over(over(keys)), F.sum(w).over(over(keys)))


def channel_health(stats: DataFrame, keys: Sequence[str] = (), stability: str = "constant") -> DataFrame:
    """0-100 score of ROAS, growth, efficiency and stability. ``stability`` is constant or from the ROAS trend."""
    df = stats.withColumn("_avg", blended_roas(keys))
    roas = clamp(F.col("projected_roas") / F.greatest(F.col("_avg"), F.lit(0.01)) * 35.0, 0, 40)
    growth = clamp(F.col("revenue_trend_pct") * 0.45 + 25.0, 0, 30)
    delta = (F.col("recent_revenue_share") - F.col("budget_share")) * 100.0
    efficiency = clamp(delta * 0.7 + 18.0, 0, 20)
    steady = (
        F.lit(8.0)
        if stability == "constant"
        else clamp(10.0 - F.greatest(-F.col("roas_trend_pct"), F.lit(0.0)) * 0.15, 0, 10)
    )
    df = df.withColumn("score", round_to(roas + growth + efficiency + steady, 2))
    return df.select(
        *keys,
        "channel",
        "score",
        F.when(F.col("score") >= 75, "healthy").when(F.col("score") >= 55, "watch").otherwise("critical").alias("status"),
        round_to("revenue_trend_pct", 2).alias("revenue_trend_pct"),
        round_to("roas_trend_pct", 2).alias("roas_trend_pct"),
        round_to(F.col("budget_share") * 100.0, 2).alias("spend_share_pct"),
        round_to(F.col("recent_revenue_share") * 100.0, 2).alias("revenue_share_pct"),
        (F.col("projected_roas") >= F.col("_avg")).alias("roas_above_blend"),
        F.when(delta >= 5, "revenue_exceeds_spend").when(delta <= -5, "spend_exceeds_revenue").otherwise("aligned").alias("share_balance"),
    )


def plan_revenue(budget: Column) -> Column:
    """Projected revenue of a channel at another budget."""
    ratio = F.when(F.col("budget") > 0, safe_ratio(budget, "budget")).otherwise(0.0)
    return power_response("projected_revenue", ratio, elasticity_plan("revenue_trend_pct"))


def optimizer_rows(
    stats: DataFrame,
    health: DataFrame,
    zones: DataFrame,
    totals: DataFrame,
    target_revenue: float | None = None,
    target_roas: float | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per channel with the recommended budget and the plan figures it was derived from."""
    by = [*keys, "channel"]
    whole = over(keys)
    df = (
        stats.join(health.select(*by, "score"), by)
        .join(zones.select(*by, "zone", "safe_ceiling", "recent_baseline"), by)
    )
    df = attach(df, totals, keys)
    current, revenue, roas = F.col("total_new_spend"), F.col("total_projected_revenue"), F.col("plan_roas")
    df = df.withColumn("_blend", F.greatest(blended_roas(keys), F.lit(0.01)))
    wanted = current
    if target_revenue:
        need = F.greatest(current, F.lit(float(target_revenue)) / F.greatest(F.col("_blend") * 0.97, F.lit(0.01)))
        wanted = F.when(F.lit(float(target_revenue)) > revenue, need).otherwise(wanted)
    if target_roas:
        tight = F.lit(float(target_roas)) > roas
        if target_revenue:
            tight = tight & (F.lit(float(target_revenue)) <= revenue)
        wanted = F.when(tight, wanted * clamp(roas / max(float(target_roas), 0.01), 0.75, 1.0)).otherwise(wanted)
    wanted = F.when(current > 0, clamp(wanted, current * 0.65, current * 1.65)).otherwise(wanted)
    df = df.withColumns({"requested_total": wanted, "max_supported": F.sum("safe_ceiling").over(whole)})
    hold = (current > F.col("max_supported") + 0.005) & (F.col("requested_total") >= current)
    df = df.withColumn("_hold", hold)
    momentum = clamp(F.col("revenue_trend_pct") / 100.0 + 1.0, 0.6, 1.45)
    factor = F.greatest(non_negative("projected_roas"), non_negative("recent_roas"), F.lit(0.05))
    safe, budget = F.col("safe_ceiling"), F.col("budget")
    controlled = F.when(safe > 0, F.greatest(budget * 1.5, safe * 0.2)).otherwise(0.0)
    df = df.withColumns(
        {
            "weight": factor * momentum * (F.col("score") / 100.0 + 0.55),
            "cap": F.when(F.col("_hold"), F.greatest(safe, budget * 1.5)).otherwise(F.least(safe, controlled)),
        }
    )
    total = F.when(F.col("_hold"), current).otherwise(F.least(F.col("requested_total"), F.col("max_supported")))
    df = df.withColumn("_controlled", F.sum("cap").over(whole))
    df = df.withColumn("plan_total", F.when(total > F.col("_controlled") + 0.005, F.col("_controlled")).otherwise(total))
    df = df.drop("_blend", "_hold", "_controlled")
    df = capped_allocation(df, "plan_total", "weight", "cap", keys)
    expected = plan_revenue(F.col("allocation"))
    return df.withColumn("allocated_revenue", expected).withColumn(
        "recommended_total", round_to(F.sum("allocation").over(whole), 2)
    )


def recommendations(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    delta = F.col("allocation") - F.col("budget")
    return rows.select(
        *keys,
        "channel",
        round_to("budget", 2).alias("current_budget"),
        F.col("allocation").alias("recommended_budget"),
        round_to(delta, 2).alias("delta_budget"),
        round_to(safe_ratio("budget", "total_new_spend") * 100.0, 2).alias("current_share_pct"),
        round_to(safe_ratio("allocation", "recommended_total") * 100.0, 2).alias("recommended_share_pct"),
        round_to("allocated_revenue", 2).alias("expected_revenue"),
        round_to(safe_ratio("allocated_revenue", "allocation"), 2).alias("expected_roas"),
        F.when(delta > 0.005, "Increase").when(delta < -0.005, "Reduce").otherwise("Hold").alias("action"),
        (F.col("allocation") > F.col("safe_ceiling") + 0.005).alias("exceeds_ceiling"),
    )


def optimizer_outcome(gain: Column, noise: Column, unchanged: Column, infeasible: Column) -> Column:
    return (
        F.when(infeasible, "INFEASIBLE")
        .when(unchanged & (F.abs(gain) <= 0.01), "NO_CHANGE")
        .when(gain <= 0, "DEGRADED")
        .when(gain <= noise + 1e-9, "IMPROVED_WITHIN_NOISE")
        .otherwise("IMPROVED_ABOVE_NOISE")
    )


def optimizer_plan(
    rows: DataFrame, target_revenue: float | None = None, target_roas: float | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Plan-level gain against the forecast noise, and the outcome."""
    # Severity of the recommended amounts is judged by the zones of the current plan.
    plan_cols = ["total_new_spend", "total_projected_revenue", "total_lower_revenue", "total_upper_revenue", "requested_total", "max_supported", "recommended_total"]
    df = rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in plan_cols],
        round_to(F.sum("allocated_revenue"), 2).alias("optimized_revenue"),
        weighted_severity(F.col("allocation"), F.col("recent_baseline"), F.col("zone")).alias("_severity"),
        F.min(F.abs(F.col("allocation") - F.col("budget")) <= 0.005).alias("unchanged"),
    )
    revenue = F.col("total_projected_revenue")
    half = F.greatest(revenue - F.col("total_lower_revenue"), F.col("total_upper_revenue") - revenue, F.lit(0.0))
    df = df.withColumns(
        {
            "optimized_roas": safe_ratio("optimized_revenue", "recommended_total"),
            "gain": F.col("optimized_revenue") - revenue,
            "baseline_half_width": half,
            "_scale": F.when(revenue > 0, safe_ratio("optimized_revenue", revenue)).otherwise(1.0),
        }
    )
    df = df.withColumn(
        "optimized_half_width",
        F.col("baseline_half_width") * F.greatest(F.col("_scale"), F.lit(0.5)) * (round_to("_severity", 3) * 0.2 + 1.0),
    )
    df = df.withColumn("noise_floor", F.col("baseline_half_width") + F.col("optimized_half_width"))
    unmet = F.lit(False)
    if target_revenue:
        unmet = unmet | (F.col("optimized_revenue") + 0.005 < float(target_revenue))
    if target_roas:
        unmet = unmet | (F.col("optimized_roas") + 0.005 < float(target_roas))
    outside = (F.col("total_new_spend") > F.col("max_supported") + 0.005) | (F.col("requested_total") > F.col("max_supported") + 0.005)
    df = df.withColumn("outcome", optimizer_outcome(F.col("gain"), F.col("noise_floor"), F.col("unchanged"), unmet | outside))
    return df.select(
        *keys,
        round_to("total_new_spend", 2).alias("current_budget"),
        F.col("recommended_total").alias("recommended_budget"),
        "optimized_revenue",
        round_to("optimized_roas", 2).alias("optimized_roas"),
        round_to(F.col("optimized_revenue") - F.col("recommended_total"), 2).alias("expected_profit"),
        round_to(revenue, 2).alias("baseline_revenue"),
        round_to("gain", 2).alias("gain"),
        round_to(safe_ratio("gain", revenue) * 100.0, 2).alias("gain_pct"),
        round_to("baseline_half_width", 2).alias("baseline_half_width"),
        round_to("optimized_half_width", 2).alias("optimized_half_width"),
        round_to("noise_floor", 2).alias("noise_floor"),
        round_to("max_supported", 2).alias("max_supported"),
        (F.col("outcome") == "IMPROVED_ABOVE_NOISE").alias("meaningful"),
        "outcome",
    )
