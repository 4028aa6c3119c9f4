"""Scenario results, risk and opportunity rules, frontier and plan comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, elasticity_plan, pct_change, power_response, present, round_to, safe_ratio
from adtide.functions.tables import attach
from adtide.operators.planning import blended_roas, capped_allocation, classify_zone, over, severity
from adtide.operators.rollup import top_n


def preset_scenarios(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """-20 / 0 / +30% presets for all channels."""
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("multiplier"))
                for n, m in (("Conservative plan", 0.8), ("Current plan", 1.0), ("Growth plan", 1.3))
            ]
        )
    )
    return stats.select(*keys, "channel", rows)


def automatic_scenario(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The plan's total shared by recent ROAS, exact to the cent, as multipliers of the current budgets."""
    shared = stats.withColumn("_all", F.sum("budget").over(over(keys))).withColumnRenamed("_all", "plan_total")
    allocated = capped_allocation(shared, "plan_total", "recent_roas", None, keys)
    ratio = F.when(F.col("budget") > 0, safe_ratio("allocation", "budget")).otherwise(1.0)
    return allocated.select(*keys, "channel", F.lit("Automatic allocation").alias("scenario"), ratio.alias("multiplier"))


def channel_scenarios(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each channel +20% and -15% on its own, and a shift from the weakest to the best projected ROAS.

    Only changed channels have rows; the others keep their budgets.
    """
    single = F.inline(
        F.array(
            F.struct(F.concat("channel", F.lit(" +20%")).alias("scenario"), F.lit(1.2).alias("multiplier")),
            F.struct(F.concat("channel", F.lit(" -15%")).alias("scenario"), F.lit(0.85).alias("multiplier")),
        )
    )
    each = stats.select(*keys, "channel", single)
    ends = stats.groupBy(*keys).agg(
        F.min_by("channel", F.struct(-F.col("projected_roas"), F.col("channel"))).alias("best"),
        F.min_by("channel", F.struct(F.col("projected_roas"), F.col("channel"))).alias("weakest"),
    )
    shift = ends.select(
        *keys,
        F.lit("Reallocate to best ROAS").alias("scenario"),
        F.inline(
            F.array(
                F.struct(F.col("best").alias("channel"), F.lit(1.18).alias("multiplier")),
                F.struct(F.col("weakest").alias("channel"), F.lit(0.82).alias("multiplier")),
            )
        ),
    )
    return each.unionByName(shift)


def scenario_results(stats: DataFrame, scenarios: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend, revenue, ROAS and profit per scenario against the current plan.

    Sparse scenarios are differences: a scenario equals the plan's totals plus the change of its listed channels.
    """
    by = [*keys, "channel"]
    money = stats.select(*by, "budget", "projected_revenue", "revenue_trend_pct", "projected_roas")
    joined = scenarios.join(money, by)
    budget = F.greatest(F.col("budget") * F.col("multiplier"), F.lit(0.0))
    ratio = F.when(F.col("budget") > 0, safe_ratio(budget, "budget")).otherwise(1.0)
    revenue = power_response("projected_revenue", ratio, elasticity_plan("revenue_trend_pct"))
    changes = joined.groupBy(*keys, "scenario").agg(
        F.sum(round_to(budget, 2)).alias("_spend"),
        F.sum(revenue).alias("_revenue"),
        F.sum(round_to("budget", 2)).alias("_old_spend"),
        F.sum("projected_revenue").alias("_old_revenue"),
    )
    base = money.groupBy(*keys).agg(
        F.sum(round_to("budget", 2)).alias("base_spend"), F.sum("projected_revenue").alias("base_revenue")
    )
    df = attach(changes, base, keys).withColumns(
        {
            "spend": F.col("base_spend") - F.col("_old_spend") + F.col("_spend"),
            "revenue": F.col("base_revenue") - F.col("_old_revenue") + F.col("_revenue"),
        }
    )
    roas, base_roas = safe_ratio("revenue", "spend"), safe_ratio("base_revenue", "base_spend")
    profit = F.col("revenue") - F.col("spend")
    return df.select(
        *keys,
        "scenario",
        round_to("spend", 2).alias("total_spend"),
        round_to("revenue", 2).alias("projected_revenue"),
        round_to(roas, 2).alias("projected_roas"),
        round_to(profit, 2).alias("projected_profit"),
        round_to(pct_change("revenue", "base_revenue"), 2).alias("revenue_delta_pct"),
        round_to(pct_change(roas, base_roas), 2).alias("roas_delta_pct"),
        round_to(profit - (F.col("base_revenue") - F.col("base_spend")), 2).alias("profit_delta"),
    )


def graded(value: Column, medium: float, high: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def risk_rules(
    stats: DataFrame,
    health: DataFrame,
    zones: DataFrame,
    totals: DataFrame,
    target_revenue: float | None = None,
    target_roas: float | None = None,
    keys: Sequence[str] = (),
    keep: int | None = 8,
) -> DataFrame:
    """Threshold rules over channels and plan totals; the ``keep`` most severe per plan."""
    by = [*keys, "channel"]
    df = stats.join(health.select(*by, "score", "status"), by).join(
        zones.select(*by, "zone", "overshoot_pct", "underinvestment"), by
    )

    def item(kind: str, level: Column | str, score: Column) -> Column:
        sev = F.lit(level) if isinstance(level, str) else level
        return F.struct(F.lit(kind).alias("type"), sev.alias("severity"), round_to(clamp(score, 0, 100), 2).alias("score"))

    rev, roas, spend = (F.col(f"{c}_trend_pct") for c in ("revenue", "roas", "spend"))
    gap = F.col("budget_share") - F.col("recent_revenue_share")
    outside = F.col("zone").isin("HIGH_EXTRAPOLATION", "UNSUPPORTED")
    rules = present(
        [
            (F.col("zone") != "SUPPORTED", item("budget_extrapolation", F.when(outside, "high").otherwise("medium"), F.coalesce("overshoot_pct", F.lit(0.0)) + 40.0)),
            (F.col("underinvestment"), item("underinvestment_risk", "medium", F.lit(50.0))),
            (rev < -8, item("revenue_decline_risk", graded(F.abs(rev), 12, 25), F.abs(rev) * 2.5)),
            (roas < -8, item("roas_decline_risk", graded(F.abs(roas), 12, 22), F.abs(roas) * 2.8)),
            (gap > 0.08, item("budget_inefficiency", graded(gap * 100.0, 10, 18), gap * 250.0)),
            ((spend > rev + 15) & (spend > 10), item("over_spending", graded(spend - rev, 18, 35), spend - rev)),
            (F.col("status") == "critical", item("channel_health_risk", "high", 100.0 - F.col("score"))),
        ]
    )
    found = df.select(*by, F.explode(rules).alias("r")).select(*by, "r.*")
    goals = []
    if target_revenue:
        goals.append((F.col("total_projected_revenue") < float(target_revenue), item("target_revenue_gap", "medium", pct_change(F.lit(float(target_revenue)), "total_projected_revenue"))))
    if target_roas:
        goals.append((F.col("plan_roas") < float(target_roas), item("target_roas_gap", "medium", pct_change(F.lit(float(target_roas)), "plan_roas"))))
    if goals:
        plan = totals.select(*keys, F.lit(None).cast("string").alias("channel"), F.explode(present(goals)).alias("r"))
        found = found.unionByName(plan.select(*by, "r.*"))
    ranked = found.withColumn("_sev", F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1))
    order = [F.col("_sev").desc(), F.col("score").desc(), F.col("type"), F.col("channel")]
    out = (top_n(ranked, order, keep, keys) if keep else ranked).drop("_sev")
    # A plan without any finding gets one monitoring row.
    counts = totals.select(*keys).join(out.select(*keys).distinct(), list(keys), "left_anti") if keys else None
    leaders = health.groupBy(*keys).agg(F.min_by("channel", F.struct(-F.col("score"), F.col("channel"))).alias("channel"))
    if keys:
        quiet = leaders.join(counts, list(keys))
    else:
        n = out.groupBy().agg(F.count("*").alias("n"))
        quiet = leaders.where(n.scalar() == 0)
    monitor = quiet.select(*by, F.lit("monitoring").alias("type"), F.lit("low").alias("severity"), F.lit(12.0).alias("score"))
    return out.unionByName(monitor)


def opportunity_rules(
    stats: DataFrame, health: DataFrame, recs: DataFrame, keys: Sequence[str] = (), keep: int = 8
) -> DataFrame:
    by = [*keys, "channel"]
    df = stats.withColumn("_avg", blended_roas(keys)).join(recs.select(*by, "current_budget", "delta_budget"), by)
    gap = F.col("recent_revenue_share") - F.col("budget_share")

    def item(kind: str, level: str, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), round_to(clamp(score, 0, 100), 2).alias("score"))

    rules = present(
        [
            ((F.col("revenue_trend_pct") > 8) & (F.col("projected_roas") >= F.col("_avg")), item("high_growth_channel", "medium", F.col("revenue_trend_pct") + 45.0)),
            ((gap > 0.06) & (F.col("projected_roas") >= F.col("_avg") * 0.95), item("underinvested_channel", "medium", gap * 300.0)),
            (
                F.col("delta_budget") > F.greatest(F.lit(500.0), F.col("current_budget") * 0.08),
                item("budget_reallocation", "low", F.abs("delta_budget") / F.greatest(F.col("current_budget"), F.lit(1.0)) * 100.0),
            ),
        ]
    )
    found = df.select(*by, F.explode(rules).alias("r")).select(*by, "r.*")
    best = top_n(health.select(*by, "score"), [F.col("score").desc(), F.col("channel")], 1, keys)
    if keys:
        quiet = best.join(found.select(*keys).distinct(), list(keys), "left_anti")
    else:
        quiet = best.where(found.groupBy().agg(F.count("*").alias("n")).scalar() == 0)
    extra = quiet.select(*by, F.lit("channel_scaling_test").alias("type"), F.lit("low").alias("severity"), round_to(clamp(F.col("score"), 0, 100), 2).alias("score"))
    order = [F.col("score").desc(), F.col("type"), F.col("channel")]
    return top_n(found, order, keep, keys).unionByName(extra)


def efficient_frontier(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Normalised score of every scenario, its flags, and the recommended one."""
    whole = over(keys)
    by_spend = Window.partitionBy(*keys).orderBy("total_spend", "scenario")
    roas_d, rev_d = F.col("roas_delta_pct"), F.col("revenue_delta_pct")
    risk = (
        F.when(roas_d < -8, 3).when(roas_d < -4, 2).when(roas_d < 0, 1).otherwise(0)
        + (rev_d < -2).cast("int")
        + (F.col("profit_delta") < 0).cast("int")
        + ((F.col("total_spend") > 0) & (safe_ratio("projected_revenue", "total_spend") < 1)).cast("int")
    )

    def norm(c: str) -> Column:
        lo, hi = F.min(c).over(whole), F.max(c).over(whole)
        return F.when(hi <= lo, 0.5).otherwise(clamp(safe_ratio(F.col(c) - lo, hi - lo), 0, 1))

    d_spend = F.col("total_spend") - F.lag("total_spend").over(by_spend)
    d_rev = F.col("projected_revenue") - F.lag("projected_revenue").over(by_spend)
    df = results.withColumns(
        {
            "risk": F.least(risk, F.lit(4)),
            "marginal": F.when(d_spend > 0, safe_ratio(d_rev, d_spend)).when(d_spend.isNotNull(), 0.0),
            "_n_rev": norm("projected_revenue"),
            "_n_roas": norm("projected_roas"),
            "_n_profit": norm("projected_profit"),
        }
    )
    df = df.withColumns(
        {
            "score": F.col("_n_rev") * 0.42 + F.col("_n_roas") * 0.38 + F.col("_n_profit") * 0.2 - F.col("risk") * 0.11,
            "_m_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("marginal").asc_nulls_last(), F.col("scenario"))),
            "_m_n": F.count("marginal").over(whole),
        }
    )
    # Upper median of the marginal returns.
    median = F.max(F.when(F.col("_m_rank") == F.floor(F.col("_m_n") / 2) + 1, F.col("marginal"))).over(whole)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("scenario")))
    flags = {
        "is_recommended": best == 1,
        "is_highest_revenue": F.col("projected_revenue") == F.max("projected_revenue").over(whole),
        "is_highest_roas": F.col("projected_roas") == F.max("projected_roas").over(whole),
        "is_lowest_risk": F.col("risk") == F.min("risk").over(whole),
        "is_diminishing": F.coalesce(
            (F.col("total_spend") > F.min("total_spend").over(whole)) & (F.col("marginal") < F.coalesce(median, F.lit(0.0))),
            F.lit(False),
        ),
    }
    df = df.withColumns(flags)
    label = (
        F.when(F.col("is_recommended"), "Recommended balanced option")
        .when(F.col("is_highest_revenue"), "Highest revenue")
        .when(F.col("is_highest_roas"), "Highest ROAS")
        .when(F.col("is_lowest_risk"), "Lowest risk")
        .when(F.col("is_diminishing"), "Diminishing-return watch")
        .otherwise("Scenario option")
    )
    width = clamp(F.abs(rev_d) * 0.55 + F.greatest(-roas_d, F.lit(0.0)) * 0.9 + 10.0, 8, 65)
    return df.select(
        *keys,
        "scenario",
        F.when(F.col("risk") >= 3, "high").when(F.col("risk") >= 1, "medium").otherwise("low").alias("risk_level"),
        round_to(width, 4).alias("uncertainty_width_pct"),
        *flags,
        label.alias("label"),
        round_to("score", 4).alias("score"),
    )


def plan_zones(scenarios: DataFrame, stats: DataFrame, zones: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst channel zone of each scenario's budgets."""
    by = [*keys, "channel"]
    evidence = zones.select(*by, "window_count", "historical_p90", "historical_max")
    joined = scenarios.join(stats.select(*by, "budget"), by).join(evidence, by)
    zone = classify_zone(F.greatest(round_to(F.col("budget") * F.col("multiplier"), 2), F.lit(0.0)))
    worst = joined.groupBy(*keys, "scenario").agg(F.max(severity(zone)).alias("severity"))
    return worst


def plan_comparison(
    results: DataFrame, scenarios: DataFrame, stats: DataFrame, zones: DataFrame, plan: DataFrame, rows: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Four preset plans and the optimized one: interval, gain against noise, zone, best supported."""
    by = [*keys, "channel"]
    named = results.join(plan_zones(scenarios, stats, zones, keys), [*keys, "scenario"])
    named = attach(named, plan.select(*keys, "baseline_revenue", "baseline_half_width"), keys)
    scale = F.when(F.col("baseline_revenue") > 0, F.greatest(safe_ratio("projected_revenue", "baseline_revenue"), F.lit(0.25))).otherwise(1.0)
    named = named.withColumn("half", F.col("baseline_half_width") * scale).select(
        *keys,
        F.col("scenario").alias("plan"),
        "projected_revenue",
        "projected_roas",
        "half",
        (F.col("projected_revenue") - F.col("baseline_revenue")).alias("gain"),
        (F.col("baseline_half_width") + F.col("half")).alias("noise"),
        "severity",
    ).withColumn("meaningful", F.abs("gain") > F.col("noise"))
    evidence = zones.select(*by, "window_count", "historical_p90", "historical_max")
    worst = rows.select(*by, "allocation").join(evidence, by).groupBy(*keys).agg(
        F.max(severity(classify_zone(F.col("allocation")))).alias("severity")
    )
    best = attach(plan, worst, keys).select(
        *keys,
        F.lit("Optimized allocation").alias("plan"),
        F.col("optimized_revenue").alias("projected_revenue"),
        F.col("optimized_roas").alias("projected_roas"),
        F.col("optimized_half_width").alias("half"),
        "gain",
        F.col("noise_floor").alias("noise"),
        "severity",
        "meaningful",
    )
    every = named.unionByName(best)
    supported = (F.col("meaningful") & (F.col("gain") > 0)).cast("int")
    order = Window.partitionBy(*keys).orderBy("severity", supported.desc(), F.col("projected_revenue").desc(), "plan")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("SUPPORTED", "CAUTION", "HIGH_EXTRAPOLATION", "UNSUPPORTED")]), F.col("severity") + 1)
    return every.withColumn("best_supported", F.row_number().over(order) == 1).select(
        *keys,
        "plan",
        "projected_revenue",
        "projected_roas",
        round_to(F.greatest(F.col("projected_revenue") - F.col("half"), F.lit(0.0)), 2).alias("lower_revenue"),
        round_to(F.col("projected_revenue") + F.col("half"), 2).alias("upper_revenue"),
        round_to("gain", 2).alias("gain"),
        round_to("noise", 2).alias("noise_floor"),
        zone.alias("zone"),
        "meaningful",
        "best_supported",
    )


def action_priority(recs: DataFrame, sim: DataFrame, zones: DataFrame, health: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """High / Medium / Low per recommended change by revenue impact, health and zone."""
    by = [*keys, "channel"]
    df = (
        recs.join(sim.select(*by, "projected_revenue", "projected_roas"), by, "left")
        .join(zones.select(*by, "zone"), by, "left")
        .join(health.select(*by, "score"), by, "left")
    )
    impact = F.col("expected_revenue") - F.coalesce("projected_revenue", F.lit(0.0))
    sure = F.floor(F.coalesce("score", F.lit(50.0)) + 0.5)
    high = (impact > 0) & (sure >= 75) & ~(F.coalesce("zone", F.lit("")) == "UNSUPPORTED")
    medium = (impact > 0) & ~(F.coalesce("zone", F.lit("")) == "HIGH_EXTRAPOLATION")
    return df.select(
        *by,
        round_to(impact, 2).alias("revenue_impact"),
        round_to(F.col("expected_roas") - F.coalesce("projected_roas", F.lit(0.0)), 2).alias("roas_impact"),
        sure.cast("bigint").alias("confidence"),
        "zone",
        F.when(high, "High").when(medium, "Medium").otherwise("Low").alias("priority"),
    )


def optimizer_confidence(plan: DataFrame, risks: DataFrame, health: DataFrame, totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confidence 55-96 from health, risks and the ROAS lift, with the risk level."""
    counts = risks.groupBy(*keys).agg(
        F.count(F.when(F.col("severity") == "high", 1)).alias("high_risks"),
        F.count(F.when(F.col("severity") == "medium", 1)).alias("medium_risks"),
    )
    avg = health.groupBy(*keys).agg(F.avg("score").alias("average_health"))
    df = attach(attach(attach(plan.select(*keys, "optimized_roas"), counts, keys), avg, keys), totals.select(*keys, "plan_roas"), keys)
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("high_risks", "medium_risks")})
    lift = F.col("optimized_roas") - F.col("plan_roas")
    score = clamp(
        F.coalesce("average_health", F.lit(74.0)) - F.col("high_risks") * 8.0 - F.col("medium_risks") * 4.0
        + F.least(F.greatest(lift, F.lit(0.0)) * 12.0, F.lit(8.0)),
        55,
        96,
    )
    df = df.withColumn("confidence_score", F.floor(score + 0.5).cast("bigint"))
    level = F.when(F.col("high_risks") > 0, "High").when((F.col("medium_risks") > 0) | (F.col("confidence_score") < 72), "Medium").otherwise("Low")
    return df.select(*keys, "high_risks", "medium_risks", round_to("average_health", 4).alias("average_health"), "confidence_score", level.alias("risk_level"))


def executive_kpis(kpis: DataFrame, ends: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confidence, next-30 projection, risk level and impact estimates of the portfolio."""
    df = attach(kpis, ends, keys)
    avg = F.when(F.col("recent_days") > 0, safe_ratio("recent_revenue", "recent_days")).otherwise(safe_ratio("revenue", F.greatest(F.col("days"), F.lit(1))))
    forecast = F.greatest(avg * 30.0 * clamp(F.col("revenue_delta_pct") / 100.0 + 1.0, 0.75, 1.25), F.lit(0.0))
    score = clamp(
        F.least(F.col("days") / 6.0, F.lit(18.0)) + 64.0 + F.least(F.col("campaigns") / 4.0, F.lit(8.0)) - F.least(F.abs("roas_delta_pct") / 2.0, F.lit(14.0)),
        55,
        94,
    )
    alerts = (
        (F.col("roas_delta_pct") < -5).cast("int")
        + (F.col("spend_delta_pct") > F.col("revenue_delta_pct") + 8).cast("int")
        + (F.col("worst_roas") < F.col("roas") * 0.75).cast("int")
    )
    df = df.withColumns({"forecast_30_revenue": forecast, "confidence_score": F.floor(score + 0.5).cast("bigint"), "alerts": alerts})
    impact = F.greatest(F.col("forecast_30_revenue") - F.col("recent_revenue"), F.lit(0.0)) + F.col("reallocation_value")
    growth = F.greatest(F.col("best_spend") * 0.15 * F.col("best_roas") * 0.85, F.lit(0.0))
    return df.select(
        *keys,
        "confidence_score",
        round_to("forecast_30_revenue", 2).alias("forecast_30_revenue"),
        round_to(F.when(F.col("recent_roas") != 0, F.col("recent_roas")).otherwise(F.col("roas")), 4).alias("expected_roas"),
        F.when((F.col("alerts") >= 3) | (F.col("roas_delta_pct") < -12), "High")
        .when((F.col("alerts") > 0) | (F.col("roas_delta_pct") < -5), "Medium").otherwise("Low").alias("risk_level"),
        round_to(impact, 2).alias("revenue_impact"),
        round_to(growth, 2).alias("growth_opportunity"),
        round_to(F.col("worst_spend") * 0.1, 2).alias("recyclable_spend"),
    )


def business_flags(recent: DataFrame, forecast: DataFrame, accuracy: DataFrame, by: Sequence[str]) -> DataFrame:
    """Risk and opportunity flags per segment from trends, interval width and fit error."""
    df = recent.join(forecast, list(by)).join(accuracy, list(by))
    rev, roas = F.col("revenue_trend_pct"), F.col("roas_trend_pct")
    width = safe_ratio(F.col("upper_revenue") - F.col("lower_revenue"), "expected_revenue") * 100.0
    error = F.greatest("revenue_mape", "roas_mape")
    risks = present(
        [(rev < -5, F.lit("revenue_down")), (roas < -5, F.lit("roas_down")), (width > 35, F.lit("wide_interval")), (error > 20, F.lit("model_error"))]
    )
    good = present(
        [(rev > 5, F.lit("revenue_up")), (roas > 5, F.lit("roas_up")), ((width <= 25) & (F.col("revenue_mape") <= 15), F.lit("contained_uncertainty"))]
    )
    return df.select(*by, F.array_join(risks, ",").alias("risks"), F.array_join(good, ",").alias("opportunities"))


def share_recommendation(mix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share +4 at or above the blended ROAS, -3 below, renormalised, with the channel verdict."""
    whole = over(keys)
    blend = safe_ratio(F.sum("revenue").over(whole), F.sum("spend").over(whole))
    total = F.sum("share_pct").over(whole)
    df = mix.withColumns({"_blend": blend, "_total": F.when(total != 0, total).otherwise(100.0)})
    moved = F.col("share_pct") + F.when(F.col("roas") >= F.col("_blend"), 4.0).otherwise(-3.0)
    df = df.withColumns(
        {
            "current_share_pct": round_to(F.col("share_pct") * 100.0 / F.col("_total"), 1),
            "_moved": F.greatest(round_to(moved * 100.0 / F.col("_total"), 1), F.lit(0.0)),
        }
    )
    sum_moved = F.sum("_moved").over(whole)
    return df.select(
        *keys,
        "channel",
        "current_share_pct",
        round_to(F.col("_moved") * 100.0 / F.when(sum_moved != 0, sum_moved).otherwise(1.0), 1).alias("recommended_share_pct"),
        F.when(F.col("roas") > F.col("_blend") * 1.05, "outperforming")
        .when(F.col("roas") < F.col("_blend") * 0.9, "underperforming").otherwise("on_track").alias("verdict"),
    )
