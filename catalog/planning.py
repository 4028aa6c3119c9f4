"""Planning, optimizer and decision queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from adtide.functions.exprs import round_to
from adtide.operators import decisions as D
from adtide.operators import planning as P
from adtide.operators import rollup as R
from adtide.plans.facts import campaign_fact
from adtide.session import checkpoint
from catalog.base import clampq, cte, div, pct, query, r, sql
from catalog.forecasts import demo_budgets
from catalog.rollups import rounded

TARGET_REVENUE = 90_000_000.0
TARGET_ROAS = 5.0


class Plan:
    """The planning frames of one fact table.

    All of them derive from the channel-by-day rollup, which is checkpointed: the facts are scanned once
    however many planning tables a query joins.
    """

    def __init__(self, spark, sf, keys=()):
        self.keys = keys
        self.daily = checkpoint(R.daily_channel(campaign_fact(spark, sf, keys), keys))
        self.summary = R.channel_summary(self.daily, keys)
        self.budgets = demo_budgets(self.daily, keys)
        self.sim = P.simulate_channels(self.summary, self.budgets, 30, keys)
        self.totals = P.simulation_totals(self.sim, keys)

    # Channel-level frames that several tables share are written once; they hold a row per account and channel.
    @cached_property
    def stats(self):
        return checkpoint(P.channel_stats(self.summary, self.sim, self.keys))

    @cached_property
    def health(self):
        return P.channel_health(self.stats, self.keys)

    @cached_property
    def zones(self):
        plan = self.stats.select(*self.keys, "channel", F.col("budget").alias("planned"))
        return checkpoint(P.channel_zones(self.daily, plan, 30, self.keys))

    @cached_property
    def rows(self):
        return checkpoint(
            P.optimizer_rows(self.stats, self.health, self.zones, self.totals, TARGET_REVENUE, None, self.keys)
        )

    @cached_property
    def scenarios(self):
        both = D.preset_scenarios(self.stats, self.keys).unionByName(D.automatic_scenario(self.stats, self.keys))
        return checkpoint(both)


# --- simulation -----------------------------------------------------------------------------------
TREND = pct("recent_revenue", "previous_revenue")
cte(
    "base_plan",
    f"""
SELECT *, coalesce(budget, baseline_spend) AS new_spend_raw, {clampq(f'0.78 + {TREND} / 500.0', 0.58, 0.92)} AS el FROM (
SELECT s.*, b.budget, greatest(CASE WHEN s.recent_spend <> 0 THEN s.recent_spend / s.recent_days ELSE s.spend / s.days_active END * 30, 0) AS baseline_spend,
 greatest(CASE WHEN s.recent_revenue <> 0 THEN s.recent_revenue / s.recent_days ELSE s.revenue / s.days_active END * 30, 0) AS baseline_revenue
FROM summary s LEFT JOIN budgets b USING (channel))""",
    "summary",
    "budgets",
)


def proj(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 0 THEN 0 WHEN baseline_spend <= 0 THEN ({x}) * greatest(roas, 1.0) ELSE baseline_revenue * pow(({x}) / baseline_spend, el) END)"


cte(
    "sim",
    f"""
SELECT channel, 30 AS horizon_days, budget, {r('baseline_spend', 2)} AS baseline_spend, {r('new_spend_raw', 2)} AS new_spend, {r('baseline_revenue', 2)} AS baseline_revenue, {r('pr', 2)} AS projected_revenue,
 {r('greatest(pr * (1.0 - u), 0)', 2)} AS lower_revenue, {r('pr * (1.0 + u)', 2)} AS upper_revenue, {r(div('baseline_revenue', 'baseline_spend'), 2)} AS baseline_roas, {r(div('pr', 'new_spend_raw'), 2)} AS projected_roas
FROM (SELECT *, {proj('new_spend_raw')} AS pr, 0.15 + least(abs(new_spend_raw - baseline_spend) / greatest(baseline_spend, 1.0) * 0.08, 0.18) AS u FROM base_plan)""",
    "base_plan",
)


@query("pl1_channel_scenario_projection", sql("SELECT * FROM sim", "sim"))
def channel_scenario_projection(spark, sf):
    return Plan(spark, sf).sim


TOT = ["new_spend", "baseline_spend", "projected_revenue", "lower_revenue", "upper_revenue", "baseline_revenue"]
cte(
    "totals",
    f"""
SELECT *, {r(div('total_projected_revenue', 'total_new_spend'), 2)} AS plan_roas, {r(div('total_baseline_revenue', 'total_baseline_spend'), 2)} AS plan_baseline_roas,
 {r(pct('total_projected_revenue', 'total_baseline_revenue'), 2)} AS revenue_change_pct, {r(pct(div('total_projected_revenue', 'total_new_spend'), div('total_baseline_revenue', 'total_baseline_spend')), 2)} AS roas_change_pct
FROM (SELECT {', '.join(f"{r(f'sum({c})', 2)} AS total_{c}" for c in TOT)} FROM sim)""",
    "sim",
)


@query("agg14_forecast_totals", sql("SELECT * FROM totals", "totals"))
def forecast_totals(spark, sf):
    return Plan(spark, sf).totals


@query(
    "pl2_spend_uncertainty",
    sql(
        f"""SELECT channel, {r('volatility')} AS volatility, {r("least(volatility * 0.18 + abs(new_spend - baseline_spend) / greatest(baseline_spend, 1.0) * 0.10, 0.35)")} AS uncertainty_pct
FROM sim JOIN (SELECT channel, coalesce(stddev_samp(spend), 0) / greatest(avg(spend), 1.0) AS volatility FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY date DESC) AS rn FROM chan) WHERE rn <= 30 GROUP BY channel) USING (channel)""",
        "sim",
        "chan",
    ),
)
def spend_uncertainty(spark, sf):
    p = Plan(spark, sf)
    return rounded(P.spend_uncertainty(p.daily, p.sim), "volatility", "uncertainty_pct")


@query(
    "pl3_roas_decomposition",
    sql(
        f"""SELECT channel, new_spend AS spend, projected_revenue AS revenue, projected_roas AS roas, {r('projected_roas - blend', 2)} AS roas_vs_blend, {r('projected_roas * 0.82', 2)} AS marginal_roas,
 CAST(least(greatest(floor(50.0 + least(greatest((projected_roas - blend) / blend * 50.0, -35), 35) + 0.5), 0), 100) AS BIGINT) AS efficiency_score
FROM (SELECT *, sum(projected_revenue) OVER () / sum(new_spend) OVER () AS blend FROM sim)""",
        "sim",
    ),
)
def roas_decomposition(spark, sf):
    return P.roas_decomposition(Plan(spark, sf).sim)


cte(
    "curve",
    f"""
SELECT *, first_value(plus) OVER (PARTITION BY channel) AS p, (crev - lag(crev) OVER w) / (cs - lag(cs) OVER w) AS marginal, max(cs) OVER (PARTITION BY channel) AS top_spend
FROM (SELECT *, {proj('cs')} AS crev, ({proj('cur + 1000.0')} - {proj('cur')}) / 1000.0 AS plus FROM (SELECT *, cur * multiplier AS cs FROM (
 SELECT *, CASE WHEN budget > 0 THEN budget ELSE baseline_spend END AS cur, unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS multiplier FROM base_plan)))
WINDOW w AS (PARTITION BY channel ORDER BY multiplier)""",
    "base_plan",
)


@query(
    "pl4_spend_curve",
    sql(
        f"""SELECT channel, multiplier, {r('cs', 2)} AS spend, {r('crev', 2)} AS revenue, {r(div('crev', 'cs'), 2)} AS roas, {r('marginal')} AS marginal,
 {r('coalesce(min(CASE WHEN marginal < 1.5 THEN cs END) OVER (PARTITION BY channel), top_spend)', 2)} AS saturation_spend, {r('p', 2)} AS marginal_roas FROM curve""",
        "curve",
    ),
)
def spend_curve(spark, sf):
    p = Plan(spark, sf)
    return P.spend_curve(p.summary, p.budgets)


# --- stats, health, zones -------------------------------------------------------------------------
cte(
    "stats",
    f"""
SELECT *, projected_revenue - budget AS projected_profit, {div('budget', 'CASE WHEN given > 0 THEN given ELSE sum(new_spend) OVER () END')} AS budget_share, {div('recent_revenue', 'sum(recent_revenue) OVER ()')} AS recent_revenue_share,
 {div('recent_revenue', 'recent_spend')} AS recent_roas, {div('previous_revenue', 'previous_spend')} AS previous_roas,
 {pct('recent_revenue', 'previous_revenue')} AS revenue_trend_pct, {pct('recent_spend', 'previous_spend')} AS spend_trend_pct,
 {pct(div('recent_revenue', 'recent_spend'), div('previous_revenue', 'previous_spend'))} AS roas_trend_pct
FROM (SELECT s.channel, CASE WHEN recent_revenue <> 0 THEN recent_revenue ELSE revenue END AS recent_revenue, CASE WHEN recent_spend <> 0 THEN recent_spend ELSE spend END AS recent_spend,
  previous_revenue, previous_spend, coalesce(m.budget, m.new_spend) AS budget, m.new_spend, m.projected_revenue, m.projected_roas, coalesce(sum(m.budget) OVER (), 0) AS given FROM summary s JOIN sim m USING (channel))""",
    "summary",
    "sim",
)
STAT_COLS = ["budget_share", "recent_revenue_share", "recent_roas", "previous_roas", "revenue_trend_pct", "spend_trend_pct", "roas_trend_pct"]


@query(
    "pl9_channel_stats",
    sql(f"SELECT channel, {r('budget', 2)} AS budget, recent_revenue, recent_spend, projected_revenue, projected_roas, {r('projected_profit', 2)} AS projected_profit, {', '.join(f'{r(c)} AS {c}' for c in STAT_COLS)} FROM stats", "stats"),
)
def channel_stats(spark, sf):
    df = Plan(spark, sf).stats
    return df.select(
        "channel", round_to("budget", 2).alias("budget"), "recent_revenue", "recent_spend", "projected_revenue", "projected_roas",
        round_to("projected_profit", 2).alias("projected_profit"), *[round_to(c, 4).alias(c) for c in STAT_COLS],
    )


AVG = div("sum(projected_roas * greatest(budget, 1.0)) OVER ()", "sum(greatest(budget, 1.0)) OVER ()")


def health_sql(steady: str) -> str:
    return f"""
SELECT channel, score, CASE WHEN score >= 75 THEN 'healthy' WHEN score >= 55 THEN 'watch' ELSE 'critical' END AS status, {r('revenue_trend_pct', 2)} AS revenue_trend_pct, {r('roas_trend_pct', 2)} AS roas_trend_pct,
 {r('budget_share * 100.0', 2)} AS spend_share_pct, {r('recent_revenue_share * 100.0', 2)} AS revenue_share_pct, projected_roas >= avg_roas AS roas_above_blend,
 CASE WHEN delta >= 5 THEN 'revenue_exceeds_spend' WHEN delta <= -5 THEN 'spend_exceeds_revenue' ELSE 'aligned' END AS share_balance
FROM (SELECT *, {r(f"least(greatest(projected_roas / greatest(avg_roas, 0.01) * 35.0, 0), 40) + least(greatest(25.0 + revenue_trend_pct * 0.45, 0), 30) + least(greatest(18.0 + delta * 0.7, 0), 20) + {steady}", 2)} AS score
 FROM (SELECT *, {AVG} AS avg_roas, (recent_revenue_share - budget_share) * 100.0 AS delta FROM stats))"""


cte("health", health_sql("8.0"), "stats")


@query("pl8_channel_health", sql("SELECT * FROM health", "health"))
def channel_health(spark, sf):
    return Plan(spark, sf).health


@query("pl8_channel_health_trend", sql(health_sql("least(greatest(10.0 - greatest(-roas_trend_pct, 0) * 0.15, 0), 10)"), "stats"))
def channel_health_trend(spark, sf):
    return P.channel_health(Plan(spark, sf).stats, (), "trend")


cte(
    "zones",
    f"""
SELECT channel, {r('planned', 2)} AS planned, {r('recent_baseline', 2)} AS recent_baseline, {r('p90', 2)} AS historical_p90, {r('hmax', 2)} AS historical_max, CASE WHEN n >= 3 AND hmax > 0 THEN {r('p90', 2)} ELSE 0 END AS safe_ceiling,
 CASE WHEN p90 > 0 THEN {r('planned / p90')} END AS ratio_vs_p90, CASE WHEN hmax > 0 THEN {r('greatest((planned / hmax - 1.0) * 100.0, 0)', 2)} END AS overshoot_pct, n AS window_count, zone,
 CASE zone WHEN 'SUPPORTED' THEN 'none' WHEN 'CAUTION' THEN 'moderate' WHEN 'HIGH_EXTRAPOLATION' THEN 'material' ELSE 'severe' END AS confidence_impact, recent_baseline > 0 AND planned < recent_baseline * 0.25 AS underinvestment
FROM (SELECT *, CASE WHEN n < 3 OR hmax <= 0 THEN 'UNSUPPORTED' WHEN planned <= p90 + 1e-9 THEN 'SUPPORTED' WHEN planned <= hmax * 1.10 + 1e-9 THEN 'CAUTION' WHEN planned <= hmax * 1.50 + 1e-9 THEN 'HIGH_EXTRAPOLATION' ELSE 'UNSUPPORTED' END AS zone
FROM (SELECT s.channel, s.budget AS planned, count(*) AS n, quantile_cont(window_spend, 0.9) AS p90, max(window_spend) AS hmax, arg_max(window_spend, date) AS recent_baseline
 FROM stats s JOIN comparable c ON c.channel = s.channel AND c.horizon_days = 30 GROUP BY 1, 2))""",
    "stats",
    "comparable",
)


@query("pl5_channel_zone", sql("SELECT * FROM zones", "zones"))
def channel_zone(spark, sf):
    return Plan(spark, sf).zones


SEV = "CASE zone WHEN 'SUPPORTED' THEN 0 WHEN 'CAUTION' THEN 1 WHEN 'HIGH_EXTRAPOLATION' THEN 2 ELSE 3 END"


def wsev(planned: str, base: str = "recent_baseline") -> str:
    return f"CASE WHEN sum({planned}) > 0 THEN sum({planned} * {SEV}) / sum({planned}) WHEN sum({base}) > 0 THEN sum({base} * {SEV}) / sum({base}) ELSE avg({SEV}) END"


@query(
    "pl6_overall_zone",
    sql(
        f"""SELECT CASE WHEN score < 0.5 THEN 'SUPPORTED' WHEN score < 1.25 THEN 'CAUTION' WHEN score < 2.25 THEN 'HIGH_EXTRAPOLATION' ELSE 'UNSUPPORTED' END AS zone, {r('score', 3)} AS weighted_severity,
 unsupported_channels, planned, max_supported FROM (SELECT {wsev('planned')} AS score, coalesce(string_agg(CASE WHEN zone = 'UNSUPPORTED' THEN channel END, ',' ORDER BY channel), '') AS unsupported_channels,
 {r('sum(planned)', 2)} AS planned, {r('sum(safe_ceiling)', 2)} AS max_supported FROM zones)""",
        "zones",
    ),
)
def overall_zone(spark, sf):
    return P.overall_zone(Plan(spark, sf).zones)


# --- allocation -----------------------------------------------------------------------------------
def fill_sql(src: str, out: str, target: str, weight: str, cap: str, among: str, key: str, order: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    return f"""SELECT * EXCLUDE (ratio_, seen_, level_), CASE WHEN NOT ({among}) THEN 0 WHEN level_ IS NULL THEN {cap} ELSE least({cap}, level_ * {weight}) END AS {out} FROM (
SELECT *, max(seen_) OVER ({part}) AS level_ FROM (SELECT *, CASE WHEN {among} AND ratio_ > lv_ THEN lv_ END AS seen_ FROM (
SELECT *, ({target} - coalesce(sum(CASE WHEN {among} THEN {cap} END) OVER ({part} ORDER BY ratio_ NULLS FIRST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
 nullif(sum(CASE WHEN {among} THEN {weight} END) OVER ({part} ORDER BY ratio_ NULLS FIRST, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv_
FROM (SELECT *, CASE WHEN {among} THEN {cap} / nullif({weight}, 0) END AS ratio_ FROM ({src})))))""".replace("EXCLUDE (ratio_, seen_, level_)", "EXCLUDE (ratio_, seen_, level_, lv_)")


def alloc_sql(src: str, total: str, weight: str, cap: str, key: str = "", order: str = "channel") -> str:
    part = f"PARTITION BY {key}" if key else ""
    q = f"SELECT *, CAST({weight} AS DOUBLE) AS w_, CAST({cap} AS DOUBLE) AS c_, 1.0::DOUBLE AS one_ FROM ({src})"
    q = f"SELECT *, least({total}, sum(c_) OVER ({part})) AS target_, coalesce(sum(CASE WHEN w_ > 0 THEN c_ END) OVER ({part}), 0) AS sumw_ FROM ({q})"
    q = f"SELECT *, least(target_, sumw_) AS t1_ FROM ({q})"
    q = fill_sql(q, "a1_", "t1_", "w_", "c_", "w_ > 0", key, order)
    q = f"SELECT *, greatest(target_ - t1_, 0) AS t2_ FROM ({q})"
    q = fill_sql(q, "a2_", "t2_", "one_", "c_", "w_ <= 0", key, order)
    q = f"SELECT *, (a1_ + a2_) * 100.0 AS raw_ FROM ({q})"
    q = f"SELECT *, floor(raw_ + 1e-9) AS cents_, floor(c_ * 100.0 + 1e-9) AS rc_ FROM ({q})"
    q = f"SELECT *, greatest(rc_ - cents_, 0) AS room_, greatest(floor(target_ * 100.0 + 0.5) - sum(cents_) OVER ({part}), 0) AS left_, raw_ - cents_ AS frac_ FROM ({q})"
    q = fill_sql(q, "even_", "left_", "one_", "room_", "room_ > 0", key, order)
    q = f"SELECT *, floor(even_) AS rounds_ FROM ({q})"
    q = f"SELECT *, left_ - sum(rounds_) OVER ({part}) AS rest_, room_ > rounds_ AS still_ FROM ({q})"
    q = f"SELECT *, row_number() OVER (PARTITION BY {key + ', ' if key else ''}still_ ORDER BY frac_ DESC, {order}) AS rank_ FROM ({q})"
    drop = "w_, c_, one_, target_, sumw_, t1_, a1_, t2_, a2_, raw_, cents_, rc_, room_, left_, frac_, even_, rounds_, rest_, still_, rank_"
    return f"SELECT * EXCLUDE ({drop}), (cents_ + rounds_ + CASE WHEN still_ AND rank_ <= rest_ THEN 1 ELSE 0 END) / 100.0 AS allocation FROM ({q})"


CELLS = """SELECT channel, campaign_name, spend, sum(spend) OVER (PARTITION BY channel) * CASE channel WHEN 'BUILDING' THEN 1.4 WHEN 'FURNITURE' THEN 0.7 ELSE 1.07 END / 7.0 * 7.0 AS total,
 CASE WHEN campaign_name LIKE '%5' THEN 0 ELSE roas END AS weight, CASE WHEN campaign_name LIKE '%1' THEN spend * 0.5 ELSE spend * 1.25 + 0.013 END AS cap FROM board"""


@query(
    "pl7_capped_allocation",
    sql(f"SELECT channel, campaign_name, {r('total', 2)} AS total, allocation FROM ({alloc_sql(CELLS, 'total', 'weight', 'cap', 'channel', 'campaign_name')})", "board"),
)
def capped_allocation(spark, sf):
    """Every channel's money over its campaigns: weights of 0, tight caps, caps between cents."""
    board = R.campaign_leaderboard(campaign_fact(spark, sf))
    factor = F.when(F.col("channel") == "BUILDING", 1.4).when(F.col("channel") == "FURNITURE", 0.7).otherwise(1.07)
    name = F.col("campaign_name")
    cells = board.select(
        "channel",
        "campaign_name",
        (F.sum("spend").over(P.over(["channel"])) * factor / 7.0 * 7.0).alias("total"),
        F.when(name.endswith("5"), 0.0).otherwise(F.col("roas")).alias("weight"),
        F.when(name.endswith("1"), F.col("spend") * 0.5).otherwise(F.col("spend") * 1.25 + 0.013).alias("cap"),
    )
    out = P.capped_allocation(cells, "total", "weight", "cap", ["channel"], "campaign_name")
    return out.select("channel", "campaign_name", round_to("total", 2).alias("total"), "allocation")


@query(
    "pl7_uncapped_allocation",
    sql(
        f"SELECT channel, campaign_name, allocation FROM ({alloc_sql('SELECT channel, campaign_name, revenue, sum(spend) OVER (PARTITION BY channel) / 3.0 AS total FROM board', 'total', 'revenue', 'total', 'channel', 'campaign_name')})",
        "board",
    ),
)
def uncapped_allocation(spark, sf):
    board = R.campaign_leaderboard(campaign_fact(spark, sf)).select(
        "channel", "campaign_name", "revenue", (F.sum("spend").over(P.over(["channel"])) / 3.0).alias("total")
    )
    return P.capped_allocation(board, "total", "revenue", None, ["channel"], "campaign_name").select("channel", "campaign_name", "allocation")


cte(
    "opt_in",
    f"""
SELECT *, CASE WHEN held THEN greatest(safe_ceiling, budget * 1.5) ELSE least(safe_ceiling, CASE WHEN safe_ceiling > 0 THEN greatest(budget * 1.5, safe_ceiling * 0.2) ELSE 0 END) END AS cap,
 greatest(projected_roas, recent_roas, 0.05) * least(greatest(1.0 + revenue_trend_pct / 100.0, 0.6), 1.45) * (0.55 + score / 100.0) AS weight,
 CASE WHEN held THEN total_new_spend ELSE least(requested_total, max_supported) END AS wanted FROM (
SELECT *, total_new_spend > max_supported + 0.005 AND requested_total >= total_new_spend AS held FROM (
SELECT *, CASE WHEN total_new_spend > 0 THEN least(greatest(CASE WHEN {TARGET_REVENUE} > total_projected_revenue THEN greatest(total_new_spend, {TARGET_REVENUE} / greatest(blend * 0.97, 0.01)) ELSE total_new_spend END, total_new_spend * 0.65), total_new_spend * 1.65)
  ELSE total_new_spend END AS requested_total, sum(safe_ceiling) OVER () AS max_supported FROM (
SELECT s.*, h.score, z.zone, z.safe_ceiling, z.recent_baseline, z.window_count, z.historical_p90, z.historical_max, t.*, greatest({AVG.replace('projected_roas', 's.projected_roas').replace('budget', 's.budget')}, 0.01) AS blend
FROM stats s JOIN health h USING (channel) JOIN zones z USING (channel), totals t)))""",
    "stats",
    "health",
    "zones",
    "totals",
)
cte("opt_capped", "SELECT *, CASE WHEN wanted > sum(cap) OVER () + 0.005 THEN sum(cap) OVER () ELSE wanted END AS plan_total FROM opt_in", "opt_in")
EL = "least(greatest(0.72 + revenue_trend_pct / 400.0, 0.55), 0.92)"
cte(
    "opt_rows",
    f"SELECT *, CASE WHEN allocation <= 0 OR budget <= 0 THEN 0 ELSE projected_revenue * pow(allocation / budget, {EL}) END AS allocated_revenue, {r('sum(allocation) OVER ()', 2)} AS recommended_total FROM ({alloc_sql('SELECT * FROM opt_capped', 'plan_total', 'weight', 'cap')})",
    "opt_capped",
)
cte(
    "recs",
    f"""SELECT channel, {r('budget', 2)} AS current_budget, allocation AS recommended_budget, {r('allocation - budget', 2)} AS delta_budget, {r(div('budget', 'total_new_spend') + ' * 100.0', 2)} AS current_share_pct,
 {r(div('allocation', 'recommended_total') + ' * 100.0', 2)} AS recommended_share_pct, {r('allocated_revenue', 2)} AS expected_revenue, {r(div('allocated_revenue', 'allocation'), 2)} AS expected_roas,
 CASE WHEN allocation - budget > 0.005 THEN 'Increase' WHEN allocation - budget < -0.005 THEN 'Reduce' ELSE 'Hold' END AS action, allocation > safe_ceiling + 0.005 AS exceeds_ceiling FROM opt_rows""",
    "opt_rows",
)


@query("pl10_optimizer_recommendations", sql("SELECT * FROM recs", "recs"))
def optimizer_recommendations(spark, sf):
    return P.recommendations(Plan(spark, sf).rows)


cte(
    "plan",
    f"""
SELECT *, outcome = 'IMPROVED_ABOVE_NOISE' AS meaningful FROM (SELECT *, CASE WHEN ovr + 0.005 < {TARGET_REVENUE} OR cur > ms + 0.005 OR req > ms + 0.005 THEN 'INFEASIBLE' WHEN unchanged AND abs(g) <= 0.01 THEN 'NO_CHANGE' WHEN g <= 0 THEN 'DEGRADED' WHEN g <= nf + 1e-9 THEN 'IMPROVED_WITHIN_NOISE' ELSE 'IMPROVED_ABOVE_NOISE' END AS outcome
FROM (SELECT *, bh + oh AS nf FROM (SELECT *, bh * greatest(CASE WHEN rev > 0 THEN ovr / rev ELSE 1.0 END, 0.5) * (1.0 + 0.2 * {r('sev', 3)}) AS oh, ovr - rev AS g FROM (
SELECT max(total_new_spend) AS cur, max(recommended_total) AS rt, {r('sum(allocated_revenue)', 2)} AS ovr, max(total_projected_revenue) AS rev, max(max_supported) AS ms, max(requested_total) AS req,
 greatest(max(total_projected_revenue) - max(total_lower_revenue), max(total_upper_revenue) - max(total_projected_revenue), 0) AS bh, {wsev('allocation')} AS sev, bool_and(abs(allocation - budget) <= 0.005) AS unchanged FROM opt_rows))))""",
    "opt_rows",
)


@query(
    "pl10_optimizer_plan",
    sql(
        f"""SELECT {r('cur', 2)} AS current_budget, rt AS recommended_budget, ovr AS optimized_revenue, {r(div('ovr', 'rt'), 2)} AS optimized_roas, {r('ovr - rt', 2)} AS expected_profit, {r('rev', 2)} AS baseline_revenue, {r('g', 2)} AS gain,
 {r(div('g', 'rev') + ' * 100.0', 2)} AS gain_pct, {r('bh', 2)} AS baseline_half_width, {r('oh', 2)} AS optimized_half_width, {r('nf', 2)} AS noise_floor, {r('ms', 2)} AS max_supported, meaningful, outcome FROM plan""",
        "plan",
    ),
)
def optimizer_plan(spark, sf):
    """The plan row; its outcome is pl11."""
    return P.optimizer_plan(Plan(spark, sf).rows, TARGET_REVENUE)


# --- scenarios ------------------------------------------------------------------------------------
cte(
    "scen",
    f"""
SELECT channel, scenario, multiplier FROM (SELECT channel, 'Conservative plan' AS scenario, 0.8::DOUBLE AS multiplier FROM stats UNION ALL SELECT channel, 'Current plan', 1.0 FROM stats UNION ALL SELECT channel, 'Growth plan', 1.3 FROM stats
UNION ALL SELECT channel, 'Automatic allocation', CASE WHEN budget > 0 THEN allocation / budget ELSE 1.0 END FROM ({alloc_sql('SELECT *, sum(budget) OVER () AS plan_total FROM stats', 'plan_total', 'recent_roas', 'plan_total')}))""",
    "stats",
)


def results_sql(scen: str) -> str:
    return f"""
SELECT scenario, {r('spend', 2)} AS total_spend, {r('revenue', 2)} AS projected_revenue, {r(div('revenue', 'spend'), 2)} AS projected_roas, {r('revenue - spend', 2)} AS projected_profit, {r(pct('revenue', 'br'), 2)} AS revenue_delta_pct,
 {r(pct(div('revenue', 'spend'), div('br', 'bs')), 2)} AS roas_delta_pct, {r('(revenue - spend) - (br - bs)', 2)} AS profit_delta
FROM (SELECT x.scenario, b.bs - x.os + x.sp AS spend, b.br - x.orv + x.rv AS revenue, b.* FROM (
 SELECT scenario, sum({r('greatest(budget * multiplier, 0)', 2)}) AS sp, sum(CASE WHEN budget > 0 AND multiplier <= 0 THEN 0 ELSE projected_revenue * pow(CASE WHEN budget > 0 THEN greatest(budget * multiplier, 0) / budget ELSE 1.0 END, {EL}) END) AS rv,
  sum({r('budget', 2)}) AS os, sum(projected_revenue) AS orv FROM {scen} JOIN stats USING (channel) GROUP BY scenario) x,
 (SELECT sum({r('budget', 2)}) AS bs, sum(projected_revenue) AS br FROM stats) b)"""


cte("results", results_sql("scen"), "scen")


@query("pl12_whatif_scenarios", sql("SELECT * FROM results", "results"))
def whatif_scenarios(spark, sf):
    p = Plan(spark, sf)
    return D.scenario_results(p.stats, p.scenarios)


cte(
    "chan_scen",
    """SELECT channel, channel || ' +20%' AS scenario, 1.2::DOUBLE AS multiplier FROM stats UNION ALL SELECT channel, channel || ' -15%', 0.85 FROM stats
UNION ALL SELECT (SELECT channel FROM stats ORDER BY projected_roas DESC, channel LIMIT 1), 'Reallocate to best ROAS', 1.18 UNION ALL SELECT (SELECT channel FROM stats ORDER BY projected_roas, channel LIMIT 1), 'Reallocate to best ROAS', 0.82""",
    "stats",
)


@query("pl13_default_scenarios", sql(f"SELECT channel, scenario, {r('multiplier')} AS multiplier FROM chan_scen UNION ALL SELECT channel, scenario, {r('multiplier')} FROM scen", "chan_scen", "scen"))
def default_scenarios(spark, sf):
    p = Plan(spark, sf)
    return rounded(D.channel_scenarios(p.stats).unionByName(p.scenarios).select("channel", "scenario", "multiplier"), "multiplier")


@query("pl12_channel_scenarios", sql(results_sql("chan_scen"), "chan_scen"))
def channel_scenario_results(spark, sf):
    p = Plan(spark, sf)
    return D.scenario_results(p.stats, D.channel_scenarios(p.stats))


# --- rules ----------------------------------------------------------------------------------------
def grade(x: str, m: float, h: float) -> str:
    return f"CASE WHEN {x} >= {h} THEN 'high' WHEN {x} >= {m} THEN 'medium' ELSE 'low' END"


def capped(x: str) -> str:
    return r(f"least(greatest({x}, 0), 100)", 2)


cte("ruled", "SELECT s.*, h.score, h.status, z.zone, z.overshoot_pct, z.underinvestment, s.budget_share - s.recent_revenue_share AS gap FROM stats s JOIN health h USING (channel) JOIN zones z USING (channel)", "stats", "health", "zones")
SP = "spend_trend_pct - revenue_trend_pct"
cte(
    "risks",
    f"""
SELECT channel, 'budget_extrapolation' AS type, CASE WHEN zone IN ('HIGH_EXTRAPOLATION', 'UNSUPPORTED') THEN 'high' ELSE 'medium' END AS severity, {capped('coalesce(overshoot_pct, 0) + 40.0')} AS score FROM ruled WHERE zone <> 'SUPPORTED'
UNION ALL SELECT channel, 'underinvestment_risk', 'medium', 50.0 FROM ruled WHERE underinvestment
UNION ALL SELECT channel, 'revenue_decline_risk', {grade('abs(revenue_trend_pct)', 12, 25)}, {capped('abs(revenue_trend_pct) * 2.5')} FROM ruled WHERE revenue_trend_pct < -8
UNION ALL SELECT channel, 'roas_decline_risk', {grade('abs(roas_trend_pct)', 12, 22)}, {capped('abs(roas_trend_pct) * 2.8')} FROM ruled WHERE roas_trend_pct < -8
UNION ALL SELECT channel, 'budget_inefficiency', {grade('gap * 100.0', 10, 18)}, {capped('gap * 250.0')} FROM ruled WHERE gap > 0.08
UNION ALL SELECT channel, 'over_spending', {grade(SP, 18, 35)}, {capped(SP)} FROM ruled WHERE spend_trend_pct > revenue_trend_pct + 15 AND spend_trend_pct > 10
UNION ALL SELECT channel, 'channel_health_risk', 'high', {capped('100.0 - score')} FROM ruled WHERE status = 'critical'
UNION ALL SELECT NULL, 'target_revenue_gap', 'medium', {capped(pct(str(TARGET_REVENUE), 'total_projected_revenue'))} FROM totals WHERE total_projected_revenue < {TARGET_REVENUE}
UNION ALL SELECT NULL, 'target_roas_gap', 'medium', {capped(pct(str(TARGET_ROAS), 'plan_roas'))} FROM totals WHERE plan_roas < {TARGET_ROAS}""",
    "ruled",
    "totals",
)


def risks(p, keep=8):
    return D.risk_rules(p.stats, p.health, p.zones, p.totals, TARGET_REVENUE, TARGET_ROAS, p.keys, keep)


@query("pl14_risk_rules", sql("SELECT * FROM risks", "risks"))
def risk_rules(spark, sf):
    """All findings, without the top-8 cut."""
    return risks(Plan(spark, sf), None)


RANKED = "SELECT * FROM risks ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, score DESC, type, channel NULLS FIRST LIMIT 8"
cte("top_risks", RANKED, "risks")


@query("top5_top_risks", sql("SELECT * FROM top_risks", "top_risks"))
def top_risks(spark, sf):
    return risks(Plan(spark, sf))


cte(
    "opps",
    f"""
SELECT channel, 'high_growth_channel' AS type, 'medium' AS severity, {capped('45.0 + revenue_trend_pct')} AS score FROM og WHERE revenue_trend_pct > 8 AND projected_roas >= avg_roas
UNION ALL SELECT channel, 'underinvested_channel', 'medium', {capped('gap * 300.0')} FROM og WHERE gap > 0.06 AND projected_roas >= avg_roas * 0.95
UNION ALL SELECT channel, 'budget_reallocation', 'low', {capped('abs(delta_budget) / greatest(current_budget, 1.0) * 100.0')} FROM og WHERE delta_budget > greatest(500.0, current_budget * 0.08)""",
    "og",
)
cte("og", f"SELECT s.*, {AVG.replace('projected_roas', 's.projected_roas').replace('budget', 's.budget')} AS avg_roas, s.recent_revenue_share - s.budget_share AS gap, r.current_budget, r.delta_budget FROM stats s JOIN recs r USING (channel)", "stats", "recs")


@query(
    "pl15_opportunity_rules",
    sql(
        f"SELECT * FROM (SELECT * FROM opps ORDER BY score DESC, type, channel LIMIT 8) UNION ALL SELECT channel, 'channel_scaling_test', 'low', {capped('score')} FROM (SELECT * FROM health ORDER BY score DESC, channel LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM opps)",
        "opps",
        "health",
    ),
)
def opportunity_rules(spark, sf):
    p = Plan(spark, sf)
    return D.opportunity_rules(p.stats, p.health, P.recommendations(p.rows))


# --- frontier and comparison ----------------------------------------------------------------------
def normq(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () <= min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


cte(
    "frontier_in",
    f"""
SELECT *, least(CASE WHEN roas_delta_pct < -8 THEN 3 WHEN roas_delta_pct < -4 THEN 2 WHEN roas_delta_pct < 0 THEN 1 ELSE 0 END + CASE WHEN revenue_delta_pct < -2 THEN 1 ELSE 0 END + CASE WHEN profit_delta < 0 THEN 1 ELSE 0 END
 + CASE WHEN total_spend > 0 AND projected_revenue / total_spend < 1 THEN 1 ELSE 0 END, 4) AS risk,
 CASE WHEN lag(total_spend) OVER w IS NULL THEN NULL WHEN total_spend - lag(total_spend) OVER w > 0 THEN (projected_revenue - lag(projected_revenue) OVER w) / (total_spend - lag(total_spend) OVER w) ELSE 0 END AS marginal,
 {normq('projected_revenue')} AS n1, {normq('projected_roas')} AS n2, {normq('projected_profit')} AS n3
FROM (SELECT * FROM results UNION ALL SELECT * FROM chan_results) WINDOW w AS (ORDER BY total_spend, scenario)""",
    "results",
    "chan_results",
)
cte("chan_results", results_sql("chan_scen"), "chan_scen")
cte(
    "frontier",
    f"""
SELECT scenario, CASE WHEN risk >= 3 THEN 'high' WHEN risk >= 1 THEN 'medium' ELSE 'low' END AS risk_level, {r('least(greatest(abs(revenue_delta_pct) * 0.55 + greatest(-roas_delta_pct, 0) * 0.9 + 10.0, 8), 65)')} AS uncertainty_width_pct,
 is_recommended, is_highest_revenue, is_highest_roas, is_lowest_risk, is_diminishing, CASE WHEN is_recommended THEN 'Recommended balanced option' WHEN is_highest_revenue THEN 'Highest revenue' WHEN is_highest_roas THEN 'Highest ROAS'
 WHEN is_lowest_risk THEN 'Lowest risk' WHEN is_diminishing THEN 'Diminishing-return watch' ELSE 'Scenario option' END AS label, {r('sc')} AS score
FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, scenario) = 1 AS is_recommended, projected_revenue = max(projected_revenue) OVER () AS is_highest_revenue, projected_roas = max(projected_roas) OVER () AS is_highest_roas,
 risk = min(risk) OVER () AS is_lowest_risk, coalesce(total_spend > min(total_spend) OVER () AND marginal < (SELECT list_sort(list(marginal))[count(marginal) // 2 + 1] FROM frontier_in WHERE marginal IS NOT NULL), false) AS is_diminishing
 FROM (SELECT *, n1 * 0.42 + n2 * 0.38 + n3 * 0.2 - risk * 0.11 AS sc FROM frontier_in))""",
    "frontier_in",
)


@query("pl16_efficient_frontier", sql("SELECT * FROM frontier", "frontier"))
def efficient_frontier(spark, sf):
    p = Plan(spark, sf)
    results = D.scenario_results(p.stats, p.scenarios.unionByName(D.channel_scenarios(p.stats).select("channel", "scenario", "multiplier")))
    return D.efficient_frontier(results)


def zone_of(x: str) -> str:
    return f"CASE WHEN window_count < 3 OR historical_max <= 0 THEN 3 WHEN {x} <= historical_p90 + 1e-9 THEN 0 WHEN {x} <= historical_max * 1.10 + 1e-9 THEN 1 WHEN {x} <= historical_max * 1.50 + 1e-9 THEN 2 ELSE 3 END"


cte(
    "compared",
    f"""
SELECT res.scenario AS plan, res.projected_revenue, res.projected_roas, bh * greatest(res.projected_revenue / rev, 0.25) AS half, res.projected_revenue - rev AS gain, bh + bh * greatest(res.projected_revenue / rev, 0.25) AS noise, sv.severity,
 abs(res.projected_revenue - rev) > bh + bh * greatest(res.projected_revenue / rev, 0.25) AS meaningful
FROM results res JOIN (SELECT scenario, max({zone_of(r('budget * multiplier', 2))}) AS severity FROM scen JOIN stats USING (channel) JOIN zones USING (channel) GROUP BY scenario) sv USING (scenario),
 (SELECT {r('bh', 2)} AS bh, {r('rev', 2)} AS rev FROM plan)
UNION ALL SELECT 'Optimized allocation', ovr, {r(div('ovr', 'rt'), 2)}, {r('oh', 2)}, {r('g', 2)}, {r('nf', 2)}, (SELECT max({zone_of('allocation')}) FROM opt_rows), meaningful FROM plan""",
    "results",
    "scen",
    "zones",
    "plan",
    "opt_rows",
)


@query(
    "pl17_plan_comparison",
    sql(
        f"""SELECT plan, projected_revenue, projected_roas, {r('greatest(projected_revenue - half, 0)', 2)} AS lower_revenue, {r('projected_revenue + half', 2)} AS upper_revenue, {r('gain', 2)} AS gain, {r('noise', 2)} AS noise_floor,
 CASE severity WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CAUTION' WHEN 2 THEN 'HIGH_EXTRAPOLATION' ELSE 'UNSUPPORTED' END AS zone, meaningful,
 row_number() OVER (ORDER BY severity, CASE WHEN meaningful AND gain > 0 THEN 1 ELSE 0 END DESC, projected_revenue DESC, plan) = 1 AS best_supported FROM compared""",
        "compared",
    ),
)
def plan_comparison(spark, sf):
    p = Plan(spark, sf)
    rows = p.rows
    plan = P.optimizer_plan(rows, TARGET_REVENUE)
    return D.plan_comparison(D.scenario_results(p.stats, p.scenarios), p.scenarios, p.stats, p.zones, plan, rows)


@query(
    "pl18_action_priority",
    sql(
        f"""SELECT channel, {r('impact', 2)} AS revenue_impact, {r('expected_roas - projected_roas', 2)} AS roas_impact, CAST(floor(score + 0.5) AS BIGINT) AS confidence, zone,
 CASE WHEN impact > 0 AND floor(score + 0.5) >= 75 AND zone <> 'UNSUPPORTED' THEN 'High' WHEN impact > 0 AND zone <> 'HIGH_EXTRAPOLATION' THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT r.*, s.projected_roas, r.expected_revenue - s.projected_revenue AS impact, z.zone, h.score FROM recs r JOIN sim s USING (channel) JOIN zones z USING (channel) JOIN health h USING (channel))""",
        "recs",
        "sim",
        "zones",
        "health",
    ),
)
def action_priority(spark, sf):
    """Recommendations joined with projection, zone and health (also jn7)."""
    p = Plan(spark, sf)
    return D.action_priority(P.recommendations(p.rows), p.sim, p.zones, p.health)


@query(
    "pl19_optimizer_confidence",
    sql(
        f"""SELECT high_risks, medium_risks, {r('ah')} AS average_health, cs AS confidence_score, CASE WHEN high_risks > 0 THEN 'High' WHEN medium_risks > 0 OR cs < 72 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT *, CAST(floor(least(greatest(ah - high_risks * 8.0 - medium_risks * 4.0 + least(greatest({r(div('ovr', 'rt'), 2)} - plan_roas, 0) * 12.0, 8.0), 55), 96) + 0.5) AS BIGINT) AS cs FROM plan,
 (SELECT count(CASE WHEN severity = 'high' THEN 1 END) AS high_risks, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium_risks FROM top_risks), (SELECT avg(score) AS ah FROM health), (SELECT plan_roas FROM totals))""",
        "plan",
        "top_risks",
        "health",
        "totals",
    ),
)
def optimizer_confidence(spark, sf):
    p = Plan(spark, sf)
    return D.optimizer_confidence(P.optimizer_plan(p.rows, TARGET_REVENUE), risks(p), p.health, p.totals)


@query(
    "pl20_executive_kpis",
    sql(
        f"""SELECT cs AS confidence_score, {r('fr', 2)} AS forecast_30_revenue, {r('CASE WHEN recent_roas <> 0 THEN recent_roas ELSE roas END')} AS expected_roas,
 CASE WHEN al >= 3 OR roas_delta_pct < -12 THEN 'High' WHEN al > 0 OR roas_delta_pct < -5 THEN 'Medium' ELSE 'Low' END AS risk_level, {r('greatest(fr - recent_revenue, 0) + reallocation_value', 2)} AS revenue_impact,
 {r('best_spend * 0.15 * best_roas * 0.85', 2)} AS growth_opportunity, {r('worst_spend * 0.1', 2)} AS recyclable_spend
FROM (SELECT *, greatest(recent_revenue / recent_days * 30.0 * least(greatest(1.0 + revenue_delta_pct / 100.0, 0.75), 1.25), 0) AS fr,
 CAST(floor(least(greatest(64.0 + least(days / 6.0, 18.0) + least(campaigns / 4.0, 8.0) - least(abs(roas_delta_pct) / 2.0, 14.0), 55), 94) + 0.5) AS BIGINT) AS cs,
 CAST(roas_delta_pct < -5 AS INTEGER) + CAST(spend_delta_pct > revenue_delta_pct + 8 AS INTEGER) + CAST(worst_roas < roas * 0.75 AS INTEGER) AS al FROM kpis, best_worst)""",
        "kpis",
        "best_worst",
    ),
)
def executive_kpis(spark, sf):
    fact = campaign_fact(spark, sf)
    return D.executive_kpis(R.portfolio_kpis(fact), R.best_worst_channel(fact))


@query(
    "pl22_share_recommendation",
    sql(
        f"""SELECT channel, cur AS current_share_pct, {r("mv * 100.0 / sum(mv) OVER ()", 1)} AS recommended_share_pct, CASE WHEN roas > blend * 1.05 THEN 'outperforming' WHEN roas < blend * 0.9 THEN 'underperforming' ELSE 'on_track' END AS verdict
FROM (SELECT *, {r('share_pct * 100.0 / tot', 1)} AS cur, greatest({r('(share_pct + CASE WHEN roas >= blend THEN 4.0 ELSE -3.0 END) * 100.0 / tot', 1)}, 0) AS mv FROM (SELECT *, sum(revenue) OVER () / sum(spend) OVER () AS blend, sum(share_pct) OVER () AS tot FROM mix))""",
        "mix",
    ),
)
def share_recommendation(spark, sf):
    return D.share_recommendation(R.channel_mix(campaign_fact(spark, sf)))


@query("pl10_account_plans")
def account_plans(spark, sf):
    """One optimizer plan per account in the same job (the per-plan SQL check is pl10_optimizer_plan)."""
    p = Plan(spark, sf, ("account",))
    rows = P.optimizer_rows(p.stats, p.health, p.zones, p.totals, None, None, p.keys)
    return P.optimizer_plan(rows, None, None, p.keys)
