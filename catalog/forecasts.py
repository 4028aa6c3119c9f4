"""Run-rate forecasts and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.functions.exprs import clean_number
from adtide.operators import forecast as FC
from adtide.operators import rollup as R
from adtide.plans.facts import campaign_fact
from adtide.schema import HORIZON_Z, HORIZONS, INTERVAL_FLOOR_PCT
from catalog.base import clampq, clean, cte, div, query, r, sql
from catalog.rollups import rounded

BY = ["level", "segment"]


def per_h(table) -> str:
    return "CASE h " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + " END"


def state_sql(res: str, key: str = "") -> str:
    p = f"{key}level, segment"
    return f"""
SELECT {p}, max(n) AS history_days, max(date) AS last_date,
 sum(CASE WHEN rn <= span THEN revenue ELSE 0 END) AS revenue_28, sum(CASE WHEN rn <= span THEN spend ELSE 0 END) AS spend_28,
 coalesce(avg(CASE WHEN rn <= span AND rn > span - mid THEN revenue END), 0) AS f, coalesce(avg(CASE WHEN rn <= span - mid THEN revenue END), 0) AS s,
 coalesce(CASE WHEN max(n) >= 3 THEN coalesce(stddev_samp(revenue_residual), stddev_samp(revenue)) ELSE stddev_pop(revenue) END, 0) AS revenue_sd,
 count(roas_residual) AS roas_n, coalesce(stddev_samp(roas_residual), 0) AS roas_sd
FROM (SELECT *, least(n, 28) AS span, greatest(least(n, 28) // 2, 1) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY date DESC) AS rn,
 count(*) OVER (PARTITION BY {p}) AS n FROM {res})) GROUP BY {p}"""


cte("state", state_sql("residuals"), "residuals")
cte(
    "account_residuals",
    """
SELECT a.*, a.revenue - avg(a.revenue) OVER (PARTITION BY account, level, segment ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS revenue_residual, p.roas_residual
FROM account_seg a LEFT JOIN (SELECT account, level, segment, date, revenue / spend - avg(revenue / spend) OVER (PARTITION BY account, level, segment ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roas_residual
 FROM account_seg WHERE spend > 1e-9) p USING (account, level, segment, date)""",
    "account_seg",
)
cte("account_state", state_sql("account_residuals", "account, "), "account_residuals")


def points_sql(state: str, planned: bool = False, expand: bool = True) -> str:
    """Unrounded baseline centre and bounds per segment and horizon."""
    spend = "historical_spend" if not planned else "greatest(CASE WHEN coalesce(has_budget, false) THEN planned_daily_spend * h ELSE historical_spend END, 0)"
    scale = "CASE WHEN historical_spend > 0 THEN expected_spend / historical_spend ELSE 1.0 END"
    response = (
        "1.0"
        if not planned
        else f"CASE WHEN {scale} <= 0 THEN 0 WHEN {scale} < 1 THEN least(pow({scale}, 0.72), ({scale}) * 1.35) WHEN {scale} <= 1.5 THEN {scale} "
        f"ELSE ({scale} - 1.5) * pow(({scale}) / 1.5, -0.45) + 1.5 END"
    )
    base = f"SELECT x.*, revenue_28 / least(history_days, 28) * h AS run_rate, spend_28 / least(history_days, 28) * h AS historical_spend, "
    base += "least(greatest((CASE WHEN history_days < 4 OR f <= 0 THEN 0 ELSE least(greatest((s - f) / f, -0.25), 0.25) END) * 0.35 * least(h / 90.0, 1.0) + 1.0, 0.65), 1.35) AS trend_multiplier "
    base += f"FROM (SELECT st.*{', unnest([30, 60, 90]) AS h' if expand else ''} FROM {state} st) x"
    if planned:
        base = f"SELECT b.*, p.planned_daily_spend, p.has_budget FROM ({base}) b LEFT JOIN planned p ON p.level = b.level AND p.segment = b.segment"
    return f"""
SELECT *, CASE WHEN expected_spend > 1e-9 THEN centre ELSE 0 END AS expected_roas,
 CASE WHEN expected_spend > 1e-9 THEN greatest(centre - margin, 0) ELSE 0 END AS lower_roas,
 CASE WHEN expected_spend > 1e-9 THEN centre + margin ELSE 0 END AS upper_roas FROM (
SELECT *, greatest(expected_revenue - interval_half, 0) AS lower_revenue, expected_revenue + interval_half AS upper_revenue,
 greatest(CASE WHEN roas_n >= 3 THEN ({per_h(HORIZON_Z)}) * roas_sd * sqrt(h / 30.0) ELSE 0 END, centre * least(greatest(({per_h(INTERVAL_FLOOR_PCT)}) * 0.45, 0.035), 0.30), CASE WHEN centre > 0 THEN 0.02 ELSE 0 END) AS margin FROM (
SELECT *, greatest({div('expected_revenue', 'expected_spend')}, 0) AS centre,
 greatest(({per_h(HORIZON_Z)}) * revenue_sd * sqrt(h), expected_revenue * ({per_h(INTERVAL_FLOOR_PCT)})) AS interval_half FROM (
SELECT *, greatest(run_rate * trend_multiplier * ({response}), 0) AS expected_revenue FROM (
SELECT *, {spend} AS expected_spend FROM ({base})))))"""


P6 = ["expected_revenue", "lower_revenue", "upper_revenue", "expected_roas", "lower_roas", "upper_roas"]


def monotone_sql(points: str, key: str = "", model: str = "'safe_baseline_fallback'") -> str:
    """Rounding, ROAS repair and strict widening over the three horizons."""
    p = f"{key}level, segment"
    pivot = ", ".join(f"max(CASE WHEN h = {h} THEN {clean(c)} END) AS {c}_{h}" for h in HORIZONS for c in P6)
    q = f"SELECT {p}, 0.0 AS w_0, {pivot} FROM ({points}) GROUP BY {p}"
    prev = "w_0"
    for h in HORIZONS:
        e, lo, up = f"expected_revenue_{h}", f"lower_revenue_{h}", f"upper_revenue_{h}"
        q = f"SELECT *, {prev} + CASE WHEN {prev} > 0 THEN 2.0 ELSE 0 END AS t_{h}, {div(f'{up} - {lo}', e)} * 100.0 AS p_{h} FROM ({q})"
        q = f"SELECT *, {e} > 0 AND p_{h} < t_{h} AS wd_{h}, t_{h} / 100.0 * {e} AS nd_{h}, ({up} + {lo}) / 2.0 AS md_{h} FROM ({q})"
        q = f"SELECT *, least(greatest(md_{h} - nd_{h} / 2.0, 0), {e}) AS nl_{h}, greatest(md_{h} + nd_{h} / 2.0, {e}) AS nq_{h} FROM ({q})"
        q = f"SELECT *, CASE WHEN nq_{h} - nl_{h} < nd_{h} THEN nl_{h} + nd_{h} ELSE nq_{h} END AS nu_{h} FROM ({q})"
        q = f"SELECT *, CASE WHEN wd_{h} THEN {div(f'nu_{h} - nl_{h}', e)} * 100.0 WHEN {e} > 0 THEN p_{h} ELSE 0 END AS a_{h} FROM ({q})"
        q = f"SELECT *, greatest({prev}, a_{h}) AS w_{h} FROM ({q})"
        prev = f"w_{h}"
    outs = " UNION ALL ".join(
        f"""SELECT {p}, {h} AS horizon_days, expected_revenue_{h} AS expected_revenue,
 CASE WHEN wd_{h} THEN {clean(f'nl_{h}')} ELSE lower_revenue_{h} END AS lower_revenue, CASE WHEN wd_{h} THEN {clean(f'nu_{h}')} ELSE upper_revenue_{h} END AS upper_revenue,
 expected_roas_{h} AS expected_roas, least(lower_roas_{h}, expected_roas_{h}) AS lower_roas, greatest(upper_roas_{h}, expected_roas_{h}) AS upper_roas,
 {model} AS model_type, {clean(f'a_{h}')} AS interval_width_pct FROM mono"""
        for h in HORIZONS
    )
    return f"""WITH mono AS ({q}) SELECT *, CASE WHEN (expected_roas <= 0 AND lower_roas <= 0 AND upper_roas <= 0) OR expected_revenue <= 0 THEN 'not_computable'
 WHEN interval_width_pct <= 30 THEN 'high' WHEN interval_width_pct <= 60 THEN 'medium' ELSE 'low' END AS forecast_confidence FROM ({outs})"""


cte("points", points_sql("state"), "state")
cte("predictions", monotone_sql("SELECT * FROM points"), "points")
cte("account_predictions", monotone_sql(points_sql("account_state"), "account, "), "account_state")


@query("fc1_baseline_forecast", sql("SELECT level, segment, h AS horizon_days, " + ", ".join(f"{clean(c)} AS {c}" for c in P6) + " FROM points", "points"))
def baseline_points(spark, sf):
    state = FC.segment_state(R.segment_daily(campaign_fact(spark, sf)))
    df = FC.baseline_points(state)
    return df.select("level", "segment", "horizon_days", *[clean_number(c).alias(c) for c in FC.POINTS])


@query("fc3_revenue_interval", sql(f"SELECT level, segment, h AS horizon_days, {r('interval_half')} AS \"interval\" FROM points", "points"))
def revenue_interval(spark, sf):
    df = FC.baseline_points(FC.segment_state(R.segment_daily(campaign_fact(spark, sf))))
    return rounded(df.select("level", "segment", "horizon_days", "interval"), "interval")


@query("fc4_roas_interval", sql(f"SELECT level, segment, h AS horizon_days, {r('lower_roas')} AS lower_roas, {r('upper_roas')} AS upper_roas FROM points", "points"))
def roas_interval(spark, sf):
    df = FC.baseline_points(FC.segment_state(R.segment_daily(campaign_fact(spark, sf))))
    return rounded(df.select("level", "segment", "horizon_days", "lower_roas", "upper_roas"), "lower_roas", "upper_roas")


@query("fc12_baseline_predictions", sql("SELECT * FROM predictions", "predictions"))
def baseline_predictions(spark, sf):
    return FC.baseline_forecast(campaign_fact(spark, sf))


@query("fc12_account_predictions", sql("SELECT * FROM account_predictions", "account_predictions"))
def account_predictions(spark, sf):
    return FC.baseline_forecast(campaign_fact(spark, sf, ("account",)), ("account",))


@query(
    "fc21_roas_from_revenue_bounds",
    sql(
        f"""SELECT level, segment, h AS horizon_days, CASE WHEN expected_spend > 1e-9 THEN {r(div('lower_revenue', 'expected_spend'))} ELSE 0 END AS lower_roas,
 CASE WHEN expected_spend > 1e-9 THEN {r(div('expected_revenue', 'expected_spend'))} ELSE 0 END AS expected_roas,
 CASE WHEN expected_spend > 1e-9 THEN {r(div('upper_revenue', 'expected_spend'))} ELSE 0 END AS upper_roas FROM points""",
        "points",
    ),
)
def roas_from_revenue(spark, sf):
    df = FC.roas_from_revenue_bounds(FC.baseline_points(FC.segment_state(R.segment_daily(campaign_fact(spark, sf)))))
    return rounded(df.select("level", "segment", "horizon_days", "lower_roas", "expected_roas", "upper_roas"), "lower_roas", "expected_roas", "upper_roas")


cte(
    "budgets",
    "SELECT channel, floor(recent_spend * (0.4 + 0.5 * row_number() OVER (ORDER BY channel)) + 0.5) AS budget FROM summary WHERE channel <> 'HOUSEHOLD'",
    "summary",
)
cte(
    "planned",
    """
SELECT level, segment, sum(CASE WHEN budget IS NULL THEN daily_spend ELSE budget / 30.0 END) AS planned_daily_spend, bool_or(budget IS NOT NULL) AS has_budget FROM (
SELECT level, segment, channel, sum(spend) / count(*) AS daily_spend FROM (
 SELECT *, row_number() OVER (PARTITION BY level, segment, channel ORDER BY date DESC) AS rn FROM (
  SELECT 'overall' AS level, 'all' AS segment, channel, date, spend FROM chan UNION ALL SELECT 'channel', channel, channel, date, spend FROM chan
  UNION ALL SELECT 'campaign_type', campaign_type, channel, date, sum(spend) FROM fact GROUP BY campaign_type, channel, date
  UNION ALL SELECT 'campaign', campaign_name, channel, date, sum(spend) FROM fact GROUP BY campaign_name, channel, date)) WHERE rn <= 7 GROUP BY 1, 2, 3) a
LEFT JOIN budgets b USING (channel) GROUP BY level, segment""",
    "chan",
    "budgets",
)


cte("budget_predictions", monotone_sql(points_sql("state", planned=True)), "state", "planned")


def demo_budgets(fact, keys=()):
    """30-day channel budgets derived from the facts; one channel stays without a budget."""
    from pyspark.sql import Window

    summary = R.channel_summary(fact, keys).filter(F.col("channel") != "HOUSEHOLD")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("channel"))
    return summary.select(*keys, "channel", F.floor(F.col("recent_spend") * (rank * 0.5 + 0.4) + 0.5).cast("double").alias("budget"))


@query("fc2_planned_spend", sql(f"SELECT level, segment, {r('planned_daily_spend')} AS planned_daily_spend, has_budget FROM planned", "planned"))
def planned_spend(spark, sf):
    fact = campaign_fact(spark, sf)
    return rounded(FC.planned_spend(fact, demo_budgets(fact)), "planned_daily_spend")


@query("fc12_budget_predictions", sql("SELECT * FROM budget_predictions", "budget_predictions"))
def budget_predictions(spark, sf):
    fact = campaign_fact(spark, sf)
    return FC.baseline_forecast(fact, (), demo_budgets(fact))


def projection_sql(col: str) -> str:
    return f"""
SELECT level, segment, last_date, start, recent_sd, least(greatest((CASE WHEN coalesce(prior_mean, start) > 0 THEN (start - coalesce(prior_mean, start)) / coalesce(prior_mean, start) ELSE 0 END) / n_recent, -0.015), 0.015) AS daily_trend
FROM (SELECT *, CASE WHEN recent_mean <> 0 THEN recent_mean ELSE all_mean END AS start, CASE WHEN n_recent < 2 THEN abs(recent_mean) * 0.1 ELSE sd END AS recent_sd FROM (
 SELECT level, segment, max(date) AS last_date, avg(CASE WHEN rn <= 30 THEN {col} END) AS recent_mean, avg({col}) AS all_mean, avg(CASE WHEN rn BETWEEN 31 AND 60 THEN {col} END) AS prior_mean,
  count(CASE WHEN rn <= 30 THEN 1 END) AS n_recent, stddev_samp(CASE WHEN rn <= 30 THEN {col} END) AS sd
 FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn FROM seg) GROUP BY level, segment))"""


cte("projection", projection_sql("revenue"), "seg")
cte(
    "trend_totals",
    """
SELECT level, segment, h AS horizon_days, sum(greatest(start * pow(1 + daily_trend, k), 0)) AS projected, max(recent_sd) AS recent_sd
FROM projection, (SELECT unnest([30, 60, 90]) AS h), (SELECT unnest(range(1, 91)) AS k) WHERE k <= h GROUP BY 1, 2, 3""",
    "projection",
)


@query(
    "fc13_trend_projection",
    sql(
        f"SELECT level, segment, horizon_days, {r('projected', 2)} AS projected, {r('greatest(projected * 0.12, recent_sd * 1.96 * sqrt(horizon_days))', 2)} AS margin FROM trend_totals",
        "trend_totals",
    ),
)
def trend_projection(spark, sf):
    return rounded(FC.trend_projection(R.segment_daily(campaign_fact(spark, sf)), BY), "projected", "margin", digits=2)


@query(
    "fc13_trend_points",
    sql(
        f"SELECT level, segment, date_add(last_date, CAST(k AS INTEGER)) AS date, {r('greatest(start * pow(1 + daily_trend, k), 0)')} AS value FROM projection, (SELECT unnest(range(1, 31)) AS k)",
        "projection",
    ),
)
def trend_points(spark, sf):
    state = FC.projection_state(R.segment_daily(campaign_fact(spark, sf)), BY, "revenue")
    return rounded(FC.trend_points(state, 30).select("level", "segment", "date", "value"), "value")


cte(
    "flat_points",
    """
SELECT level, segment, date_add(last_date, CAST(k AS INTEGER)) AS date, k, greatest(mean, 0) AS value, greatest(mean - margin, 0) AS lower, greatest(mean + margin, 0) AS upper FROM (
SELECT *, greatest(sd, mean * 0.08) * 1.96 * sqrt(k / 30.0 + 1.0) AS margin FROM (
SELECT level, segment, max(date) AS last_date, avg(revenue) AS mean, coalesce(stddev_samp(revenue), 0) AS sd FROM last28 GROUP BY 1, 2), (SELECT unnest(range(1, 31)) AS k))""",
    "last28",
)


@query("fc14_flat_projection", sql(f'SELECT level, segment, date, {r("value")} AS value, {r("lower")} AS "lower", {r("upper")} AS "upper" FROM flat_points', "flat_points"))
def flat_projection(spark, sf):
    return rounded(FC.flat_projection(R.segment_daily(campaign_fact(spark, sf)), BY, 30), "value", "lower", "upper")


EXOG = ["spend", "clicks", "impressions", "conversions"]
cte("means28", "SELECT level, segment, max(date) AS last_date, " + ", ".join(f"avg({m}) AS m_{m}" for m in EXOG) + " FROM last28 GROUP BY 1, 2", "last28")


@query(
    "fc15_project_exogenous",
    sql(
        "SELECT m.level, m.segment, date_add(m.last_date, CAST(k AS INTEGER)) AS date, "
        + ", ".join(r(f"greatest(m_{c} * spend_factor, 0)") + f" AS {c}" for c in EXOG)
        + " FROM means28 m, (SELECT unnest(range(1, 31)) AS k) JOIN dow_profile p ON p.level = m.level AND p.segment = m.segment AND p.weekday = isodow(date_add(m.last_date, CAST(k AS INTEGER))) - 1",
        "means28",
        "dow_profile",
    ),
)
def project_exogenous(spark, sf):
    return rounded(FC.project_exogenous(R.segment_daily(campaign_fact(spark, sf)), BY, 30), *EXOG)


@query(
    "fc20_prediction_cap",
    sql(
        f"SELECT level, segment, {r('greatest(avg(revenue) * 1.08, avg(revenue) + coalesce(stddev_samp(revenue), avg(revenue) * 0.2), 1.0)')} AS revenue_cap, "
        f"{r('greatest(avg(roas) * 1.15, avg(roas) + coalesce(stddev_samp(roas), avg(roas) * 0.2), 1.0)')} AS roas_cap FROM last28 GROUP BY 1, 2",
        "last28",
    ),
)
def prediction_cap(spark, sf):
    return rounded(FC.prediction_cap(R.segment_daily(campaign_fact(spark, sf)), BY), "revenue_cap", "roas_cap")


FIT = ["mae", "rmse", "mape", "r2", "coverage"]
cte(
    "fit",
    """SELECT level, segment, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e) / greatest(abs(revenue), 1.0)) * 100.0 AS mape, 1.0 - avg(e * e) / var_pop(revenue) AS r2,
 avg(CASE WHEN abs(e) <= sd * 1.96 THEN 1.0 ELSE 0 END) * 100.0 AS coverage FROM (SELECT *, revenue_residual AS e, stddev_samp(revenue_residual) OVER (PARTITION BY level, segment) AS sd FROM residuals WHERE revenue_residual IS NOT NULL) GROUP BY 1, 2""",
    "residuals",
)


@query("fc16_fit_metrics", sql("SELECT level, segment, " + ", ".join(f"{r(c)} AS {c}" for c in FIT) + " FROM fit", "fit"))
def fit_metrics(spark, sf):
    return rounded(FC.fit_metrics(R.segment_daily(campaign_fact(spark, sf)), BY), *FIT)


cte(
    "last_trends",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY level, segment) AS n FROM half_trends) WHERE rn = 1",
    "half_trends",
)


@query(
    "fc19_forecast_signals",
    sql(
        f"""SELECT p.level, p.segment, p.horizon_days, t.n AS history_days, {r('t.revenue_trend_28 * 100.0')} AS revenue_trend_pct, {r('t.spend_trend_28 * 100.0')} AS spend_trend_pct, {r('q.m')} AS roas_mean, {r(div('q.sd', 'q.m') + ' * 100.0')} AS roas_cv_pct,
 month(date_add(t.date, p.horizon_days)) AS end_month, isodow(date_add(t.date, p.horizon_days)) - 1 AS end_weekday,
 concat_ws(',', 'baseline_model', CASE WHEN t.n < 30 THEN 'short_history' WHEN t.n >= 90 THEN 'long_history' ELSE 'moderate_history' END, CASE WHEN p.horizon_days >= 90 THEN 'horizon_90' WHEN p.horizon_days >= 60 THEN 'horizon_60' END,
  CASE WHEN p.interval_width_pct >= 90 THEN 'wide_interval' WHEN p.interval_width_pct <= 70 THEN 'tight_interval' ELSE 'moderate_interval' END) AS reasons
FROM predictions p JOIN last_trends t USING (level, segment) JOIN (SELECT level, segment, avg(CASE WHEN spend > 0 THEN roas END) AS m, stddev_pop(CASE WHEN spend > 0 THEN roas END) AS sd FROM last28 GROUP BY 1, 2) q USING (level, segment)""",
        "predictions",
        "last_trends",
        "last28",
    ),
)
def forecast_signals(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf))
    state = FC.baseline_points(FC.segment_state(series)).withColumn("model_type", F.lit("safe_baseline_fallback"))
    rows = FC.sanitize_monotone(state.withColumns({p: clean_number(p) for p in FC.POINTS}))
    out = FC.forecast_signals(series, rows).withColumn("reasons", F.array_join("reasons", ","))
    return rounded(out, "revenue_trend_pct", "spend_trend_pct", "roas_mean", "roas_cv_pct")


@query(
    "set6_history_plus_forecast",
    sql(
        f"""SELECT level, segment, date, revenue AS historical, CASE WHEN rn = 1 THEN revenue END AS forecast, CASE WHEN rn = 1 THEN revenue END AS "lower", CASE WHEN rn = 1 THEN revenue END AS "upper"
FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn FROM seg) WHERE rn <= 60 UNION ALL SELECT level, segment, date, NULL, {r('value')}, {r('lower')}, {r('upper')} FROM flat_points""",
        "seg",
        "flat_points",
    ),
)
def history_plus_forecast(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf))
    points = rounded(FC.flat_projection(series, BY, 30), "value", "lower", "upper")
    return FC.history_plus_forecast(series, points, BY)


@query(
    "agg15_daily_trend_across_channels",
    sql(f'SELECT date, {r("sum(value)")} AS value, {r("sum(lower)")} AS "lower", {r("sum(upper)")} AS "upper" FROM flat_points WHERE level = \'channel\' GROUP BY date', "flat_points"),
)
def daily_trend_across(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf)).filter(F.col("level") == "channel")
    return rounded(FC.daily_trend_across(FC.flat_projection(series, BY, 30)), "value", "lower", "upper")


@query(
    "jn10_historical_vs_forecast",
    sql(
        f"""SELECT level, segment, horizon_days, historical_revenue, {r('historical_roas')} AS historical_roas, expected_revenue, expected_roas, {r(div('expected_revenue - historical_revenue', 'historical_revenue') + ' * 100.0')} AS revenue_change_pct
FROM (SELECT level, segment, h AS horizon_days, sum(revenue) AS historical_revenue, {div('sum(revenue)', 'sum(spend)')} AS historical_roas FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn FROM seg), (SELECT unnest([30, 60, 90]) AS h) WHERE rn <= h GROUP BY 1, 2, 3)
 FULL JOIN predictions USING (level, segment, horizon_days)""",
        "seg",
        "predictions",
    ),
)
def historical_vs_forecast(spark, sf):
    fact = campaign_fact(spark, sf)
    out = FC.historical_vs_forecast(R.segment_daily(fact), FC.baseline_forecast(fact))
    return rounded(out, "historical_roas", "revenue_change_pct")


@query("agg17_model_type_counts", sql("SELECT model_type, count(*) AS n FROM predictions GROUP BY 1", "predictions"))
def model_type_counts(spark, sf):
    return R.count_by(FC.baseline_forecast(campaign_fact(spark, sf)), "model_type")


@query("fn11_confidence_labels", sql("SELECT level, horizon_days, forecast_confidence, count(*) AS n FROM predictions GROUP BY 1, 2, 3", "predictions"))
def confidence_labels(spark, sf):
    rows = FC.baseline_forecast(campaign_fact(spark, sf))
    return rows.groupBy("level", "horizon_days", "forecast_confidence").agg(F.count("*").alias("n"))


@query(
    "pl21_business_brief_flags",
    sql(
        f"""SELECT level, segment, concat_ws(',', CASE WHEN revenue_trend_pct < -5 THEN 'revenue_down' END, CASE WHEN roas_trend_pct < -5 THEN 'roas_down' END, CASE WHEN width > 35 THEN 'wide_interval' END, CASE WHEN mape > 20 THEN 'model_error' END) AS risks,
 concat_ws(',', CASE WHEN revenue_trend_pct > 5 THEN 'revenue_up' END, CASE WHEN roas_trend_pct > 5 THEN 'roas_up' END, CASE WHEN width <= 25 AND mape <= 15 THEN 'contained_uncertainty' END) AS opportunities
FROM (SELECT *, {div('upper_revenue - lower_revenue', 'expected_revenue')} * 100.0 AS width FROM recent_prev JOIN (SELECT * FROM predictions WHERE horizon_days = 30) USING (level, segment) JOIN fit USING (level, segment))""",
        "recent_prev",
        "predictions",
        "fit",
    ),
)
def business_brief_flags(spark, sf):
    from adtide.operators.decisions import business_flags

    fact = campaign_fact(spark, sf)
    series = R.segment_daily(fact)
    fit = FC.fit_metrics(series, BY).select(*BY, F.col("mape").alias("revenue_mape"), F.col("mape").alias("roas_mape"))
    ahead = FC.baseline_forecast(fact).filter(F.col("horizon_days") == 30).select(*BY, "expected_revenue", "lower_revenue", "upper_revenue")
    return business_flags(R.recent_vs_previous(series, BY), ahead, fit, BY)
