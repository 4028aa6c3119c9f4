"""Walk-forward evaluation, model comparison and calibration queries.

The scored table is exact: the safe baseline at each fold start, and the same forecast without its trend as
the challenger, in the columns ``trained_*``. No fitted model is walked forward; ``catalog.models`` has one holdout each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.operators import evaluate as E
from adtide.operators import forecast as FC
from adtide.operators import rollup as R
from adtide.operators.windows import one_step_residuals
from adtide.plans.facts import campaign_fact, item_campaign
from adtide.schema import ALT_INTERVAL_FLOOR_PCT, BLEND_CANDIDATES, INTERVAL_FLOOR_PCT
from adtide.session import checkpoint
from catalog.base import LINES, cte, div, query, r, sql
from catalog.forecasts import P6, per_h, points_sql, state_sql
from catalog.rollups import rounded

BY = ["level", "segment"]


def folds_sql(offset: int, n: int) -> str:
    return f"SELECT h, k + 1 AS k, mx - CAST(h * (k + 1) - 1 + {offset} AS INTEGER) AS start, mx - CAST(h * k + {offset} AS INTEGER) AS stop FROM (SELECT max(date) AS mx FROM fact), (SELECT unnest([30, 60, 90]) AS h), (SELECT unnest(range({n})) AS k)"


def walk_sql(folds: str, points: str) -> str:
    return f"""
SELECT p.level, p.segment, p.h, p.k, p.start, a.actual_revenue, a.actual_roas, {', '.join(f'p.{c} AS safe_{c}' for c in P6)}, p.run_rate AS trained_expected_revenue,
 greatest(p.run_rate - p.run_rate * ({per_h(ALT_INTERVAL_FLOOR_PCT)}), 0) AS trained_lower_revenue, p.run_rate + p.run_rate * ({per_h(ALT_INTERVAL_FLOOR_PCT)}) AS trained_upper_revenue,
 {', '.join(f'p.{b}_roas AS trained_{b}_roas' for b in ('expected', 'lower', 'upper'))}
FROM {points} p JOIN (SELECT f.h, f.k, s.level, s.segment, sum(revenue) AS actual_revenue, {div('sum(revenue)', 'sum(spend)')} AS actual_roas FROM seg s JOIN {folds} f ON s.date BETWEEN f.start AND f.stop GROUP BY 1, 2, 3, 4) a
 ON a.h = p.h AND a.k = p.k AND a.level = p.level AND a.segment = p.segment""".replace("CASE h ", "CASE p.h ")


for _p, _off, _n in (("", 0, 4), ("cal_", 90, 2)):
    cte(f"{_p}folds", folds_sql(_off, _n), "fact")
    cte(f"{_p}fold_res", f"SELECT f.h, f.k, f.start, s.* FROM residuals s JOIN {_p}folds f ON s.date < f.start", "residuals", f"{_p}folds")
    cte(f"{_p}fold_state", state_sql(f"{_p}fold_res", "h, k, start, "), f"{_p}fold_res")
    cte(f"{_p}fold_points", points_sql(f"{_p}fold_state", expand=False), f"{_p}fold_state")
    cte(f"{_p}scored", walk_sql(f"{_p}folds", f"{_p}fold_points"), f"{_p}fold_points", f"{_p}folds", "seg")

SCORED = ["actual_roas", *[f"safe_{p}" for p in P6], *[f"trained_{p}" for p in P6]]


def scored(spark, sf, folds=4, offset=0):
    """Checkpointed: the metrics, the sweep and the bootstrap all start from the scored rows."""
    daily = R.segment_daily(campaign_fact(spark, sf))
    base = E.walk_forward(daily, (), folds, offset)
    return checkpoint(E.with_challenger(base, F.col("_run_rate"), ALT_INTERVAL_FLOOR_PCT).drop("_run_rate"))


@query(
    "ev1_walk_forward",
    sql(f"SELECT level, segment, h AS horizon_days, CAST(k AS INTEGER) AS fold, start, actual_revenue, {', '.join(f'{r(c)} AS {c}' for c in SCORED)} FROM scored", "scored"),
)
def walk_forward(spark, sf):
    """Folds, as-of forecasts and their actuals (also jn11)."""
    df = scored(spark, sf)
    return rounded(df.select(*BY, "horizon_days", "fold", "start", "actual_revenue", *SCORED), *SCORED)


cte(
    "long",
    " UNION ALL ".join(
        f"SELECT level, segment, h AS horizon_days, k AS fold, '{m}' AS model, '{t}' AS target, actual_{t} AS actual, {m}_expected_{t} AS predicted, {m}_lower_{t} AS lo, {m}_upper_{t} AS up FROM scored"
        for m in ("trained", "safe")
        for t in ("revenue", "roas")
    ),
    "scored",
)


def metrics_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted) / greatest(abs(actual), 1.0)) * 100.0 AS mape,
 avg(CASE WHEN lo <= actual AND actual <= up THEN 1.0 ELSE 0 END) * 100.0 AS coverage, avg(greatest(up - lo, 0)) AS width, avg(greatest(up - lo, 0) / greatest(abs(predicted), 1.0)) * 100.0 AS width_pct FROM long GROUP BY {by}"""


cte("metrics", metrics_sql("horizon_days, model, target"), "long")
M = E.METRICS
MR = ", ".join(f"{r(c)} AS {c}" for c in M)


@query("ev2_error_metrics", sql(f"SELECT horizon_days, model, target, n, {MR} FROM metrics", "metrics"))
def error_metrics(spark, sf):
    return rounded(E.error_metrics(E.long_scores(scored(spark, sf)), ["horizon_days", "model", "target"]), *M)


@query("ev2_level_metrics", sql(f"SELECT horizon_days, level, model, target, n, {MR} FROM ({metrics_sql('horizon_days, level, model, target')})", "long"))
def level_metrics(spark, sf):
    return rounded(E.error_metrics(E.long_scores(scored(spark, sf)), ["horizon_days", "level", "model", "target"]), *M)


@query(
    "ev3_fold_average",
    sql(
        f"SELECT horizon_days, model, target, count(*) AS folds, {', '.join(r(f'avg({c})') + f' AS {c}' for c in M)} FROM ({metrics_sql('horizon_days, fold, model, target')}) GROUP BY 1, 2, 3",
        "long",
    ),
)
def fold_average(spark, sf):
    return rounded(E.fold_average(E.long_scores(scored(spark, sf))), *M)


U = "((b * b + b * 31 + 17) % 1000003) / 1000003.0::DOUBLE"
cte(
    "draws",
    f"""
SELECT h, rep, CASE WHEN sum(w) <> 0 THEN sum(w * delta) / sum(w) ELSE 0 END AS mean FROM (SELECT h, rep, delta, {' + '.join(f'CASE WHEN u >= {p}::DOUBLE THEN 1 ELSE 0 END' for p in E.POISSON_1)} AS w FROM (
SELECT h, rep, delta, {U} AS u FROM (SELECT h, rep, delta, (rep * 7919 + pos * 104729 + 12345) % 1000003 AS b FROM deltas, (SELECT unnest(range(2000)) AS rep)))) GROUP BY h, rep""",
    "deltas",
)
cte(
    "deltas",
    "SELECT h, abs(actual_revenue - trained_expected_revenue) - abs(actual_revenue - safe_expected_revenue) AS delta, CAST('0x' || substr(md5(level || '|' || segment || '|' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) AS pos FROM scored",
    "scored",
)
cte(
    "paired",
    """
SELECT *, CASE WHEN ci_high < 0 THEN 'trained_model' WHEN ci_low > 0 THEN 'safe_baseline_fallback' ELSE 'statistical_tie' END AS verdict FROM (
SELECT h AS horizon_days, n, observed, CASE WHEN flat THEN observed ELSE lo END AS ci_low, CASE WHEN flat THEN observed ELSE hi END AS ci_high, CASE WHEN flat THEN CASE WHEN abs(observed) <= 1e-12 THEN 1.0 ELSE 0 END ELSE least(least(pl, ph) * 2.0, 1.0) END AS p_value FROM (
SELECT o.*, d.*  EXCLUDE (h), n < 2 OR coalesce(sd, 0) <= 1e-12 AS flat FROM (SELECT h, count(*) AS n, avg(delta) AS observed, stddev_pop(delta) AS sd FROM deltas GROUP BY h) o
JOIN (SELECT h, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0 END) AS pl, avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0 END) AS ph FROM draws GROUP BY h) d USING (h)))""",
    "deltas",
    "draws",
)


@query(
    "ev4_paired_bootstrap",
    sql(f"SELECT horizon_days, n, {r('observed')} AS observed, {r('ci_low', 2)} AS ci_low, {r('ci_high', 2)} AS ci_high, {r('p_value')} AS p_value, verdict FROM paired", "paired"),
)
def paired_bootstrap(spark, sf):
    df = rounded(E.paired_bootstrap(scored(spark, sf)), "observed", "p_value")
    return rounded(df, "ci_low", "ci_high", digits=2)


MIX = "(trained_expected_revenue * w + safe_expected_revenue * (1.0 - w))"
cte(
    "sweep",
    f"""
SELECT h AS horizon_days, w AS weight, {r(f'avg(abs(actual_revenue - {MIX}))', 2)} AS mae, {r(f'sqrt(avg((actual_revenue - {MIX}) * (actual_revenue - {MIX})))', 2)} AS rmse,
 {r(f'avg(abs(actual_revenue - {MIX}) / greatest(abs(actual_revenue), 1.0)) * 100.0', 2)} AS mape FROM scored, (SELECT unnest([0.0, 0.10, 0.25, 0.40, 0.50, 0.60]::DOUBLE[]) AS w) GROUP BY 1, 2""",
    "scored",
)


@query("ev5_blend_sweep", sql("SELECT *, row_number() OVER (PARTITION BY horizon_days ORDER BY rmse, mae, mape, weight) = 1 AS is_best FROM sweep", "sweep"))
def blend_sweep(spark, sf):
    return E.blend_sweep(scored(spark, sf), BLEND_CANDIDATES)


cte(
    "champion",
    """
SELECT *, CASE WHEN n < 12 THEN 'baseline' WHEN tr THEN 'trained' WHEN sa THEN 'baseline' WHEN tie OR trained_mape < safe_mape THEN 'blend' ELSE 'baseline' END AS selected_method,
 CASE WHEN n < 12 THEN 0.0 WHEN tr THEN 0.60 WHEN sa THEN 0.0 WHEN tie THEN 0.25 WHEN trained_mape < safe_mape THEN 0.35 ELSE 0.0 END::DOUBLE AS revenue_weight
FROM (SELECT p.*, m.trained_mape, m.safe_mape, p_value < 0.05 AND ci_high < 0 AND observed < 0 AS tr, p_value < 0.05 AND ci_low > 0 AND observed > 0 AS sa,
 abs(trained_mape - safe_mape) / greatest(safe_mape, 0.01) * 100.0 <= 3.0 OR (ci_low <= 0 AND ci_high >= 0) AS tie
FROM paired p JOIN (SELECT horizon_days, max(CASE WHEN model = 'trained' THEN mape END) AS trained_mape, max(CASE WHEN model = 'safe' THEN mape END) AS safe_mape FROM metrics WHERE target = 'revenue' GROUP BY 1) m USING (horizon_days))""",
    "paired",
    "metrics",
)


@query("ev6_champion_challenger", sql(f"SELECT horizon_days, n, {r('trained_mape')} AS trained_mape, {r('safe_mape')} AS safe_mape, selected_method, revenue_weight FROM champion", "champion"))
def champion_challenger(spark, sf):
    s = scored(spark, sf)
    metrics = E.error_metrics(E.long_scores(s), ["horizon_days", "model", "target"])
    return rounded(E.champion_challenger(metrics, E.paired_bootstrap(s)), "trained_mape", "safe_mape")


cte(
    "winners",
    """
SELECT *, CASE WHEN s <> 0 THEN (t - s) / s * 100.0 ELSE 0 END AS diff, CASE WHEN abs(t - s) <= greatest(greatest(abs(t), abs(s)) * 1e-9, 1e-9) THEN 'tie' WHEN t < s THEN 'trained_model' ELSE 'safe_baseline_fallback' END AS winner
FROM (SELECT horizon_days, target, max(CASE WHEN model = 'trained' THEN mae END) AS t, max(CASE WHEN model = 'safe' THEN mae END) AS s FROM metrics GROUP BY 1, 2)""",
    "metrics",
)


@query("ev7_winner_evidence", sql(f"SELECT horizon_days, target, {r('t')} AS trained_mae, {r('s')} AS safe_mae, {r('diff')} AS mae_difference_pct, winner FROM winners", "winners"))
def winner_evidence(spark, sf):
    metrics = E.error_metrics(E.long_scores(scored(spark, sf)), ["horizon_days", "model", "target"])
    return rounded(E.winner_evidence(metrics, ["horizon_days"]), "trained_mae", "safe_mae", "mae_difference_pct")


# --- calibration ----------------------------------------------------------------------------------
cte("cal_scores", "SELECT *, abs(actual_revenue - greatest(safe_expected_revenue, 1.0)) / greatest(safe_expected_revenue, 1.0) AS score FROM cal_scored", "cal_scored")
LEVEL = "least(ceil((n + 1) * (1.0::DOUBLE - (1.0::DOUBLE - 0.9::DOUBLE))) / n, 1.0)"


def quant_sql(by: str) -> str:
    return f"SELECT {by}, max(n) AS n, max({LEVEL}) AS quantile_level, max(CASE WHEN rk = ceil({LEVEL} * (n - 1)) + 1 THEN score END) AS q FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score) AS rk, count(*) OVER (PARTITION BY {by}) AS n FROM cal_scores) GROUP BY {by}"


cte("quantiles", quant_sql("h"), "cal_scores")


def cal_scores(spark, sf):
    """Two windows per horizon before the final 90-day holdout."""
    return E.conformal_scores(scored(spark, sf, 2, 90))


@query("ev8_conformal_quantiles", sql(f"SELECT h AS horizon_days, level, n, {r('quantile_level')} AS quantile_level, {r('q', 6)} AS quantile FROM ({quant_sql('h, level')})", "cal_scores"))
def conformal_quantiles(spark, sf):
    df = E.conformal_quantiles(cal_scores(spark, sf), ["horizon_days", "level"])
    return rounded(rounded(df, "quantile_level"), "quantile", digits=6)


@query(
    "ev8_conformal_calibration",
    sql(
        f"""SELECT h AS horizon_days, {r('f')} AS floor_pct, {r('m')} AS multiplier, {r('m * 1.25')} AS low_sample_multiplier FROM (
SELECT unnest([30, 60, 90]) AS h, unnest([f30, f60, f90]) AS f, unnest([2.5, m60, greatest(m60, greatest(f90 / sqrt(3.0) / f30, 1.0))]) AS m FROM (
SELECT *, greatest(2.5, greatest(f60 / sqrt(2.0) / f30, 1.0)) AS m60 FROM (SELECT *, greatest(q90, f60 + 0.005) AS f90 FROM (SELECT *, greatest(q60, f30 + 0.005) AS f60 FROM (
SELECT greatest(max(CASE WHEN h = 30 THEN q END), 0.01) AS f30, greatest(max(CASE WHEN h = 60 THEN q END), 0.01) AS q60, greatest(max(CASE WHEN h = 90 THEN q END), 0.01) AS q90 FROM quantiles)))))""",
        "quantiles",
    ),
)
def conformal_calibration(spark, sf):
    return E.calibration(E.conformal_quantiles(cal_scores(spark, sf), ["horizon_days"]))


def floor_q(t) -> str:
    return per_h(t)


@query(
    "ev9_interval_profile_compare",
    sql(
        f"""SELECT h AS horizon_days, method, count(*) AS n, {r('avg(CASE WHEN score <= fl THEN 1.0 ELSE 0 END) * 100.0')} AS coverage_pct, {r('max(fl) * 200.0')} AS mean_width_pct FROM (
SELECT h, score, 'residual_conformal' AS method, CAST({floor_q(INTERVAL_FLOOR_PCT)} AS DOUBLE) AS fl FROM cal_scores UNION ALL SELECT h, score, 'cv_quantile_conformal', CAST({floor_q(ALT_INTERVAL_FLOOR_PCT)} AS DOUBLE) FROM cal_scores) GROUP BY 1, 2""",
        "cal_scores",
    ),
)
def interval_profile_compare(spark, sf):
    return rounded(E.interval_profiles(cal_scores(spark, sf)), "coverage_pct", "mean_width_pct")


cte(
    "zcal",
    f"""SELECT level, segment, n, CASE WHEN n >= 8 AND sd > 1e-9 THEN {r('least(greatest(q, 0.75), 1.65)')} ELSE 1.0 END AS z FROM (
SELECT level, segment, max(n) AS n, max(sd) AS sd, quantile_cont(abs((e - m) / sd), 0.72) AS q FROM (SELECT level, segment, revenue_residual AS e, avg(revenue_residual) OVER w AS m, stddev_samp(revenue_residual) OVER w AS sd, count(*) OVER w AS n
 FROM residuals WHERE revenue_residual IS NOT NULL WINDOW w AS (PARTITION BY level, segment)) GROUP BY 1, 2)""",
    "residuals",
)


@query("ev10_z_calibration", sql("SELECT * FROM zcal", "zcal"))
def z_calibration(spark, sf):
    return E.z_calibration(one_step_residuals(R.segment_daily(campaign_fact(spark, sf)), BY), BY)


cte("item_lines", LINES.replace("p.p_brand AS", "'item ' || CAST(p.p_partkey AS VARCHAR) AS"))
cte("item_fact", "SELECT date, channel, campaign_type, campaign_name, sum(revenue) AS revenue FROM item_lines GROUP BY ALL", "item_lines")
cte("thin", "SELECT campaign_name, arg_max(channel, strftime(date, '%Y-%m-%d') || channel) AS channel FROM item_fact GROUP BY 1 HAVING count(*) < 30", "item_fact")
cte(
    "item_residuals",
    """
SELECT level, segment, revenue - avg(revenue) OVER (PARTITION BY level, segment ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS e FROM (
 SELECT 'campaign' AS level, campaign_name AS segment, date, sum(revenue) AS revenue FROM item_fact GROUP BY ALL
 UNION ALL SELECT 'channel', channel, date, sum(revenue) FROM item_fact GROUP BY ALL)""",
    "item_fact",
)
cte(
    "pool",
    """
SELECT t.campaign_name AS segment, r.e FROM thin t JOIN item_residuals r ON (r.level = 'campaign' AND r.segment = t.campaign_name) WHERE r.e IS NOT NULL
UNION ALL SELECT t.campaign_name, r.e FROM thin t JOIN item_residuals r ON (r.level = 'channel' AND r.segment = t.channel) WHERE r.e IS NOT NULL""",
    "thin",
    "item_residuals",
)


@query(
    "jn8_parent_channel_pool",
    sql(
        f"""SELECT s.segment, max(s.n) AS n, {r('max(s.total)', 2)} AS total, CASE WHEN max(s.n) >= 8 AND max(s.sd) > 1e-9 THEN {r('least(greatest(quantile_cont(abs((p.e - s.m) / s.sd), 0.72), 0.75), 1.65)')} ELSE 0 END AS z
FROM pool p JOIN (SELECT segment, count(*) AS n, sum(e) AS total, avg(e) AS m, stddev_samp(e) AS sd FROM pool GROUP BY 1) s USING (segment) GROUP BY 1""",
        "pool",
    ),
)
def parent_channel_pool(spark, sf):
    """Every part as a campaign, so that about half of the campaigns have fewer than 30 rows."""
    fact = campaign_fact(spark, sf, campaign=item_campaign())
    return rounded(E.parent_channel_pool(fact, one_step_residuals(R.segment_daily(fact), BY)), "total", digits=2)


@query(
    "ev11_path_consistency",
    sql(
        f"""SELECT level, segment, {r('abs(a - b) / greatest(abs(b), 1.0) * 100.0')} AS gap_pct, {"CASE WHEN (a - base) / base > 0.03 THEN 'up' WHEN (a - base) / base < -0.03 THEN 'down' ELSE 'flat' END"} AS direction_a,
 {"CASE WHEN (b - base) / base > 0.03 THEN 'up' WHEN (b - base) / base < -0.03 THEN 'down' ELSE 'flat' END"} AS direction_b
FROM (SELECT p.level, p.segment, p.run_rate AS base, p.expected_revenue AS a, t.projected AS b FROM points p JOIN trend_totals t ON t.level = p.level AND t.segment = p.segment AND t.horizon_days = 30 WHERE p.h = 30)""",
        "points",
        "trend_totals",
    ),
)
def path_consistency(spark, sf):
    """The run-rate path against the compounded-trend path at 30 days."""
    series = R.segment_daily(campaign_fact(spark, sf))
    left = FC.baseline_points(FC.segment_state(series)).filter(F.col("horizon_days") == 30)
    left = left.select(*BY, F.col("run_rate_revenue").alias("baseline"), "expected_revenue")
    right = FC.trend_projection(series, BY, (30,)).withColumnRenamed("projected", "expected_revenue")
    return rounded(E.path_consistency(left, right, BY), "gap_pct")


VT = [f"{m}_{c}" for m in ("trained", "safe") for c in ("mae", "mape", "coverage", "width_pct")]


@query(
    "ev12_validation_table",
    sql(
        "SELECT horizon_days, n, winner, " + ", ".join(f"{r(c)} AS {c}" for c in VT) + " FROM (SELECT horizon_days, max(n) AS n, "
        + ", ".join(f"max(CASE WHEN model = '{m}' THEN {c} END) AS {m}_{c}" for m in ("trained", "safe") for c in ("mae", "mape", "coverage", "width_pct"))
        + " FROM metrics WHERE target = 'revenue' GROUP BY 1) JOIN (SELECT horizon_days, winner FROM winners WHERE target = 'revenue') USING (horizon_days)",
        "metrics",
        "winners",
    ),
)
def validation_table(spark, sf):
    metrics = E.error_metrics(E.long_scores(scored(spark, sf)), ["horizon_days", "model", "target"])
    return rounded(E.validation_table(metrics, E.winner_evidence(metrics, ["horizon_days"])), *VT)
