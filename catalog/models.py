"""Feature, training and blending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.functions.exprs import round_to
from adtide.operators import evaluate as E
from adtide.operators import features as X
from adtide.operators import rollup as R
from adtide.operators import training as T
from adtide.operators.forecast import planned_spend, segment_state
from adtide.operators.windows import one_step_residuals
from adtide.plans.facts import campaign_fact, table
from adtide.schema import BLEND_CANDIDATES, HORIZONS, INTERVAL_FLOOR_PCT, INTERVAL_MULTIPLIER, HORIZON_Z, LEVEL_INTERVAL_FACTOR, BASELINE_ANCHORED_SCALE, LONG_HORIZON_SCALE
from adtide.session import checkpoint
from catalog.base import clean, cte, div, query, r, sql
from catalog.forecasts import demo_budgets, per_h
from catalog.rollups import rounded

BY = ["level", "segment"]
PB = "PARTITION BY level, segment ORDER BY date"
WIDTHS = (7, 14, 28, 56)
MEAS = ("spend", "clicks", "impressions", "conversions", "revenue")

cte(
    "trail",
    "SELECT s.level, s.segment, s.date, s.spend, s.revenue, row_number() OVER w AS n, "
    + ", ".join(f"sum(s.{m}) OVER (PARTITION BY s.level, s.segment ORDER BY s.date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {m}_{k}" for k in WIDTHS for m in MEAS)
    + ", " + ", ".join(f"t.{c}_trend_{k}" for k in (28, 56) for c in ("spend", "revenue", "roas"))
    + """, CASE WHEN s.level = 'channel' THEN s.segment ELSE l.last_channel END AS ref_channel, CASE WHEN s.level = 'campaign_type' THEN s.segment ELSE l.last_type END AS ref_type,
 sum(coalesce(f.k, 0)) OVER (PARTITION BY s.level, s.segment ORDER BY s.date) AS unique_campaigns,
"""
    + ", ".join(
        f"CASE WHEN row_number() OVER w >= {m} THEN coalesce(stddev_samp(s.{c}) OVER (PARTITION BY s.level, s.segment ORDER BY s.date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) ELSE 0 END AS {n}"
        for n, c, k, m in (("rev_std_14", "revenue", 14, 4), ("rev_std_28", "revenue", 28, 7), ("rev_std_56", "revenue", 56, 14), ("roas_std_56", "roas", 56, 14))
    )
    + " FROM seg s JOIN half_trends t ON t.level = s.level AND t.segment = s.segment AND t.date = s.date JOIN seg_last l ON l.level = s.level AND l.segment = s.segment AND l.date = s.date "
    "LEFT JOIN (SELECT level, segment, date, count(*) AS k FROM (SELECT level, segment, campaign_name, min(date) AS date FROM seg_rows GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) f ON f.level = s.level AND f.segment = s.segment AND f.date = s.date "
    "WINDOW w AS (PARTITION BY s.level, s.segment ORDER BY s.date)",
    "seg",
    "half_trends",
    "seg_last",
    "seg_rows",
)
cte(
    "seg_rows",
    "SELECT 'overall' AS level, 'all' AS segment, * FROM fact UNION ALL SELECT 'channel', channel, * FROM fact UNION ALL SELECT 'campaign_type', campaign_type, * FROM fact UNION ALL SELECT 'campaign', campaign_name, * FROM fact",
    "fact",
)
cte("seg_last", "SELECT level, segment, date, max(channel) AS last_channel, max(campaign_type) AS last_type FROM seg_rows GROUP BY 1, 2, 3", "seg_rows")
cte(
    "referenced",
    """
SELECT a.*, o.spend_28 AS all_28, o.spend_56 AS all_56, c.spend_28 AS ch_28, c.spend_56 AS ch_56, c.revenue_56 AS chr_56, t.spend_56 AS ty_56, t.revenue_56 AS tyr_56, cc.code AS channel_code, tc.code AS type_code
FROM trail a JOIN trail o ON o.level = 'overall' AND o.date = a.date LEFT JOIN trail c ON c.level = 'channel' AND c.segment = a.ref_channel AND c.date = a.date LEFT JOIN trail t ON t.level = 'campaign_type' AND t.segment = a.ref_type AND t.date = a.date
LEFT JOIN (SELECT channel, dense_rank() OVER (ORDER BY channel) AS code FROM (SELECT DISTINCT channel FROM fact)) cc ON cc.channel = a.ref_channel LEFT JOIN (SELECT campaign_type, dense_rank() OVER (ORDER BY campaign_type) AS code FROM (SELECT DISTINCT campaign_type FROM fact)) tc ON tc.campaign_type = a.ref_type""",
    "trail",
    "fact",
)
D28, D7 = "(spend_28 / least(n, 28))", "(spend_7 / least(n, 7))"
ROAS = {k: div(f"revenue_{k}", f"spend_{k}") for k in WIDTHS}
CR = {k: div(f"conversions_{k}", f"clicks_{k}") for k in (14, 28, 56)}
CTR = {k: div(f"clicks_{k}", f"impressions_{k}") for k in (14, 28, 56)}
EXPECTED = f"greatest(revenue_28 / least(n, 28) * h * least(greatest(least(greatest(revenue_trend_28, -0.25), 0.25) * 0.35 * least(h / 90.0, 1.0) + 1.0, 0.65), 1.35), 0)"
END, IDX, TURN = "date_add(date, CAST(h AS INTEGER))", "(n + h)", "2 * pi()"
CHR, TYR = div("chr_56", "ch_56"), div("tyr_56", "ty_56")
VALUES = {
    "horizon": "CAST(h AS DOUBLE)",
    "history_days": "CAST(n AS DOUBLE)",
    **{f"recent_spend_{k}": f"spend_{k}" for k in (7, 28, 56)},
    "projected_spend_horizon": f"{D7} * h",
    "planned_spend_delta_7_28": div(f"{D7} - {D28}", D28),
    "planned_spend_delta_28_horizon": div(f"{D7} * h - {D28} * h", f"{D28} * h"),
    **{f"recent_revenue_{k}": f"revenue_{k}" for k in WIDTHS},
    **{f"recent_roas_{k}": ROAS[k] for k in WIDTHS},
    **{f"rps_{k}": ROAS[k] for k in (7, 14, 28)},
    "rps_trend_7_28": div(f"{ROAS[7]} - {ROAS[28]}", ROAS[28]),
    "baseline_revenue_forecast": clean(EXPECTED),
    "baseline_roas_forecast": clean(f"CASE WHEN {D28} * h > 1e-9 THEN {EXPECTED} / ({D28} * h) ELSE 0 END"),
    **{f"recent_{m}_28": f"{m}_28" for m in ("clicks", "impressions", "conversions")},
    "ctr_28": CTR[28],
    "conversion_rate_28": CR[28],
    "cpc_28": div("spend_28", "clicks_28"),
    "revenue_per_conversion_28": div("revenue_28", "conversions_28"),
    **{f"{c}_trend_{k}": f"{c}_trend_{k}" for k in (28, 56) for c in ("spend", "revenue", "roas")},
    **{f"revenue_momentum_{k}_56": div(f"revenue_{k} / least(n, {k}) - revenue_56 / least(n, 56)", "revenue_56 / least(n, 56)") for k in (14, 28)},
    **{f"roas_momentum_{k}_56": div(f"{ROAS[k]} - {ROAS[56]}", ROAS[56]) for k in (14, 28)},
    "conversion_rate_14": CR[14],
    "conversion_rate_56": CR[56],
    "conversion_rate_stability_14_56": f"1.0 - least(abs({CR[14]} - {CR[56]}) / greatest(abs({CR[56]}), 0.001), 1.0)",
    "ctr_stability_14_56": f"1.0 - least(abs({CTR[14]} - {CTR[56]}) / greatest(abs({CTR[56]}), 0.001), 1.0)",
    "dow_end": f"CAST(isodow({END}) - 1 AS DOUBLE)",
    "month_end": f"CAST(month({END}) AS DOUBLE)",
    **{f"{f}_{p}": f"{f}({TURN} * {IDX} / {p})" for p in (7, 30, 365) for f in ("sin", "cos")},
    "sin_year_end": f"sin({TURN} * dayofyear({END}) / 365.25)",
    "cos_year_end": f"cos({TURN} * dayofyear({END}) / 365.25)",
    "quarter_end": f"CAST(quarter({END}) AS DOUBLE)",
    "dow_channel_interaction": f"(isodow({END}) - 1) * CAST(channel_code AS DOUBLE)",
    "dow_campaign_type_interaction": f"(isodow({END}) - 1) * CAST(type_code AS DOUBLE)",
    "month_channel_interaction": f"month({END}) * CAST(channel_code AS DOUBLE)",
    "month_campaign_type_interaction": f"month({END}) * CAST(type_code AS DOUBLE)",
    "sin_year_x_channel_code": f"sin({TURN} * dayofyear({END}) / 365.25) * channel_code",
    **{c: c for c in ("rev_std_14", "rev_std_28", "rev_std_56", "roas_std_56")},
    "spend_share_28": div("spend_28", "all_28"),
    "spend_share_drift_28_56": f"{div('spend_28', 'all_28')} - {div('spend_56', 'all_56')}",
    "channel_roas_56": CHR,
    "campaign_type_roas_56": TYR,
    "segment_vs_channel_roas_56": div(f"{ROAS[56]} - {CHR}", CHR),
    "segment_vs_campaign_type_roas_56": div(f"{ROAS[56]} - {TYR}", TYR),
    "campaign_spend_share_of_channel_28": div("spend_28", "ch_28"),
    "spend_x_sin7": f"{D28} * sin({TURN} * {IDX} / 7)",
    "level_code": "CASE level WHEN 'overall' THEN 0.0 WHEN 'channel' THEN 1.0 WHEN 'campaign_type' THEN 2.0 ELSE 3.0 END::DOUBLE",
    "channel_code": "CAST(channel_code AS DOUBLE)",
    "campaign_type_code": "CAST(type_code AS DOUBLE)",
    "unique_campaigns": "CAST(unique_campaigns AS DOUBLE)",
}
cte("feature_rows", "SELECT level, segment, date, h AS horizon_days, n, spend, revenue, " + ", ".join(f"{e} AS {c}" for c, e in VALUES.items()).replace(" AS history_days", " AS history_days") + " FROM referenced, (SELECT unnest([30, 60, 90]) AS h)", "referenced")


def features(spark, sf):
    fact = campaign_fact(spark, sf)
    return X.segment_features(fact, R.few_codes(fact, "channel"), R.few_codes(fact, "campaign_type"))


# Features that follow from the horizon; the others are one value for each segment and day.
BY_HORIZON = [
    c for c in X.FEATURES
    if c in ("horizon", "projected_spend_horizon", "planned_spend_delta_28_horizon", "quarter_end", "dow_end", "month_end", "spend_x_sin7")
    or c.startswith(("baseline_", "sin_", "cos_", "dow_", "month_"))
]
BY_DAY = [c for c in X.FEATURES if c not in BY_HORIZON]


@query("win8_segment_features", sql("SELECT level, segment, date, " + ", ".join(f"{r(c)} AS {c}" for c in BY_DAY) + " FROM feature_rows WHERE horizon_days = 30", "feature_rows"))
def segment_features(spark, sf):
    """The features that are the same for all horizons, at every segment and day (also jn9 and win17)."""
    df = features(spark, sf).filter(F.col("horizon_days") == 30)
    return df.select(*BY, "date", *[round_to(c, 4).alias(c) for c in BY_DAY])


@query("win8_horizon_features", sql("SELECT level, segment, date, horizon_days, " + ", ".join(f"{r(c)} AS {c}" for c in BY_HORIZON) + " FROM feature_rows", "feature_rows"))
def horizon_features(spark, sf):
    """The features that follow from the horizon, at every segment, day and horizon."""
    return features(spark, sf).select(*BY, "date", "horizon_days", *[round_to(c, 4).alias(c) for c in BY_HORIZON])


SHARES = ["spend_share_28", "spend_share_drift_28_56", "channel_roas_56", "campaign_type_roas_56", "segment_vs_channel_roas_56", "campaign_spend_share_of_channel_28"]


@query("jn9_reference_ratios", sql("SELECT level, segment, date, " + ", ".join(f"{r(c)} AS {c}" for c in SHARES) + " FROM feature_rows WHERE horizon_days = 30", "feature_rows"))
def reference_ratios(spark, sf):
    """Share drift and parent ratios of every segment and day (win17)."""
    df = features(spark, sf).filter(F.col("horizon_days") == 30)
    return df.select(*BY, "date", *[round_to(c, 4).alias(c) for c in SHARES])


cte(
    "samples",
    "SELECT *, ln(1 + greatest(fr, 0)) - ln(1 + greatest(baseline_revenue_forecast, 0)) AS revenue_target, " + div("fr", "fs") + " AS roas_target FROM (SELECT *, "
    + ", ".join(f"CASE horizon_days " + " ".join(f"WHEN {h} THEN {agg} OVER (PARTITION BY horizon_days, level, segment ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in HORIZONS) + f" END AS {n}" for n, agg in (("fr", "sum(revenue)"), ("fs", "sum(spend)"), ("fc", "count(*)")))
    + ", count(*) OVER (PARTITION BY horizon_days, level, segment) AS total FROM feature_rows) WHERE fc = horizon_days AND n >= 10 AND (n - 10) % greatest(7, horizon_days // 3) = 0 AND total >= 35",
    "feature_rows",
)


@query(
    "fc6_rolling_training_set",
    sql(f"SELECT level, segment, date, horizon_days, fr AS future_revenue, {r('baseline_revenue_forecast', 2)} AS baseline_revenue_forecast, {r('revenue_target', 6)} AS revenue_target, {r('roas_target')} AS roas_target FROM samples", "samples"),
)
def rolling_training_set(spark, sf):
    df = X.training_set(features(spark, sf))
    return df.select(
        *BY, "date", "horizon_days", "future_revenue", round_to("baseline_revenue_forecast", 2).alias("baseline_revenue_forecast"),
        round_to("revenue_target", 6).alias("revenue_target"), round_to("roas_target", 4).alias("roas_target"),
    )


@query(
    "fc8_residual_quantile_bands",
    sql(f"SELECT horizon_days, level, count(*) AS n, {r('quantile_cont(revenue_target, 0.12)', 6)} AS lower_q, {r('quantile_cont(revenue_target, 0.88)', 6)} AS upper_q FROM samples GROUP BY 1, 2", "samples"),
)
def residual_quantile_bands(spark, sf):
    """Bands of the baseline's own log residuals, per horizon and level."""
    samples = X.training_set(features(spark, sf)).withColumn("residual", F.col("revenue_target"))
    return rounded(T.residual_bands(samples, ["horizon_days", "level"]), "lower_q", "upper_q", digits=6)


# Stand-in model figures, so that blending and intervals can be checked exactly without fitted trees.
TR = "baseline_revenue_forecast * (1.0 + least(greatest(revenue_trend_56, -0.9), 2.0))"
W = "CASE horizon_days WHEN 30 THEN 0.6 WHEN 60 THEN 0.25 ELSE 0.0 END"
cte("last_rows", "SELECT f.*, s.revenue_sd, s.roas_n, s.roas_sd FROM feature_rows f JOIN state s ON s.level = f.level AND s.segment = f.segment AND s.last_date = f.date", "feature_rows", "state")
cte(
    "blended",
    f"""
SELECT *, CASE WHEN b > 0 THEN least(greatest(tr, b * 0.5), b * 2.5) * w + b * (1.0 - w) ELSE greatest(tr, 0) END AS expected_revenue,
 CASE WHEN br > 0 THEN least(greatest(tq, 0), greatest(br * 2.5, 15.0)) * 0.4 + br * (1.0 - 0.4) ELSE least(greatest(tq, 0), greatest(br * 2.5, 15.0)) END AS blended_roas
FROM (SELECT *, {TR} AS tr, recent_roas_7 AS tq, CAST({W} AS DOUBLE) AS w, baseline_revenue_forecast AS b, baseline_roas_forecast AS br FROM last_rows)""",
    "last_rows",
)


def stand_in(spark, sf):
    df = X.last_features(features(spark, sf))
    h = F.col("horizon_days")
    return df.withColumns(
        {
            "trained_revenue": F.col("baseline_revenue_forecast") * (F.least(F.greatest(F.col("revenue_trend_56"), F.lit(-0.9)), F.lit(2.0)) + 1.0),
            "trained_roas": F.col("recent_roas_7"),
            "revenue_weight": F.when(h == 30, 0.6).when(h == 60, 0.25).otherwise(0.0),
            "roas_weight": F.lit(0.4),
        }
    )


@query("fc9_blend_forecast", sql(f"SELECT level, segment, horizon_days, {r('expected_revenue', 2)} AS expected_revenue, {r('blended_roas')} AS blended_roas FROM blended", "blended"))
def blend_forecast(spark, sf):
    df = T.blend(stand_in(spark, sf))
    return df.select(*BY, "horizon_days", round_to("expected_revenue", 2).alias("expected_revenue"), round_to("blended_roas", 4).alias("blended_roas"))


def ph(table) -> str:
    return per_h(table).replace("CASE h ", "CASE horizon_days ")


SCALE = f"CASE WHEN w <= 1e-9 THEN {ph(BASELINE_ANCHORED_SCALE)} ELSE 1.0 END * ({ph(LONG_HORIZON_SCALE)})"
LV = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVEL_INTERVAL_FACTOR.items()) + " END"
cte(
    "half_widths",
    f"""SELECT level, segment, horizon_days, expected_revenue, greatest(({ph(HORIZON_Z)}) * (b * 0.1) * greatest({ph(INTERVAL_MULTIPLIER)}, 1.0), expected_revenue * greatest({ph(INTERVAL_FLOOR_PCT)}, 0.04),
 ({ph(HORIZON_Z)}) * revenue_sd * sqrt(horizon_days), least(greatest(expected_revenue - (tr * 0.7 * w + b * (1.0 - w)), (tr * 1.4 * w + b * (1.0 - w)) - expected_revenue, 0), expected_revenue * 0.50))
 * least(greatest(({LV}) + CASE WHEN n < 12 THEN 0.06 ELSE 0 END, 0.95), 1.35) * {SCALE} AS half_width FROM blended""",
    "blended",
)


@query("fc10_interval_assembly", sql(f"SELECT level, segment, horizon_days, {r('half_width', 2)} AS half_width, {r('greatest(expected_revenue - half_width, 0)', 2)} AS lower_revenue, {r('expected_revenue + half_width', 2)} AS upper_revenue FROM half_widths", "half_widths"))
def interval_assembly(spark, sf):
    fact = campaign_fact(spark, sf)
    state = segment_state(R.segment_daily(fact)).select(*BY, "revenue_sd")
    df = T.blend(stand_in(spark, sf)).join(state, BY).withColumns(
        {
            "residual_sd": F.col("baseline_revenue_forecast") * 0.1,
            "lower_band": F.col("trained_revenue") * 0.7,
            "upper_band": F.col("trained_revenue") * 1.4,
        }
    )
    return rounded(T.assemble_interval(df).select(*BY, "horizon_days", "half_width", "lower_revenue", "upper_revenue"), "half_width", "lower_revenue", "upper_revenue", digits=2)


@query(
    "fc5_estimate_missing_spend",
    sql(
        f"""SELECT date, channel, campaign_type, campaign_name, revenue, {r("CASE WHEN revenue > 0 THEN revenue / coalesce(c.benchmark_roas, t.benchmark_roas, (SELECT benchmark_roas FROM benchmarks WHERE level = 'overall')) ELSE 0 END")} AS spend, true AS spend_estimated
FROM fact f LEFT JOIN (SELECT * FROM benchmarks WHERE level = 'channel' AND segment <> 'MACHINERY') c ON c.segment = f.channel LEFT JOIN (SELECT * FROM benchmarks WHERE level = 'campaign_type' AND segment <> 'PROMO') t ON t.segment = f.campaign_type""",
        "fact",
        "benchmarks",
    ),
)
def estimate_missing_spend(spark, sf):
    """Facts without any spend; benchmarks miss one channel and may miss a type."""
    fact = campaign_fact(spark, sf)
    marks = R.roas_benchmarks(fact).filter(~F.col("segment").isin("MACHINERY", "PROMO"))
    out = T.estimate_missing_spend(fact.withColumn("spend", F.lit(0.0)), marks)
    return out.select("date", "channel", "campaign_type", "campaign_name", "revenue", round_to("spend", 4).alias("spend"), "spend_estimated")


# --- fitted trees: figures depend on the fit, so SQL checks what the contract fixes ----------------
FITTED: dict[tuple, tuple] = {}
FOLDS = 4


def version(spark, sf) -> tuple:
    """Changes when a file of the fact tables does."""
    parts = [table(spark, sf, t).select(F.max("_metadata.file_modification_time").alias("t"), F.count("*").alias("n")).first() for t in ("orders", "customer", "part", "lineitem")]
    return tuple((str(p.t), p.n) for p in parts)


def trained(spark, sf):
    """Features, models, campaign fact and samples of one set of tables; a session fits all horizons and folds once."""
    key = (spark.sparkContext.applicationId, sf, version(spark, sf))
    if key not in FITTED:
        fact = checkpoint(campaign_fact(spark, sf))
        codes = [R.few_codes(fact, c) for c in ("channel", "campaign_type")]
        rows = checkpoint(X.segment_features(fact, *codes))
        samples = checkpoint(X.training_set(rows))
        FITTED[key] = (rows, T.fit_all(rows, (), FOLDS, samples=samples), fact, samples)
    return FITTED[key]


@query("fc7_training_report")
def training_report(spark, sf):
    """Cross-validated R2, holdout errors and weights per horizon."""
    return T.training_report(spark, trained(spark, sf)[1])


@query("fc12_trained_predictions")
def trained_predictions(spark, sf):
    """Trees per horizon, blend, intervals and the output contract (fc7 with fc9-fc12)."""
    rows, models, fact, _ = trained(spark, sf)
    return T.trained_predictions(rows, models, (), fact)


@query(
    "fc12_trained_contract",
    sql("SELECT level, count(DISTINCT segment) AS segments, CAST(h AS INTEGER) AS horizon_days, count(*) AS n, count(*) AS ordered, count(*) AS within FROM state, (SELECT unnest([30, 60, 90]) AS h) GROUP BY level, h", "state"),
)
def trained_contract(spark, sf):
    """Every segment has each horizon, bounds are in order, and the centre stays within 0.5 to 2.5 baselines."""
    rows, models, fact, _ = trained(spark, sf)
    out = T.trained_predictions(rows, models, (), fact)
    base = X.last_features(rows).select(*BY, "horizon_days", "baseline_revenue_forecast")
    b, e = F.col("baseline_revenue_forecast"), F.col("expected_revenue")
    held = (b <= 0) | e.between(b * 0.5 - 0.01, b * 2.5 + 0.01)
    ordered = (F.col("lower_revenue") <= e) & (e <= F.col("upper_revenue")) & (F.col("lower_roas") <= F.col("expected_roas")) & (F.col("expected_roas") <= F.col("upper_roas"))
    return out.join(base, [*BY, "horizon_days"]).groupBy("level", F.col("horizon_days").cast("int").alias("horizon_days")).agg(
        F.countDistinct("segment").alias("segments"), F.count("*").alias("n"), F.count_if(ordered).alias("ordered"), F.count_if(held).alias("within"))


@query(
    "fc12_trained_budget_features",
    sql(
        f"""SELECT level, segment, CAST(horizon_days AS INTEGER) AS horizon_days, {r('spend')} AS projected_spend, {r(div('spend - run', 'run'))} AS planned_delta
FROM (SELECT f.level, f.segment, f.horizon_days, f.recent_spend_28 / least(f.n, 28) * f.horizon_days AS run,
 CASE WHEN coalesce(p.has_budget, false) THEN p.planned_daily_spend * f.horizon_days ELSE f.projected_spend_horizon END AS spend
 FROM (SELECT * FROM feature_rows QUALIFY date = max(date) OVER (PARTITION BY level, segment)) f LEFT JOIN planned p ON p.level = f.level AND p.segment = f.segment)""",
        "feature_rows",
        "planned",
    ),
)
def trained_budget_features(spark, sf):
    """What channel budgets change in the vectors that the fitted trees read."""
    fact = campaign_fact(spark, sf)
    df = T.with_plan(X.last_features(features(spark, sf)), planned_spend(fact, demo_budgets(fact)))
    return df.select(*BY, F.col("horizon_days").cast("int").alias("horizon_days"), round_to("projected_spend_horizon", 4).alias("projected_spend"),
                     round_to("planned_spend_delta_28_horizon", 4).alias("planned_delta"))


@query("fc12_trained_budget_predictions")
def trained_budget_predictions(spark, sf):
    """The trained path under channel budgets."""
    rows, models, fact, _ = trained(spark, sf)
    return T.trained_predictions(rows, models, (), fact, demo_budgets(fact))


@query(
    "fc12_trained_estimated_contract",
    sql("SELECT level, CAST(h AS INTEGER) AS horizon_days, count(*) AS n, count(*) AS ordered, CAST(0 AS BIGINT) AS unmarked FROM state, (SELECT unnest([30, 60, 90]) AS h) GROUP BY level, h", "state"),
)
def trained_estimated_contract(spark, sf):
    """Facts whose spend is all missing: it is estimated, each segment has its forecasts, and none passes for plainly trained."""
    _, models, fact, _ = trained(spark, sf)
    filled = checkpoint(T.estimate_missing_spend(fact.withColumn("spend", F.lit(0.0)), R.roas_benchmarks(fact)))
    codes = [R.few_codes(fact, c) for c in ("channel", "campaign_type")]
    marked = filled.agg(F.max("spend_estimated").alias("spend_estimated"))
    out = T.trained_predictions(X.segment_features(filled, *codes), models, (), filled, None, marked)
    ordered = F.col("expected_revenue").between(F.col("lower_revenue"), F.col("upper_revenue"))
    return out.groupBy("level", F.col("horizon_days").cast("int").alias("horizon_days")).agg(
        F.count("*").alias("n"), F.count_if(ordered).alias("ordered"), F.count_if(F.col("model_type") == "trained_model").alias("unmarked"))


def over_models(spark, sf, one):
    """One result for each horizon and target, marked with both."""
    rows, models, _, samples = trained(spark, sf)
    out = None
    for (h, fold), m in models.items():
        for target, model in (("revenue", m.revenue), ("roas", m.roas)) if fold == 0 else ():
            part = one(rows.filter(F.col("horizon_days") == h), samples.filter(F.col("horizon_days") == h), model, target)
            part = part.withColumns({"horizon_days": F.lit(h), "target": F.lit(target)})
            out = part if out is None else out.unionByName(part)
    return out


@query("fc18_feature_importance")
def feature_importance(spark, sf):
    return over_models(spark, sf, lambda rows, samples, model, target: T.feature_importance(model, samples, f"{target}_target"))


def listed(cells) -> str:
    """One aggregate struct per feature, as rows."""
    return f"SELECT horizon_days, unnest([{', '.join(cells)}], recursive := true) FROM samples GROUP BY horizon_days"


def r_sql(f: str, y: str) -> str:
    spread = f"(stddev_pop({f}) * stddev_pop({y}))"
    return r(f"CASE WHEN {spread} > 1e-12 THEN covar_pop({f}, {y}) / {spread} END")


@query(
    "fc18_label_correlations",
    sql(
        "SELECT * FROM (" + listed(f"{{'feature': '{f}', 'revenue_correlation': {r_sql(f, 'revenue_target')}, 'roas_correlation': {r_sql(f, 'roas_target')}}}" for f in X.FEATURES) + ")",
        "samples",
    ),
)
def label_correlations(spark, sf):
    """What the fits cannot change in fc18: the correlation behind each direction, for all features, horizons and targets."""
    samples = checkpoint(X.training_set(features(spark, sf)))
    sides = [T.label_correlations(samples, f"{t}_target", ["horizon_days"]).withColumnRenamed("correlation", f"{t}_correlation") for t in ("revenue", "roas")]
    return rounded(sides[0].join(sides[1], ["horizon_days", "feature"]), "revenue_correlation", "roas_correlation")


@query(
    "fc17_replacement_values",
    sql(
        "SELECT * FROM (" + listed(f"{{'feature': '{f}', 'n': count({f}), " + ", ".join(f"'{k}': {r(f'quantile_cont(CAST({f} AS DOUBLE), {q})')}" for k, q in (("mid", 0.5), ("low", 0.25), ("high", 0.75))) + "}" for f in X.FEATURES) + ")",
        "samples",
    ),
)
def replacement_values(spark, sf):
    """What the fits cannot change in fc17: the exact values that stand in for each feature."""
    samples = checkpoint(X.training_set(features(spark, sf)))
    return rounded(T.feature_quartiles(samples, X.FEATURES, ["horizon_days"]), "mid", "low", "high")


@query("fc17_local_drivers")
def local_drivers(spark, sf):
    return over_models(
        spark, sf, lambda rows, samples, model, target: T.local_drivers(X.last_features(rows).select(*BY, *X.FEATURES), samples, model, X.FEATURES, BY)
    )


# --- walk-forward of the fitted models (ev1 with its metrics, comparison and selection) -------------
WALKED: dict[tuple, object] = {}


def walked(spark, sf):
    """The scored folds, written once a session: every metric starts from them."""
    key = (spark.sparkContext.applicationId, sf, version(spark, sf))
    if key not in WALKED:
        rows, models, fact, _ = trained(spark, sf)
        WALKED[key] = checkpoint(T.trained_walk_forward(rows, R.segment_daily(fact), models, (), FOLDS))
    return WALKED[key]


def walked_metrics(spark, sf):
    return E.error_metrics(E.long_scores(walked(spark, sf)), ["horizon_days", "model", "target"])


@query("ev1_trained_walk_forward")
def trained_walk_forward(spark, sf):
    """A row per segment, horizon and fold: actuals, safe forecast and that of models fit before the fold."""
    return walked(spark, sf)


@query(
    "ev1_trained_contract",
    sql(f"SELECT level, h AS horizon_days, CAST(k AS INTEGER) AS fold, start, count(*) AS n, sum(actual_revenue) AS actual_revenue, {r('sum(safe_expected_revenue)', 0)} AS safe_revenue, count(*) AS ordered FROM scored GROUP BY ALL", "scored"),
)
def trained_walk_contract(spark, sf):
    """What the fits cannot change: every fold's segments, actuals and safe forecasts, and bounds around the centre."""
    df = walked(spark, sf)
    e = F.col("trained_expected_revenue")
    ordered = (F.col("trained_lower_revenue") <= e) & (e <= F.col("trained_upper_revenue"))
    return df.groupBy("level", "horizon_days", "fold", "start").agg(
        F.count("*").alias("n"), F.sum("actual_revenue").alias("actual_revenue"), round_to(F.sum("safe_expected_revenue"), 0).alias("safe_revenue"), F.count_if(ordered).alias("ordered"))


@query("ev2_trained_error_metrics")
def trained_error_metrics(spark, sf):
    return rounded(walked_metrics(spark, sf), *E.METRICS)


@query("ev4_trained_paired_bootstrap")
def trained_paired_bootstrap(spark, sf):
    return E.paired_bootstrap(walked(spark, sf))


@query("ev5_trained_blend_sweep")
def trained_blend_sweep(spark, sf):
    return E.blend_sweep(walked(spark, sf), BLEND_CANDIDATES)


@query("ev6_trained_champion_challenger")
def trained_champion_challenger(spark, sf):
    return E.champion_challenger(walked_metrics(spark, sf), E.paired_bootstrap(walked(spark, sf)))


@query("ev7_trained_winner_evidence")
def trained_winner_evidence(spark, sf):
    return E.winner_evidence(walked_metrics(spark, sf), ["horizon_days"])


@query("ev12_trained_validation_table")
def trained_validation_table(spark, sf):
    metrics = walked_metrics(spark, sf)
    return E.validation_table(metrics, E.winner_evidence(metrics, ["horizon_days"]))
