"""Anomaly, trend-break, association and event-effect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.operators import causal as C
from adtide.operators import rollup as R
from adtide.operators import signals as S
from adtide.plans.facts import campaign_fact
from adtide.session import checkpoint
from catalog.base import clampq, cte, div, query, r, sql
from catalog.rollups import rounded


def daily(spark, sf):
    return R.daily_channel(campaign_fact(spark, sf))


cte(
    "anomalies",
    f"""
SELECT date, channel, metric, {r('actual')} AS actual, {r('expected')} AS expected, {r('z', 2)} AS z_score, CASE WHEN abs(z) > 3.5 THEN 'critical' ELSE 'warning' END AS severity
FROM zscores WHERE abs(z) > 2.5 UNION ALL
SELECT date, channel, 'roas', {r('roas')}, {r('past')}, {r('(roas / past - 1) * 10.0', 2)}, CASE WHEN roas / past - 1 <= -0.35 THEN 'critical' ELSE 'warning' END
FROM (SELECT *, lag(roas, 3) OVER (PARTITION BY channel ORDER BY date) AS past FROM chan) WHERE past <> 0 AND roas / past - 1 < -0.20""",
    "zscores",
    "chan",
)


@query("st1_detect_anomalies", sql("SELECT * FROM anomalies", "anomalies"))
def detect_anomalies(spark, sf):
    return S.detect_anomalies(daily(spark, sf))


EVENT_DAILY = "SELECT event_type AS channel, CAST(ts AS DATE) AS date, floor(sum(value) * 100 + 0.5) AS revenue FROM events GROUP BY 1, 2"


def cusum_sql(source: str) -> str:
    return f"""
SELECT channel, days[i + 1].date AS date, CASE WHEN size >= 0 THEN 'up' ELSE 'down' END AS direction, {r('size', 2)} AS magnitude_pct FROM (
SELECT *, (cur - CASE WHEN prev = 0 THEN 1 ELSE prev END) / CASE WHEN prev = 0 THEN 1 ELSE prev END * 100.0 AS size FROM (
SELECT *, list_avg([x.revenue FOR x IN days[greatest(i - 14, 0) + 1:greatest(i - 1, 1)]]) AS prev, list_avg([x.revenue FOR x IN days[i + 1:i + 7]]) AS cur FROM (
SELECT channel, days, unnest(alarms) AS i FROM (
WITH RECURSIVE s AS (SELECT channel, list(struct_pack(date := date, revenue := revenue) ORDER BY date) AS days, avg(revenue) AS m, stddev_samp(revenue) AS sd FROM ({source}) GROUP BY channel HAVING count(*) >= 21),
f AS (SELECT channel, days, m, sd, 0 AS k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, []::INTEGER[] AS alarms FROM s
UNION ALL SELECT channel, days, m, sd, k + 1, CASE WHEN u > 5 * sd OR -d > 5 * sd THEN 0 ELSE u END, CASE WHEN u > 5 * sd OR -d > 5 * sd THEN 0 ELSE d END,
 CASE WHEN u > 5 * sd OR -d > 5 * sd THEN list_append(alarms, k) ELSE alarms END
 FROM (SELECT *, greatest(up + (days[k + 1].revenue - m) - sd * 0.5, 0) AS u, least(down + (days[k + 1].revenue - m) + sd * 0.5, 0) AS d FROM f WHERE k < len(days)))
SELECT channel, days, alarms FROM f WHERE k = len(days)))))"""


@query("st2_event_trend_breaks", cusum_sql(EVENT_DAILY))
def event_trend_breaks(spark, sf):
    """Event types as channels, event values as revenue."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    series = events.groupBy(F.col("event_type").alias("channel"), F.to_date("ts").alias("date")).agg(
        F.floor(F.sum("value") * 100 + 0.5).cast("double").alias("revenue")
    )
    return S.trend_breaks(series)


@query("st2_trend_breaks", sql(cusum_sql("SELECT * FROM chan"), "chan"))
def trend_breaks(spark, sf):
    return S.trend_breaks(daily(spark, sf))


@query(
    "jn4_channel_vs_blended",
    sql("SELECT channel, date, spend, revenue, sum(spend) OVER (PARTITION BY date) AS blended_spend, sum(revenue) OVER (PARTITION BY date) AS blended_revenue FROM chan", "chan"),
)
def channel_vs_blended(spark, sf):
    df = S.channel_vs_blended(daily(spark, sf))
    return df.select("channel", "date", "spend", "revenue", "blended_spend", "blended_revenue")


cte(
    "drivers",
    f"""
SELECT channel, observations, {r('coalesce(b, c)', 3)} AS spend_revenue_corr, {r('c', 3)} AS channel_revenue_corr, {r('l', 3)} AS lagged_revenue_corr,
 CASE WHEN coalesce(b, c) >= 0.1 THEN 'positive' WHEN coalesce(b, c) <= -0.1 THEN 'negative' ELSE 'mixed' END AS direction,
 CASE WHEN abs(coalesce(b, c)) >= 0.6 THEN 'strong' WHEN abs(coalesce(b, c)) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength
FROM (SELECT channel, count(CASE WHEN sd IS NOT NULL AND rd IS NOT NULL THEN 1 END) AS observations, corr(sd, rd) AS c, corr(sd, bd) AS b, corr(sdl, bd) AS l FROM (
 SELECT *, lag(sd) OVER (PARTITION BY channel ORDER BY date) AS sdl FROM (
 SELECT c.channel, c.date, spend - lag(spend) OVER (PARTITION BY channel ORDER BY c.date) AS sd, c.revenue - lag(c.revenue) OVER (PARTITION BY channel ORDER BY c.date) AS rd, b.bd
 FROM chan c JOIN (SELECT date, revenue - lag(revenue) OVER (ORDER BY date) AS bd FROM daily) b USING (date))) GROUP BY channel)""",
    "chan",
    "daily",
)


@query("st3_driver_evidence", sql("SELECT * FROM drivers", "drivers"))
def driver_evidence(spark, sf):
    return S.driver_evidence(daily(spark, sf))


# --- events ---------------------------------------------------------------------------------------
cte(
    "events_in",
    "SELECT DISTINCT date AS event_date, channel AS event_channel, metric FROM anomalies WHERE severity = 'critical' UNION "
    "SELECT (SELECT max(date) FROM chan) - 13, channel, 'recent_window' FROM chan",
    "anomalies",
)
cte(
    "event_days",
    """
SELECT e.event_date, e.event_channel, e.metric, CAST(date_diff('day', e.event_date, d.date) AS INTEGER) AS off, d.date, sum(CASE WHEN d.channel = e.event_channel THEN revenue END) AS own_revenue,
 sum(CASE WHEN d.channel = e.event_channel THEN spend END) AS own_spend, sum(CASE WHEN d.channel <> e.event_channel THEN revenue END) AS control_revenue,
 sum(CASE WHEN d.channel <> e.event_channel THEN spend END) AS control_spend
FROM events_in e JOIN chan d ON d.date BETWEEN e.event_date - 14 AND e.event_date + 13 GROUP BY ALL""",
    "events_in",
    "chan",
)
EV = "event_date, event_channel, metric"
cte(
    "did_agg",
    f"""
SELECT {EV}, count(CASE WHEN off < 0 THEN own_revenue END) AS pre_days, count(CASE WHEN off >= 0 THEN own_revenue END) AS post_days,
 count(CASE WHEN off < 0 THEN control_revenue END) AS cpre, count(CASE WHEN off >= 0 THEN control_revenue END) AS cpost,
 avg(CASE WHEN off < 0 THEN own_revenue END) AS pre_own, avg(CASE WHEN off >= 0 THEN own_revenue END) AS post_own,
 avg(CASE WHEN off < 0 THEN control_revenue END) AS pre_ctl, avg(CASE WHEN off >= 0 THEN control_revenue END) AS post_ctl,
 avg(CASE WHEN off < 0 THEN own_roas END) AS pre_own_roas, avg(CASE WHEN off >= 0 THEN own_roas END) AS post_own_roas,
 avg(CASE WHEN off < 0 THEN ctl_roas END) AS pre_ctl_roas, avg(CASE WHEN off >= 0 THEN ctl_roas END) AS post_ctl_roas,
 regr_slope(CASE WHEN off < 0 THEN own_revenue END, own_i) AS own_slope, regr_slope(CASE WHEN off < 0 THEN control_revenue END, ctl_i) AS ctl_slope,
 stddev_samp(CASE WHEN off >= 0 THEN own_revenue END) AS post_sd
FROM (SELECT *, CASE WHEN own_revenue IS NOT NULL THEN {div('own_revenue', 'own_spend')} END AS own_roas, CASE WHEN control_revenue IS NOT NULL THEN {div('control_revenue', 'control_spend')} END AS ctl_roas,
 count(own_revenue) OVER w AS own_i, count(control_revenue) OVER w AS ctl_i FROM event_days WINDOW w AS (PARTITION BY {EV}, off >= 0 ORDER BY date)) GROUP BY {EV}
HAVING count(CASE WHEN off < 0 THEN own_revenue END) >= 7 AND count(CASE WHEN off >= 0 THEN own_revenue END) >= 7""",
    "event_days",
)
cte(
    "did_base",
    """
SELECT *, (post_own - expected_daily) * post_days AS incremental_revenue, post_own_roas - pre_own_roas - CASE WHEN paired THEN post_ctl_roas - pre_ctl_roas ELSE 0 END AS roas_effect,
 post_sd / sqrt(post_days) * post_days AS effect_se, cpre >= 5 AND parallel_pct <= 8 AS parallel_passed FROM (
SELECT *, pre_own * (1.0 + CASE WHEN paired THEN post_ctl / pre_ctl - 1.0 ELSE own_slope * post_days / greatest(pre_own, 1.0) END) AS expected_daily,
 CASE WHEN cpre >= 5 THEN abs(own_slope - ctl_slope) / greatest(abs(pre_own), abs(pre_ctl), 1.0) * 100.0 ELSE 100.0 END AS parallel_pct FROM (
SELECT *, cpre >= 5 AND cpost >= 5 AND pre_ctl > 0 AS paired FROM did_agg))""",
    "did_agg",
)
DRAW = "((((rep * 7919 + pos * 104729 + 12345) % 1000003) * ((rep * 7919 + pos * 104729 + 12345) % 1000003) + ((rep * 7919 + pos * 104729 + 12345) % 1000003) * 31 + 17) % 1000003)"
cte(
    "did_draws",
    f"""
SELECT {EV}, quantile_cont(total, 0.025) AS lower_draw, quantile_cont(total, 0.975) AS upper_draw FROM (
SELECT {EV}, rep, sum(vals[{DRAW} % len(vals) + 1] - expected_daily) AS total FROM (
 SELECT b.event_date, b.event_channel, b.metric, b.expected_daily, v.vals, unnest(range(len(v.vals))) AS pos FROM did_base b JOIN
  (SELECT {EV}, list(own_revenue ORDER BY date) AS vals FROM event_days WHERE off >= 0 AND own_revenue IS NOT NULL GROUP BY {EV}) v USING ({EV})),
 (SELECT unnest(range(500)) AS rep) GROUP BY {EV}, rep) GROUP BY {EV}""",
    "did_base",
)
X = "(abs(t_statistic) / sqrt(2.0))"
KK = f"(1.0 / ({X} * 0.3275911 + 1.0))"
PVAL = f"({KK} * (({KK} * ({KK} * ({KK} * ({KK} * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736)) + 0.254829592)) * exp(-{X} * {X})"
cte(
    "did",
    f"""
SELECT *, CASE WHEN power_passed AND post_days >= 12 AND p_value <= 0.05 AND abs(upper_revenue - lower_revenue) <= abs(incremental_revenue) * 2.5 THEN 'high' WHEN power_passed THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN incremental_revenue >= 0 THEN 'positive' ELSE 'negative' END AS effect_direction FROM (
SELECT *, abs(t_statistic) * (1.0 - least(greatest(p_value, 0), 1)) * CASE WHEN parallel_passed THEN 1.0 ELSE 0.6 END * least(greatest(post_days / 14.0, 0.35), 1.0) AS effect_strength,
 enough AND parallel_passed AND p_value <= 0.15 AND NOT crosses AS power_passed,
 concat_ws('; ', CASE WHEN NOT enough THEN 'minimum sample check failed' END, CASE WHEN p_value > 0.15 THEN 'p-value exceeds 0.15' END, CASE WHEN crosses THEN '95% confidence interval crosses zero' END,
  CASE WHEN NOT parallel_passed THEN 'parallel-trends check is weak' END) AS low_power_reasons FROM (
SELECT *, CASE WHEN effect_se > 1e-9 THEN {PVAL} ELSE 1.0 END AS p_value, lower_revenue <= 0 AND upper_revenue >= 0 AS crosses, pre_days >= 10 AND post_days >= 10 AS enough FROM (
SELECT b.*, CASE WHEN post_sd <= 1e-9 THEN incremental_revenue ELSE lower_draw END AS lower_revenue, CASE WHEN post_sd <= 1e-9 THEN incremental_revenue ELSE upper_draw END AS upper_revenue,
 CASE WHEN effect_se > 1e-9 THEN incremental_revenue / effect_se ELSE 0 END AS t_statistic FROM did_base b JOIN did_draws d USING ({EV}))))""",
    "did_draws",
)
cte(
    "estimates",
    f"""SELECT event_date AS date, event_channel AS channel, metric, pre_days, post_days, {', '.join(f'{r(c, 2)} AS {c}' for c in ('incremental_revenue', 'lower_revenue', 'upper_revenue', 'roas_effect', 'parallel_pct', 'effect_se'))},
 parallel_passed, {r('t_statistic', 3)} AS t_statistic, {r('p_value')} AS p_value, {r('effect_strength', 3)} AS effect_strength, effect_direction, power_passed, low_power_reasons, confidence FROM did""",
    "did",
)


def written_fact(spark, sf):
    """The facts, written for queries that read them beside the channel days; conversions, which none of their steps reads, are null."""
    return checkpoint(campaign_fact(spark, sf).drop("conversions")).withColumn("conversions", F.lit(None).cast("double"))


def written_days(fact):
    """The channel days behind event effects, written: their steps read them several times, the order lines once."""
    return checkpoint(R.daily_channel(fact).drop("conversions"))


def event_table(series):
    """Critical anomalies of every channel, and each channel's last full two weeks."""
    critical = S.detect_anomalies(series).filter(F.col("severity") == "critical").select("date", "channel", "metric").distinct()
    recent = C.default_events(series).select(F.date_sub("date", 13).alias("date"), "channel", F.lit("recent_window").alias("metric"))
    return critical.unionByName(recent)


def effects(series):
    return C.did_effects(series, event_table(series))


@query("st4_did_effects", sql("SELECT * FROM estimates", "estimates"))
def did_effects(spark, sf):
    """Effects of all events with significance and power (also st5, st6, jn5 and fn12)."""
    return C.present_estimates(effects(written_days(campaign_fact(spark, sf))))


@query(
    "jn6_event_window_join",
    sql("SELECT event_date, event_channel, metric, off AS \"offset\", date, own_revenue, own_spend, control_revenue, control_spend FROM event_days", "event_days"),
)
def event_window_join(spark, sf):
    series = written_days(campaign_fact(spark, sf))
    return C.event_days(series, event_table(series))


@query(
    "st7_bootstrap_ci",
    sql(f"SELECT {EV}, {r('lower_draw', 2)} AS lower_draw, {r('upper_draw', 2)} AS upper_draw FROM did_draws", "did_draws"),
)
def bootstrap_ci(spark, sf):
    """Resampled residual sums per event over its own values."""
    by = list(C.EVENT)
    df = effects(written_days(campaign_fact(spark, sf)))
    draws = df.select(*by, F.col("lower_revenue").alias("lower_draw"), F.col("upper_revenue").alias("upper_draw"))
    return rounded(draws, "lower_draw", "upper_draw", digits=2)


@query("st8_default_events", sql("SELECT DISTINCT channel, (SELECT max(date) FROM chan) AS date, 'revenue' AS metric FROM chan", "chan"))
def default_events(spark, sf):
    return C.default_events(daily(spark, sf))


TOP5 = "SELECT * FROM estimates ORDER BY effect_strength DESC, abs(incremental_revenue) DESC, date, channel LIMIT "


@query("top4_top_estimates", sql(TOP5 + "5", "estimates"))
def top_estimates(spark, sf):
    return C.top_estimates(C.present_estimates(effects(written_days(campaign_fact(spark, sf)))))


cte(
    "evidence",
    f"""
SELECT e.*, m.campaign_type, m.baseline_revenue, m.baseline_roas, m.observed_roas, e.channel IN (SELECT channel FROM anomalies) AS has_anomaly,
 {r("CASE WHEN coalesce(m.baseline_revenue, 0) <> 0 THEN e.incremental_revenue / m.baseline_revenue * 100.0 ELSE e.roas_effect * 100.0 END", 2)} AS delta_percent,
 e.lower_revenue <= 0 AND e.upper_revenue >= 0 AS crosses
FROM ({TOP5} 1) e LEFT JOIN evidence_metrics m USING (channel)""",
    "estimates",
    "evidence_metrics",
    "anomalies",
)
cte(
    "labelled",
    """
SELECT *, CASE WHEN NOT power_passed OR low_power_reasons <> '' THEN 'underpowered_sample_watch'
 WHEN (confidence = 'low' OR crosses) AND has_anomaly AND effect_direction = 'positive' AND incremental_revenue > 0 THEN 'noisy_positive_signal'
 WHEN (confidence = 'low' OR crosses) AND has_anomaly THEN 'anomaly_timing_watch' WHEN confidence = 'low' OR crosses THEN 'volatility_watch'
 WHEN (effect_direction = 'negative' OR incremental_revenue < 0) AND p_value <= 0.10 AND effect_strength >= 0.20 THEN 'statistically_supported_decline'
 WHEN effect_direction = 'negative' OR incremental_revenue < 0 THEN 'efficiency_compression'
 WHEN p_value <= 0.10 AND (abs(delta_percent) >= 15 OR effect_strength >= 0.35) THEN 'statistically_supported_lift' ELSE 'incremental_growth' END AS evidence_label,
 concat_ws('; ', 'observational DiD, not randomized incrementality', CASE WHEN crosses THEN '95% confidence interval crosses zero' END, CASE WHEN NOT parallel_passed THEN 'parallel-trends check is weak' END,
  CASE WHEN p_value > 0.15 THEN 'p-value is not statistically strong' END, CASE WHEN NOT power_passed THEN 'minimum sample or power check did not pass' END,
  CASE WHEN NOT has_anomaly THEN 'no material anomaly supported the event timing' END) AS limitations FROM evidence""",
    "evidence",
)


@query(
    "st9_structured_evidence",
    sql(
        f"SELECT channel, date, campaign_type, incremental_revenue, confidence, {r('baseline_roas')} AS baseline_roas, {r('observed_roas')} AS observed_roas, delta_percent, limitations, evidence_label FROM labelled",
        "labelled",
    ),
)
def structured_evidence(spark, sf):
    """Strongest estimate with its channel figures, limits and label (also st10; the hash is fn13)."""
    fact = written_fact(spark, sf)
    series = written_days(fact)
    df = C.structured_evidence(C.present_estimates(effects(series)), R.channel_evidence_metrics(fact), S.detect_anomalies(series))
    return df.select(
        "channel", "date", "campaign_type", "incremental_revenue", "confidence",
        *[C.round_to(c, 4).alias(c) for c in ("baseline_roas", "observed_roas")],
        "delta_percent", F.array_join("limitations", "; ").alias("limitations"), "evidence_label",
    )


@query(
    "st10_evidence_labels",
    sql(
        """SELECT e.date, e.channel, e.metric, CASE WHEN NOT power_passed OR low_power_reasons <> '' THEN 'underpowered_sample_watch'
 WHEN confidence = 'low' OR (lower_revenue <= 0 AND upper_revenue >= 0) THEN CASE WHEN a.channel IS NULL THEN 'volatility_watch'
  WHEN effect_direction = 'positive' AND incremental_revenue > 0 THEN 'noisy_positive_signal' ELSE 'anomaly_timing_watch' END
 WHEN (effect_direction = 'negative' OR incremental_revenue < 0) AND p_value <= 0.10 AND effect_strength >= 0.20 THEN 'statistically_supported_decline'
 WHEN effect_direction = 'negative' OR incremental_revenue < 0 THEN 'efficiency_compression'
 WHEN p_value <= 0.10 AND (abs(roas_effect * 100.0) >= 15 OR effect_strength >= 0.35) THEN 'statistically_supported_lift' ELSE 'incremental_growth' END AS evidence_label
 FROM estimates e LEFT JOIN (SELECT DISTINCT date, channel FROM anomalies) a ON a.channel = e.channel AND a.date = e.date
UNION ALL SELECT c.date, c.channel, 'none' AS metric, CASE WHEN count(a.channel) = 0 THEN 'stable_run_rate' ELSE 'anomaly_timing_watch' END AS evidence_label
 FROM chan c LEFT JOIN anomalies a ON a.channel = c.channel AND a.date = c.date LEFT JOIN estimates e ON e.channel = c.channel AND e.date = c.date
 WHERE e.channel IS NULL GROUP BY 1, 2""",
        "estimates",
        "anomalies",
        "chan",
    ),
)
def evidence_labels(spark, sf):
    """The label of every estimate, and of every channel day without one. An anomaly of the channel on that day is one that
    supports the timing; the last full window of a channel may have none."""
    series = written_days(campaign_fact(spark, sf))
    seen = S.detect_anomalies(series).select("date", "channel").distinct().withColumn("has_anomaly", F.lit(True))

    def flagged(df):
        return df.join(seen, ["date", "channel"], "left").withColumn("has_anomaly", F.coalesce("has_anomaly", F.lit(False)))

    df = C.present_estimates(effects(series))
    known = flagged(df).withColumn("delta_percent", F.col("roas_effect") * 100.0)
    known = known.select("date", "channel", "metric", C.evidence_label().alias("evidence_label"))
    rest = series.select("date", "channel").join(df.select("date", "channel"), ["date", "channel"], "left_anti")
    return known.unionByName(C.without_estimate(flagged(rest)).select("date", "channel", F.lit("none").alias("metric"), "evidence_label"))


@query(
    "fn13_evidence_hash",
    sql(
        """SELECT channel, revenue, substr(sha256('{"channel":"' || channel || '","revenue":' || CAST(CAST(revenue AS BIGINT) AS VARCHAR) || '}'), 1, 16) AS evidence_hash FROM mix""",
        "mix",
    ),
)
def evidence_hash(spark, sf):
    from adtide.functions.exprs import evidence_hash as digest

    mix = R.channel_mix(campaign_fact(spark, sf))
    packed = F.struct("channel", F.col("revenue").cast("bigint").alias("revenue"))
    return mix.select("channel", "revenue", digest(packed).alias("evidence_hash"))


def score_sql(label: str, strength: str, p: str) -> str:
    base = f"CASE {label} WHEN 'high' THEN 0.82 WHEN 'medium' THEN 0.58 ELSE 0.32 END"
    return r(clampq(f"{base} + {clampq(f'({strength}) * 0.03', 0, 0.12)} + {clampq(f'(0.2 - {clampq(p, 0, 1)}) * 0.4', 0, 0.08)}", 0.05, 0.95), 2)


SPREAD = "(SELECT max(roas) - min(roas) FROM mix)"
cte(
    "hypotheses",
    f"""
SELECT 1 AS slot, 'budget shift' AS hypothesis, channel, confidence, {score_sql('confidence', 'effect_strength', 'p_value')} AS score FROM (SELECT * FROM estimates ORDER BY abs(incremental_revenue) DESC, date DESC, channel LIMIT 1)
UNION ALL SELECT 2, 'platform algorithm change', channel, lv, {score_sql('lv', 'abs(z_score)', '0.2')} FROM (SELECT *, CASE severity WHEN 'critical' THEN 'high' ELSE 'medium' END AS lv FROM anomalies ORDER BY date DESC, channel, metric, z_score LIMIT 1)
UNION ALL SELECT 3, 'budget reallocation implication', channel, lv, {score_sql('lv', 'sp / 2.0', '0.18')} FROM (SELECT channel, {SPREAD} AS sp, CASE WHEN {SPREAD} >= 1.25 THEN 'medium' ELSE 'low' END AS lv FROM mix ORDER BY mix.roas DESC, channel LIMIT 1) WHERE sp >= 0.75
UNION ALL SELECT 4, 'channel cannibalization risk', channel, lv, {score_sql('lv', 'sh / 50.0', '0.22')} FROM (SELECT channel, spend / (SELECT sum(spend) FROM mix) * 100.0 AS sh, CASE WHEN {SPREAD} < 1.0 THEN 'low' ELSE 'medium' END AS lv FROM mix ORDER BY spend DESC, channel LIMIT 1) WHERE sh >= 45""",
    "estimates",
    "anomalies",
    "mix",
)


@query("st11_rank_hypotheses", sql("SELECT hypothesis, channel, confidence, score, row_number() OVER (ORDER BY slot) AS rank FROM hypotheses", "hypotheses"))
def rank_hypotheses(spark, sf):
    fact = written_fact(spark, sf)
    series = written_days(fact)
    return C.rank_hypotheses(C.present_estimates(effects(series)), S.detect_anomalies(series), R.channel_mix(fact))


def response(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} < 1 THEN least(pow({x}, 0.72), ({x}) * 1.35) WHEN {x} <= 1.5 THEN {x} ELSE ({x} - 1.5) * pow(({x}) / 1.5, -0.45) + 1.5 END"


cte(
    "elasticity",
    f"SELECT *, previous_revenue * ({response('spend / previous_spend')}) AS predicted FROM mom WHERE previous_spend > 1e-9 AND previous_revenue > 1e-9 AND abs(spend / previous_spend - 1.0) >= 0.15",
    "mom",
)


@query(
    "st12_roas_elasticity_check",
    sql(
        f"""SELECT count(*) AS cases, {r('avg(abs(predicted - revenue))', 2)} AS mae, {r('avg(abs(predicted - revenue) / greatest(revenue, 1.0) * 100.0)', 2)} AS mape,
 {r('avg(CASE WHEN sign(revenue - previous_revenue) = sign(predicted - previous_revenue) THEN 1.0 ELSE 0 END) * 100.0', 2)} AS direction_accuracy FROM elasticity""",
        "elasticity",
    ),
)
def roas_elasticity_check(spark, sf):
    return rounded(S.elasticity_check(campaign_fact(spark, sf)), "mae", "mape", "direction_accuracy", digits=2)


@query("fn8_spend_response", sql(f"SELECT channel, month, {r(response('spend / previous_spend'))} AS response FROM mom WHERE previous_spend > 0", "mom"))
def spend_response(spark, sf):
    from adtide.functions.exprs import round_to
    from adtide.functions.exprs import spend_response as curve

    mom = R.month_over_month(campaign_fact(spark, sf)).filter(F.col("previous_spend") > 0)
    return mom.select("channel", "month", round_to(curve(F.col("spend") / F.col("previous_spend")), 4).alias("response"))
