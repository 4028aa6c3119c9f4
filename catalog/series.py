"""Windows over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.functions.exprs import round_to
from adtide.operators import rollup as R
from adtide.operators import windows as W
from adtide.plans.facts import campaign_fact
from catalog.base import big, cte, div, query, r, sql
from catalog.rollups import rounded

BY = ["level", "segment"]
PB = "PARTITION BY level, segment ORDER BY date"


def series(spark, sf):
    return R.segment_daily(campaign_fact(spark, sf))


@query(
    "win1_trailing_sums",
    sql(
        "SELECT level, segment, date, "
        + ", ".join(
            f"sum({c}) OVER ({PB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_{n}"
            for n in (7, 14, 28, 56)
            for c in ("spend", "revenue", "clicks")
        )
        + f", {r(div(f'sum(revenue) OVER ({PB} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)', f'sum(spend) OVER ({PB} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)'))} AS roas_28 FROM seg",
        "seg",
    ),
)
def trailing_sums(spark, sf):
    from adtide.functions.exprs import safe_ratio

    cols = ["spend", "revenue", "clicks"]
    df = W.trailing_sums(series(spark, sf), BY, cols).withColumn("roas_28", round_to(safe_ratio("revenue_28", "spend_28"), 4))
    return df.select("level", "segment", "date", *[f"{c}_{n}" for n in (7, 14, 28, 56) for c in cols], "roas_28")


def half_sql(col: str, n: int, lo: float, hi: float) -> str:
    """Half-window trend over the list of the last n values."""
    lst = f"list({col}) OVER ({PB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"(SELECT CASE WHEN len(l) < 4 OR f <= 0 THEN 0 ELSE least(greatest((s - f) / f, {lo}), {hi}) END FROM "
        f"(SELECT l, list_avg(l[1:m]) AS f, list_avg(l[m + 1:]) AS s FROM (SELECT {lst} AS l, 0) ))"
    )


def halves(columns, widths, lo=-0.9, hi=2.0, names=None) -> str:
    inner = ", ".join(f"list({c}) OVER ({PB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l_{c}_{n}" for n in widths for c in columns)

    def val(c, n):
        lst, m = f"l_{c}_{n}", f"greatest(len(l_{c}_{n}) // 2, 1)"
        first, second = f"list_avg({lst}[1:{m}])", f"list_avg({lst}[{m} + 1:])"
        return (
            f"CASE WHEN len({lst}) < 4 OR {first} <= 0 THEN 0 ELSE least(greatest(({second} - {first}) / {first}, {lo}), {hi}) END "
            f"AS {(names or {}).get((c, n), f'{c}_trend_{n}')}"
        )

    return "SELECT * EXCLUDE (" + ", ".join(f"l_{c}_{n}" for n in widths for c in columns) + "), " + ", ".join(
        val(c, n) for n in widths for c in columns
    ) + f" FROM (SELECT *, {inner} FROM seg)"


cte("half_trends", halves(("spend", "revenue", "roas"), (28, 56)), "seg")
TREND_NAMES = [f"{c}_trend_{n}" for n in (28, 56) for c in ("spend", "revenue", "roas")]


@query("win2_half_window_trend", sql("SELECT level, segment, date, " + ", ".join(f"{r(c)} AS {c}" for c in TREND_NAMES) + " FROM half_trends", "half_trends"))
def half_window_trend(spark, sf):
    df = W.with_half_trends(series(spark, sf), BY, ["spend", "revenue", "roas"])
    return rounded(df.select("level", "segment", "date", *TREND_NAMES), *TREND_NAMES)


@query(
    "win3_revenue_trend",
    sql(
        f"SELECT level, segment, date, {r('revenue_trend')} AS revenue_trend FROM ({halves(('revenue',), (28,), -0.25, 0.25, {('revenue', 28): 'revenue_trend'})})",
        "seg",
    ),
)
def revenue_trend(spark, sf):
    df = W.revenue_trend(series(spark, sf), BY).select("level", "segment", "date", "revenue_trend")
    return rounded(df, "revenue_trend")


LAGS = [f"{c}_lag_{n}" for n in (1, 7, 14) for c in ("revenue", "spend")]
ROLLS = [f"{c}_roll_{n}" for n in (7, 28) for c in ("revenue", "spend")]


@query(
    "win4_lag_roll_features",
    sql(
        "SELECT level, segment, date, "
        + ", ".join(f"lag({c}, {n}) OVER ({PB}) AS {c}_lag_{n}" for n in (1, 7, 14) for c in ("revenue", "spend"))
        + ", "
        + ", ".join(r(f"avg({c}) OVER ({PB} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)") + f" AS {c}_roll_{n}" for n in (7, 28) for c in ("revenue", "spend"))
        + ", "
        + ", ".join(
            r(f"CASE WHEN count(*) OVER ({PB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {m} THEN stddev_samp(revenue) OVER ({PB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) ELSE 0 END")
            + f" AS rev_std_{n}"
            for n, m in ((14, 4), (28, 7))
        )
        + " FROM seg",
        "seg",
    ),
)
def lag_roll_features(spark, sf):
    df = W.lag_roll_features(series(spark, sf), BY)
    stds = ["rev_std_14", "rev_std_28"]
    return rounded(df.select("level", "segment", "date", *LAGS, *ROLLS, *stds), *ROLLS, *stds)


CAL = ["dow", "month", "day_of_year", "quarter", *[f"{f}_{p}" for p in (7, 30, 365) for f in ("sin", "cos")],
       "sin_year", "cos_year", "month_sin", "month_cos", "week_sin", "week_cos"]


@query(
    "win5_calendar_features",
    sql(
        "SELECT date, "
        + ", ".join(
            f"{e} AS {n}"
            for n, e in {
                "dow": "CAST(isodow(date) - 1 AS DOUBLE)",
                "month": "CAST(month(date) AS DOUBLE)",
                "day_of_year": "CAST(dayofyear(date) AS DOUBLE)",
                "quarter": "CAST(quarter(date) AS DOUBLE)",
                **{f"{f}_{p}": r(f"{f}(2 * pi() * i / {p})") for p in (7, 30, 365) for f in ("sin", "cos")},
                "sin_year": r("sin(2 * pi() * dayofyear(date) / 365.25)"),
                "cos_year": r("cos(2 * pi() * dayofyear(date) / 365.25)"),
                "month_sin": r("sin(2 * pi() * month(date) / 12)"),
                "month_cos": r("cos(2 * pi() * month(date) / 12)"),
                "week_sin": r("sin(2 * pi() * weekofyear(date) / 52.18)"),
                "week_cos": r("cos(2 * pi() * weekofyear(date) / 52.18)"),
            }.items()
        )
        + " FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM daily)",
        "daily",
    ),
)
def calendar_features(spark, sf):
    df = W.calendar_features(R.daily_totals(campaign_fact(spark, sf)), [])
    return rounded(df.select("date", *CAL), *CAL[4:])


@query(
    "win6_holiday_features",
    """
WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type AS channel, sum(value) AS revenue FROM events GROUP BY 1, 2),
h(w) AS (VALUES (DATE '2024-02-12'), ('2024-05-27'), ('2024-07-01'), ('2024-09-02'), ('2024-11-25'), ('2024-12-23'), ('2025-02-10'), ('2025-05-26'),
 ('2025-06-30'), ('2025-09-01'), ('2025-11-24'), ('2025-12-22'), ('2026-02-09'), ('2026-05-25'), ('2026-06-29'), ('2026-09-07'), ('2026-11-23'), ('2026-12-21'))
SELECT date, channel, CAST(EXISTS (SELECT 1 FROM h WHERE d.date BETWEEN w AND w + 6) AS BIGINT) AS is_holiday_week,
 CAST(month(date) >= 10 AS BIGINT) AS is_q4,
 (SELECT arg_min(date_diff('day', b, d.date), abs(date_diff('day', b, d.date))) FROM (VALUES (DATE '2024-11-29'), ('2025-11-28'), ('2026-11-27')) t(b)) AS days_to_black_friday
FROM d""",
)
def holiday_features(spark, sf):
    """Dates of the event table, which fall in the listed holiday years."""
    days = (
        spark.read.parquet(f"{sf}/events.parquet")
        .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("channel"))
        .agg(F.lit(1).alias("n"))
        .drop("n")
    )
    return W.holiday_features(days)


@query(
    "win7_horizon_target",
    sql(
        "SELECT level, segment, date, "
        + ", ".join(
            f"CASE WHEN count(*) OVER ({PB} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(revenue) OVER ({PB} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS revenue_next_{h}"
            for h in (30, 60, 90)
        )
        + " FROM seg",
        "seg",
    ),
)
def horizon_target(spark, sf):
    df = series(spark, sf)
    for h in (30, 60, 90):
        df = W.horizon_target(df, BY, h)
    return df.select("level", "segment", "date", *[f"revenue_next_{h}" for h in (30, 60, 90)])


cte(
    "residuals",
    f"""
SELECT a.*, a.revenue - avg(a.revenue) OVER (PARTITION BY level, segment ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS revenue_residual, p.roas_residual
FROM seg a LEFT JOIN (SELECT level, segment, date, revenue / spend - avg(revenue / spend) OVER ({PB} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roas_residual
 FROM seg WHERE spend > 1e-9) p USING (level, segment, date)""",
    "seg",
)


@query(
    "win9_one_step_residuals",
    sql(f"SELECT level, segment, date, {r('revenue_residual')} AS revenue_residual, {r('roas_residual')} AS roas_residual FROM residuals", "residuals"),
)
def one_step_residuals(spark, sf):
    df = W.one_step_residuals(series(spark, sf), BY).select("level", "segment", "date", "revenue_residual", "roas_residual")
    return rounded(df, "revenue_residual", "roas_residual")


cte(
    "zscores",
    """
SELECT channel, date, metric, actual, CASE WHEN n >= 7 THEN mean END AS expected,
 CASE WHEN n >= 7 AND sd > 0 THEN (actual - mean) / sd END AS z FROM (
SELECT *, avg(actual) OVER w AS mean, stddev_samp(actual) OVER w AS sd, count(actual) OVER w AS n FROM (
 SELECT channel, date, 'revenue' AS metric, revenue AS actual FROM chan UNION ALL SELECT channel, date, 'spend', spend FROM chan
 UNION ALL SELECT channel, date, 'roas', roas FROM chan UNION ALL SELECT channel, date, 'ctr', ctr FROM chan)
WINDOW w AS (PARTITION BY channel, metric ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))""",
    "chan",
)


@query("win10_rolling_zscore", sql(f"SELECT channel, date, metric, {r('actual')} AS actual, {r('expected')} AS expected, {r('z')} AS z FROM zscores", "zscores"))
def rolling_zscore(spark, sf):
    from adtide.operators.signals import metric_zscores

    df = metric_zscores(R.daily_channel(campaign_fact(spark, sf)))
    return rounded(df.select("channel", "date", "metric", "actual", "expected", "z"), "actual", "expected", "z")


@query(
    "win11_pct_change_3",
    sql(
        f"SELECT channel, date, {r('past')} AS roas_past_3, {r('CASE WHEN past <> 0 THEN roas / past - 1 END')} AS roas_change_3 "
        "FROM (SELECT *, lag(roas, 3) OVER (PARTITION BY channel ORDER BY date) AS past FROM chan)",
        "chan",
    ),
)
def pct_change_3(spark, sf):
    df = W.pct_change_3(R.daily_channel(campaign_fact(spark, sf)), ["channel"])
    return rounded(df.select("channel", "date", "roas_past_3", "roas_change_3"), "roas_past_3", "roas_change_3")


@query(
    "win12_delta_lag",
    sql(
        "SELECT channel, date, spend_delta, revenue_delta, lag(spend_delta) OVER w AS spend_delta_lag, lag(revenue_delta) OVER w AS revenue_delta_lag FROM "
        "(SELECT *, spend - lag(spend) OVER (PARTITION BY channel ORDER BY date) AS spend_delta, revenue - lag(revenue) OVER (PARTITION BY channel ORDER BY date) AS revenue_delta FROM chan) "
        "WINDOW w AS (PARTITION BY channel ORDER BY date)",
        "chan",
    ),
)
def delta_lag(spark, sf):
    df = W.delta_lag(R.daily_channel(campaign_fact(spark, sf)), ["channel"], ["spend", "revenue"])
    return df.select("channel", "date", "spend_delta", "revenue_delta", "spend_delta_lag", "revenue_delta_lag")


cte(
    "filled",
    """
SELECT m.channel, d.date, coalesce(c.spend, 0) AS spend FROM (SELECT DISTINCT channel FROM chan) m,
 (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM chan) d
LEFT JOIN chan c ON c.channel = m.channel AND c.date = d.date""",
    "chan",
)
cte(
    "comparable",
    " UNION ALL ".join(
        f"SELECT channel, date, {h} AS horizon_days, w AS window_spend FROM (SELECT *, sum(spend) OVER (PARTITION BY channel ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS w, "
        f"row_number() OVER (PARTITION BY channel ORDER BY date) AS rn FROM filled) WHERE rn >= {h}"
        for h in (30, 60, 90)
    ),
    "filled",
)


@query("win13_comparable_windows", sql("SELECT * FROM comparable", "comparable"))
def comparable_windows(spark, sf):
    return W.comparable_windows(R.daily_channel(campaign_fact(spark, sf)), "channel", [], (30, 60, 90))


cte(
    "dow_profile",
    f"""
SELECT s.level, s.segment, k.weekday, s.spend_mean, d.spend_day,
 CASE WHEN d.spend_day IS NULL OR s.spend_mean <= 0 THEN 1.0 ELSE {div('d.spend_day', 's.spend_mean')} END AS spend_factor
FROM (SELECT level, segment, avg(spend) AS spend_mean FROM last28 GROUP BY 1, 2) s CROSS JOIN (SELECT unnest(range(7)) AS weekday) k
LEFT JOIN (SELECT level, segment, isodow(date) - 1 AS weekday, avg(spend) AS spend_day FROM last28 GROUP BY 1, 2, 3) d
 ON d.level = s.level AND d.segment = s.segment AND d.weekday = k.weekday""",
    "last28",
)
cte("last28", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn FROM seg) WHERE rn <= 28", "seg")


@query(
    "win16_dow_seasonality",
    sql(f"SELECT level, segment, weekday, {r('spend_mean')} AS spend_mean, {r('spend_day')} AS spend_day, {r('spend_factor')} AS spend_factor FROM dow_profile", "dow_profile"),
)
def dow_seasonality(spark, sf):
    return rounded(W.dow_seasonality(series(spark, sf), BY), "spend_mean", "spend_day", "spend_factor")
