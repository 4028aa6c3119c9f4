"""Rollups, KPIs, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.functions.exprs import round_to, safe_ratio
from adtide.operators import rollup as R
from adtide.plans.facts import campaign_fact
from catalog.base import MEASURE_SUMS, big, cte, div, pct, query, r, sql

SUMS = ["spend", "clicks", "impressions", "conversions", "revenue"]


def rounded(df, *columns, digits=4):
    return df.withColumns({c: round_to(c, digits) for c in columns})


@query("val5_fact_rollup", sql(f"SELECT date, channel, campaign_type, campaign_name, {', '.join(SUMS)}, {r('roas')} AS roas FROM fact", "fact"))
def fact_rollup(spark, sf):
    return rounded(R.fact_rollup(campaign_fact(spark, sf)), "roas")


@query("agg1_daily_totals", sql(f"SELECT date, {', '.join(SUMS)}, {r('roas')} AS roas FROM daily", "daily"))
def daily_totals(spark, sf):
    return rounded(R.daily_totals(campaign_fact(spark, sf)), "roas")


@query("agg2_segment_daily", sql(f"SELECT level, segment, date, {', '.join(SUMS)}, {r('roas')} AS roas FROM seg", "seg"))
def segment_daily(spark, sf):
    return rounded(R.segment_daily(campaign_fact(spark, sf)), "roas")


@query(
    "agg2_account_segment_daily",
    sql(f"SELECT account, level, segment, date, {', '.join(SUMS)}, {r('roas')} AS roas FROM account_seg", "account_seg"),
)
def account_segment_daily(spark, sf):
    return rounded(R.segment_daily(campaign_fact(spark, sf, ("account",)), ("account",)), "roas")


@query("agg3_daily_channel", sql(f"SELECT channel, date, {', '.join(SUMS)}, {r('roas')} AS roas, {r('ctr', 6)} AS ctr FROM chan", "chan"))
def daily_channel(spark, sf):
    return R.daily_channel(campaign_fact(spark, sf)).withColumns({"roas": round_to("roas", 4), "ctr": round_to("ctr", 6)})


cte(
    "summary",
    f"""
SELECT channel, {MEASURE_SUMS}, {div('sum(revenue)', 'sum(spend)')} AS roas, count(*) AS days_active,
 sum(CASE WHEN age < 30 THEN spend ELSE 0 END) AS recent_spend, sum(CASE WHEN age < 30 THEN revenue ELSE 0 END) AS recent_revenue,
 sum(CASE WHEN age BETWEEN 30 AND 59 THEN spend ELSE 0 END) AS previous_spend,
 sum(CASE WHEN age BETWEEN 30 AND 59 THEN revenue ELSE 0 END) AS previous_revenue,
 greatest(count(CASE WHEN age < 30 THEN 1 END), 1) AS recent_days,
 greatest(count(CASE WHEN age BETWEEN 30 AND 59 THEN 1 END), 1) AS previous_days
FROM (SELECT *, date_diff('day', date, (SELECT max(date) FROM chan)) AS age FROM chan) GROUP BY channel""",
    "chan",
)


@query("agg4_channel_summary", sql(f"SELECT * REPLACE ({r('roas')} AS roas) FROM summary", "summary"))
def channel_summary(spark, sf):
    return rounded(R.channel_summary(campaign_fact(spark, sf)), "roas")


cte(
    "kpis",
    f"""
SELECT d.*, {div('revenue', 'spend')} AS roas, (SELECT count(*) FROM (SELECT DISTINCT channel, campaign_name FROM fact)) AS campaigns,
 {div('recent_revenue', 'recent_spend')} AS recent_roas, {pct('recent_revenue', 'CASE WHEN prior_revenue = 0 THEN 1 ELSE prior_revenue END')} AS revenue_delta_pct,
 {pct('recent_spend', 'CASE WHEN prior_spend = 0 THEN 1 ELSE prior_spend END')} AS spend_delta_pct,
 {pct(div('recent_revenue', 'recent_spend'), div('prior_revenue', 'prior_spend'))} AS roas_delta_pct,
 recent_revenue - recent_spend AS recent_profit, prior_revenue - prior_spend AS prior_profit,
 CASE WHEN recent_spend - prior_spend > 0 THEN (recent_revenue - prior_revenue) / (recent_spend - prior_spend)
   ELSE {div('recent_revenue', 'recent_spend')} END AS marginal_roas
FROM (SELECT {MEASURE_SUMS}, count(*) AS days,
   sum(CASE WHEN rn <= 30 THEN revenue ELSE 0 END) AS recent_revenue, sum(CASE WHEN rn <= 30 THEN spend ELSE 0 END) AS recent_spend,
   sum(CASE WHEN rn BETWEEN 31 AND 60 THEN revenue ELSE 0 END) AS prior_revenue,
   sum(CASE WHEN rn BETWEEN 31 AND 60 THEN spend ELSE 0 END) AS prior_spend, count(CASE WHEN rn <= 30 THEN 1 END) AS recent_days
  FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM daily)) d""",
    "fact",
    "daily",
)
KPI_RATIOS = ["roas", "recent_roas", "revenue_delta_pct", "spend_delta_pct", "roas_delta_pct", "marginal_roas"]


@query(
    "agg5_portfolio_kpis",
    sql(
        f"SELECT {', '.join(SUMS)}, days, campaigns, recent_revenue, recent_spend, recent_days, recent_profit, prior_profit, "
        + ", ".join(f"{r(c)} AS {c}" for c in KPI_RATIOS) + " FROM kpis",
        "kpis",
    ),
)
def portfolio_kpis(spark, sf):
    return rounded(R.portfolio_kpis(campaign_fact(spark, sf)), *KPI_RATIOS)


@query(
    "agg5_account_kpis",
    sql(
        f"""SELECT t.account, t.revenue, t.spend, t.days, c.campaigns, {r(div('t.recent_revenue', 't.recent_spend'))} AS recent_roas
FROM (SELECT account, sum(revenue) AS revenue, sum(spend) AS spend, count(*) AS days,
  sum(CASE WHEN rn <= 30 THEN revenue ELSE 0 END) AS recent_revenue, sum(CASE WHEN rn <= 30 THEN spend ELSE 0 END) AS recent_spend
  FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date DESC) AS rn FROM account_seg WHERE level = 'overall') GROUP BY account) t
JOIN (SELECT account, count(*) AS campaigns FROM (SELECT DISTINCT account, channel, campaign_name FROM account_fact) GROUP BY account) c
ON t.account = c.account""",
        "account_seg",
    ),
)
def account_kpis(spark, sf):
    df = R.portfolio_kpis(campaign_fact(spark, sf, ("account",)), ("account",))
    return rounded(df.select("account", "revenue", "spend", "days", "campaigns", "recent_roas"), "recent_roas")


cte(
    "mix",
    f"SELECT channel, sum(spend) AS spend, sum(revenue) AS revenue, {div('sum(revenue)', 'sum(spend)')} AS roas, "
    f"{div('sum(revenue)', 'sum(sum(revenue)) OVER ()')} * 100.0 AS share_pct FROM fact GROUP BY channel",
    "fact",
)


@query("agg6_channel_mix", sql(f"SELECT channel, spend, revenue, {r('roas')} AS roas, {r('share_pct')} AS share_pct FROM mix", "mix"))
def channel_mix(spark, sf):
    return rounded(R.channel_mix(campaign_fact(spark, sf)), "roas", "share_pct")


cte(
    "board",
    f"SELECT channel, campaign_name, {MEASURE_SUMS}, min(campaign_type) AS campaign_type, {div('sum(revenue)', 'sum(spend)')} AS roas "
    "FROM fact GROUP BY channel, campaign_name",
    "fact",
)


@query("agg7_campaign_leaderboard", sql(f"SELECT * REPLACE ({r('roas')} AS roas) FROM board", "board"))
def campaign_leaderboard(spark, sf):
    return rounded(R.campaign_leaderboard(campaign_fact(spark, sf)), "roas")


@query(
    "agg8_campaign_type_breakdown",
    sql(f"SELECT campaign_type, {MEASURE_SUMS}, {r(div('sum(revenue)', 'sum(spend)'))} AS roas FROM fact GROUP BY campaign_type", "fact"),
)
def campaign_type_breakdown(spark, sf):
    return rounded(R.campaign_type_breakdown(campaign_fact(spark, sf)), "roas")


cte(
    "monthly",
    f"SELECT channel, CAST(date_trunc('month', date) AS DATE) AS month, {MEASURE_SUMS}, {div('sum(revenue)', 'sum(spend)')} AS roas FROM fact GROUP BY 1, 2",
    "fact",
)
cte(
    "mom",
    "SELECT channel, month, spend, revenue, lag(spend) OVER (PARTITION BY channel ORDER BY month) AS previous_spend, "
    "lag(revenue) OVER (PARTITION BY channel ORDER BY month) AS previous_revenue FROM monthly",
    "monthly",
)


@query("agg9_monthly_channel", sql(f"SELECT * REPLACE ({r('roas')} AS roas) FROM monthly", "monthly"))
def monthly_channel(spark, sf):
    return rounded(R.monthly_channel(campaign_fact(spark, sf)), "roas")


@query("win15_month_over_month", sql("SELECT * FROM mom", "mom"))
def month_over_month(spark, sf):
    return R.month_over_month(campaign_fact(spark, sf))


cte(
    "benchmarks",
    " UNION ALL ".join(
        f"SELECT '{lv}' AS level, {seg} AS segment, least(greatest(sum(revenue) / sum(spend), 0.5), 25.0) AS benchmark_roas "
        f"FROM fact WHERE spend > 0 AND revenue > 0 GROUP BY {seg}"
        for lv, seg in (("channel", "channel"), ("campaign_type", "campaign_type"))
    )
    + " UNION ALL SELECT 'overall', 'all', least(greatest(sum(revenue) / sum(spend), 0.5), 25.0) FROM fact WHERE spend > 0 AND revenue > 0",
    "fact",
)


@query("agg10_roas_benchmarks", sql(f"SELECT level, segment, {r('benchmark_roas')} AS benchmark_roas FROM benchmarks", "benchmarks"))
def roas_benchmarks(spark, sf):
    return rounded(R.roas_benchmarks(campaign_fact(spark, sf)), "benchmark_roas")


@query(
    "agg11_category_codes",
    sql(
        "SELECT f.channel, f.campaign_type, f.campaign_name, f.date, f.revenue, coalesce(c.code, 0) AS channel_code FROM fact f LEFT JOIN "
        "(SELECT channel, dense_rank() OVER (ORDER BY channel) AS code FROM (SELECT DISTINCT channel FROM fact WHERE date < DATE '1999-01-01' AND campaign_type <> 'ECONOMY' AND channel <> 'BUILDING')) c "
        "ON f.channel = c.channel",
        "fact",
    ),
)
def category_codes(spark, sf):
    """Codes learnt from older rows without one channel, applied to all rows (the missing one gets 0)."""
    fact = campaign_fact(spark, sf)
    known = fact.filter((F.col("date") < "1999-01-01") & (F.col("campaign_type") != "ECONOMY") & (F.col("channel") != "BUILDING"))
    coded = R.encode_category(fact, R.category_codes(known, "channel"), "channel")
    return coded.select("channel", "campaign_type", "campaign_name", "date", "revenue", "channel_code")


@query(
    "agg12_unseen_categories",
    sql(
        """SELECT 'campaign_name' AS "column", CAST(count(*) AS BIGINT) AS unseen_rows, count(DISTINCT campaign_name) AS unseen_values,
 (SELECT string_agg(campaign_name, ', ' ORDER BY campaign_name) FROM (SELECT DISTINCT campaign_name FROM fact WHERE campaign_name NOT IN
   (SELECT campaign_name FROM fact WHERE campaign_name < 'Brand#3') ORDER BY 1 LIMIT 5)) AS preview
FROM fact WHERE campaign_name NOT IN (SELECT campaign_name FROM fact WHERE campaign_name < 'Brand#3')""",
        "fact",
    ),
)
def unseen_categories(spark, sf):
    fact = campaign_fact(spark, sf)
    codes = R.category_codes(fact.filter(F.col("campaign_name") < "Brand#3"), "campaign_name")
    return R.unseen_categories(fact, codes, "campaign_name")


cte(
    "evidence_metrics",
    f"""
SELECT a.channel, t.campaign_type,
 CASE WHEN n_prior > 0 THEN prior_revenue ELSE early_revenue END AS baseline_revenue,
 CASE WHEN n_recent > 0 THEN recent_revenue ELSE late_revenue END AS observed_revenue,
 {div('CASE WHEN n_prior > 0 THEN prior_revenue ELSE early_revenue END', 'CASE WHEN n_prior > 0 THEN prior_spend ELSE early_spend END')} AS baseline_roas,
 {div('CASE WHEN n_recent > 0 THEN recent_revenue ELSE late_revenue END', 'CASE WHEN n_recent > 0 THEN recent_spend ELSE late_spend END')} AS observed_roas
FROM (SELECT channel, count(CASE WHEN age < 30 THEN 1 END) AS n_recent, count(CASE WHEN age BETWEEN 30 AND 59 THEN 1 END) AS n_prior,
"""
    + ",\n".join(
        f" sum(CASE WHEN {cond} THEN {c} ELSE 0 END) AS {name}_{c}"
        for name, cond in (
            ("recent", "age < 30"),
            ("prior", "age BETWEEN 30 AND 59"),
            ("early", "rn <= greatest(n // 2, 1)"),
            ("late", "rn > n // 2"),
        )
        for c in ("spend", "revenue")
    )
    + """
 FROM (SELECT *, date_diff('day', date, max(date) OVER ()) AS age, row_number() OVER (PARTITION BY channel ORDER BY date) AS rn,
   count(*) OVER (PARTITION BY channel) AS n FROM chan) GROUP BY channel) a
JOIN (SELECT channel, campaign_type FROM (SELECT channel, campaign_type, row_number() OVER (PARTITION BY channel ORDER BY sum(revenue) DESC, campaign_type) AS k
  FROM fact GROUP BY channel, campaign_type) WHERE k = 1) t ON a.channel = t.channel""",
    "fact",
    "chan",
)


@query(
    "agg13_channel_evidence_metrics",
    sql(f"SELECT * REPLACE ({r('baseline_roas')} AS baseline_roas, {r('observed_roas')} AS observed_roas) FROM evidence_metrics", "evidence_metrics"),
)
def channel_evidence_metrics(spark, sf):
    return rounded(R.channel_evidence_metrics(campaign_fact(spark, sf)), "baseline_roas", "observed_roas")


@query(
    "agg16_weighted_average",
    sql(f"SELECT channel, {r(div('sum(roas * spend)', 'sum(spend)'))} AS weighted_average FROM board GROUP BY channel", "board"),
)
def weighted_average(spark, sf):
    board = R.campaign_leaderboard(campaign_fact(spark, sf))
    return rounded(R.weighted_average(board, "roas", "spend", ("channel",)), "weighted_average")


cte(
    "recent_prev",
    f"""
SELECT *, {pct('recent_revenue', 'previous_revenue')} AS revenue_trend_pct, {pct('recent_spend', 'previous_spend')} AS spend_trend_pct,
 {pct('recent_roas', 'previous_roas')} AS roas_trend_pct FROM (
SELECT *, {div('recent_revenue', 'recent_spend')} AS recent_roas, {div('previous_revenue', 'previous_spend')} AS previous_roas FROM (
SELECT level, segment, """
    + ", ".join(
        f"sum(CASE WHEN rn {op} THEN {c} ELSE 0 END) AS {name}_{c}"
        for name, op in (("recent", "<= 30"), ("previous", "BETWEEN 31 AND 60"))
        for c in ("revenue", "spend")
    )
    + " FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date DESC) AS rn FROM seg) GROUP BY level, segment))",
    "seg",
)
TRENDS = ["recent_roas", "previous_roas", "revenue_trend_pct", "spend_trend_pct", "roas_trend_pct"]


@query("win14_recent_vs_previous", sql("SELECT * REPLACE (" + ", ".join(f"{r(c)} AS {c}" for c in TRENDS) + ") FROM recent_prev", "recent_prev"))
def recent_vs_previous(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf))
    return rounded(R.recent_vs_previous(series, ["level", "segment"]), *TRENDS)


@query(
    "agg18_run_rate_direction",
    sql(
        f"""SELECT {r('blended_roas')} AS blended_roas, {r('recent_daily_avg')} AS recent_daily_avg, {r('trailing_daily_avg')} AS trailing_daily_avg,
 {r(pct('recent_daily_avg', 'trailing_daily_avg'))} AS revenue_delta_pct,
 CASE WHEN {pct('recent_daily_avg', 'trailing_daily_avg')} > 2 THEN 'up' WHEN {pct('recent_daily_avg', 'trailing_daily_avg')} < -2 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT {div('sum(revenue)', 'sum(spend)')} AS blended_roas, avg(CASE WHEN rn <= 30 THEN revenue END) AS recent_daily_avg,
 coalesce(avg(CASE WHEN rn BETWEEN 31 AND 60 THEN revenue END), avg(revenue)) AS trailing_daily_avg
 FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM daily))""",
        "daily",
    ),
)
def run_rate_direction(spark, sf):
    return rounded(
        R.run_rate_direction(campaign_fact(spark, sf)),
        "blended_roas", "recent_daily_avg", "trailing_daily_avg", "revenue_delta_pct",
    )


@query("top1_top_campaigns", sql(f"SELECT channel, campaign_name, spend, revenue, {r('roas')} AS roas FROM board ORDER BY revenue DESC, channel, campaign_name LIMIT 5", "board"))
def top_campaigns(spark, sf):
    board = R.campaign_leaderboard(campaign_fact(spark, sf)).select("channel", "campaign_name", "spend", "revenue", "roas")
    return rounded(R.top_n(board, [F.col("revenue").desc(), F.col("channel"), F.col("campaign_name")], 5), "roas")


@query(
    "top1_account_top_campaigns",
    sql(
        "SELECT account, channel, campaign_name, revenue FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY revenue DESC, channel, campaign_name) AS k "
        "FROM (SELECT account, channel, campaign_name, sum(revenue) AS revenue FROM account_fact GROUP BY 1, 2, 3)) WHERE k <= 5",
        "account_fact",
    ),
)
def account_top_campaigns(spark, sf):
    fact = campaign_fact(spark, sf, ("account",))
    board = R.campaign_leaderboard(fact, ("account",)).select("account", "channel", "campaign_name", "revenue")
    return R.top_n(board, [F.col("revenue").desc(), F.col("channel"), F.col("campaign_name")], 5, ("account",))


@query("top2_bottom_campaigns", sql(f"SELECT channel, campaign_name, spend, revenue, {r('roas')} AS roas FROM board WHERE spend > 100 ORDER BY board.roas, channel, campaign_name LIMIT 5", "board"))
def bottom_campaigns(spark, sf):
    board = R.campaign_leaderboard(campaign_fact(spark, sf)).filter(F.col("spend") > 100)
    low = R.top_n(board, [F.col("roas"), F.col("channel"), F.col("campaign_name")], 5)
    return rounded(low.select("channel", "campaign_name", "spend", "revenue", "roas"), "roas")


cte(
    "best_worst",
    """SELECT b.channel AS best_channel, b.roas AS best_roas, b.spend AS best_spend, w.channel AS worst_channel, w.roas AS worst_roas, w.spend AS worst_spend,
 w.spend * 0.1 * greatest(b.roas - w.roas, 0) AS reallocation_value
FROM (SELECT * FROM mix ORDER BY roas DESC, channel LIMIT 1) b, (SELECT * FROM mix ORDER BY roas, channel LIMIT 1) w""",
    "mix",
)


@query(
    "top3_best_worst_channel",
    sql(
        f"SELECT best_channel, {r('best_roas')} AS best_roas, best_spend, worst_channel, {r('worst_roas')} AS worst_roas, worst_spend, {r('reallocation_value')} AS reallocation_value FROM best_worst",
        "best_worst",
    ),
)
def best_worst_channel(spark, sf):
    return rounded(R.best_worst_channel(campaign_fact(spark, sf)), "best_roas", "worst_roas", "reallocation_value")


@query(
    "top6_downsample_series",
    sql(
        "SELECT level, segment, date, revenue FROM (SELECT *, row_number() OVER (PARTITION BY level, segment ORDER BY date) - 1 AS i, "
        "count(*) OVER (PARTITION BY level, segment) AS n FROM seg) WHERE n <= 120 OR i % 3 = 0 OR i = n - 1",
        "seg",
    ),
)
def downsample_series(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf)).select("level", "segment", "date", "revenue")
    return R.downsample_series(series, ["level", "segment"])


@query(
    "set5_distinct_members",
    sql(
        "SELECT DISTINCT 'channel' AS dimension, channel AS member FROM fact UNION ALL SELECT DISTINCT 'campaign_type', campaign_type FROM fact "
        "UNION ALL SELECT DISTINCT 'campaign', campaign_name FROM fact",
        "fact",
    ),
)
def distinct_members(spark, sf):
    return R.distinct_members(campaign_fact(spark, sf))


@query(
    "flt1_filter_level",
    sql("SELECT date, campaign_type, campaign_name, spend, revenue FROM fact WHERE channel = 'MACHINERY'", "fact"),
)
def filter_level(spark, sf):
    from adtide.operators.quality import filter_level as keep

    return keep(campaign_fact(spark, sf), "channel", "MACHINERY").select(
        "date", "campaign_type", "campaign_name", "spend", "revenue"
    )
