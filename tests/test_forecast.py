from adtide.operators import features as X
from adtide.operators import forecast as FC
from adtide.operators import rollup as R
from adtide.operators import windows as W
from helpers import fact


def series(n=100):
    return [(d, c, 90 + 25 * i + 3 * (d % 7), (90 + 25 * i + 3 * (d % 7)) * (3 + i) * (1 + min(d, 45) / 800)) for d in range(n) for i, c in enumerate("ABC")]


def test_contract_and_strict_widening(spark):
    rows = FC.baseline_forecast(fact(spark, series())).collect()
    assert len(rows) == 3 * (1 + 3 + 1 + 3)
    by = {}
    for r in rows:
        assert 0 <= r.lower_revenue <= r.expected_revenue <= r.upper_revenue
        assert r.lower_roas <= r.expected_roas <= r.upper_roas
        label = "high" if r.interval_width_pct <= 30 else "medium" if r.interval_width_pct <= 60 else "low"
        assert r.forecast_confidence == label
        by.setdefault((r.level, r.segment), {})[r.horizon_days] = r.interval_width_pct
    for w in by.values():
        assert w[60] >= w[30] + 1.99 and w[90] >= w[60] + 1.99


def test_no_spend_is_not_computable(spark):
    rows = FC.baseline_forecast(fact(spark, [(d, "A", 0, 100) for d in range(40)])).collect()
    assert {r.forecast_confidence for r in rows} == {"not_computable"}
    assert {r.expected_roas for r in rows} == {0.0}


def test_keys_equal_separate_runs(spark):
    from pyspark.sql import functions as F

    one = fact(spark, series(60))
    two = one.withColumn("revenue", F.col("revenue") * 2)
    both = one.withColumn("account", F.lit(1)).unionByName(two.withColumn("account", F.lit(2)))
    cols = ["level", "segment", "horizon_days", "expected_revenue", "upper_revenue"]
    got = FC.baseline_forecast(both, ("account",)).filter("account = 2").select(*cols).collect()
    assert sorted(got) == sorted(FC.baseline_forecast(two).select(*cols).collect())


def half_trend(values, width):
    if len(values) < 4:
        return 0.0
    recent = values[-width:]
    mid = max(1, len(recent) // 2)
    first, second = sum(recent[:mid]) / mid, sum(recent[mid:]) / (len(recent) - mid)
    return 0.0 if first <= 0 else min(2.0, max(-0.9, (second - first) / first))


def test_half_trend_matches_a_loop(spark):
    values = [float(10 + (i * 7) % 13) for i in range(70)]
    df = W.with_half_trends(R.daily_totals(fact(spark, [(i, "A", 1, v) for i, v in enumerate(values)])), [], ["revenue"])
    got = [(r.revenue_trend_28, r.revenue_trend_56) for r in df.orderBy("date").collect()]
    for i, (a, b) in enumerate(got):
        assert abs(a - half_trend(values[: i + 1], 28)) < 1e-9
        assert abs(b - half_trend(values[: i + 1], 56)) < 1e-9


def test_features_do_not_see_the_future(spark):
    def vectors(rows, upto):
        f = fact(spark, rows)
        df = X.segment_features(f, R.category_codes(f, "channel"), R.category_codes(f, "campaign_type"))
        return sorted(df.filter(f"n = {upto} and horizon_days = 30").select("level", "segment", *X.FEATURES).collect())

    short = series(40)
    longer = short + [(d, c, 1, 10**6) for d in range(40, 60) for c in "ABC"]
    assert vectors(short, 40) == vectors(longer, 40)


def test_holidays(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.date(2025, 11, 27),), (dt.date(2026, 3, 10),)], "date date")
    a, b = W.holiday_features(df).orderBy("date").collect()
    assert (a.is_holiday_week, a.is_q4, a.days_to_black_friday) == (1, 1, -1)
    assert (b.is_holiday_week, b.is_q4) == (0, 0)
    assert {r.is_q4 for r in W.holiday_features(df, "none").collect()} == {0}


def test_thin_campaigns_get_wider_intervals(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from adtide.operators import training as T

    rows = [(d, "A", 100, 1000 + (1 if d % 5 < 3 else -1) * (40 + d)) for d in range(60)]
    daily = fact(spark, rows).withColumn("campaign_name", F.when(F.col("date") >= F.date_sub(F.max("date").over(W.Window.partitionBy(F.lit(1))), 11), "thin").otherwise("long"))
    got = {r.segment: r.pooled_z for r in T.pooled_z(daily).collect()}
    assert list(got) == ["thin"]

    def residuals(v):
        return [v[k] - np.mean(v[max(0, k - 7) : k]) for k in range(1, len(v))]

    revenue = [r[3] for r in rows]
    x = np.array(residuals(revenue[-12:]) + residuals(revenue))
    z = min(1.65, max(0.75, float(np.quantile(abs(x - x.mean()) / x.std(ddof=1), 0.72))))
    assert abs(got["thin"] - z) < 1e-4

    one = spark.sql("""SELECT 'campaign' AS level, 30 AS horizon_days, 1000.0D AS expected_revenue, 10 AS history_days, 400.0D AS residual_sd,
        0.0D AS revenue_sd, 1000.0D AS baseline_revenue_forecast, 0.5D AS revenue_weight, 1000.0D AS lower_band, 1000.0D AS upper_band""")
    width = T.assemble_interval(one).first().half_width
    wide = T.assemble_interval(one.withColumns({"pooled_z": F.lit(1.9), "interval_multiplier": F.lit(2.0)})).first().half_width
    assert abs(wide / width - 1.9 / 0.95 * 2.0 / 1.6) < 1e-9
    same = T.assemble_interval(one.withColumns({"pooled_z": F.lit(None).cast("double"), "interval_multiplier": F.lit(1.6)})).first().half_width
    assert same == width


def test_unmeasured_r2_is_null(spark):
    import numpy as np

    from adtide.operators import training as T

    from adtide.operators.boosting import Settings, fit

    trees = fit(np.zeros((4, 2)), np.zeros(4), Settings(3, 0.1, 1))
    one = T.HorizonModel(trees, trees, None, None, 0.1, 0.1, 0.0, 1.0, {"cv_r2": None, "beats": 1.0, "model_mae": 1.0, "baseline_mae": 2.0, "roas_beats": 0.0})
    assert T.training_report(spark, {(30, 0): one}).first().cv_r2 is None
    assert [T.revenue_weight(30, True, r2) for r2 in (None, 0.04, 0.05, 0.15)] == [0.10, 0.10, 0.25, 0.60]
    assert T.revenue_weight(90, False, 0.5) == 0.08
