import math

from pyspark.sql import functions as F

from adtide.operators import evaluate as E
from adtide.operators import rollup as R
from helpers import day, fact

COLUMNS = "horizon_days int, n long, observed double, ci_low double, ci_high double, p_value double"


def test_champion_rule(spark):
    rows = [(30, 11, -1.0, -2.0, -0.5, 0.01), (60, 40, -1.0, -2.0, -0.5, 0.01), (90, 40, 1.0, 0.5, 2.0, 0.01)]
    paired = spark.createDataFrame(rows, COLUMNS)
    metrics = spark.createDataFrame([(h, m, "revenue", v) for h in (30, 60, 90) for m, v in (("trained", 5.0), ("safe", 9.0))], "horizon_days int, model string, target string, mape double")
    got = {r.horizon_days: (r.selected_method, r.revenue_weight) for r in E.champion_challenger(metrics, paired).collect()}
    assert got == {30: ("baseline", 0.0), 60: ("trained", 0.60), 90: ("baseline", 0.0)}


def test_conformal_takes_the_higher_value(spark):
    values = [float(i) for i in range(1, 21)]
    df = spark.createDataFrame([(30, v) for v in values], "horizon_days int, score double")
    got = E.conformal_quantiles(df, ["horizon_days"]).first()
    n = len(values)
    level = min(1.0, math.ceil((n + 1) * (1.0 - (1.0 - 0.9))) / n)
    assert got.quantile == values[math.ceil(level * (n - 1))]


def test_walk_forward_uses_earlier_rows_only(spark):
    rows = [(i, "A", 10, 100 + (i % 5)) for i in range(150)]
    base = {(r.horizon_days, r.fold, r.level): r.safe_expected_revenue for r in E.walk_forward(R.segment_daily(fact(spark, rows))).collect()}
    spiked = rows[:120] + [(i, "A", 10, 10**6) for i in range(120, 150)]
    after = {(r.horizon_days, r.fold, r.level): r.safe_expected_revenue for r in E.walk_forward(R.segment_daily(fact(spark, spiked))).collect()}
    assert base[(30, 1, "overall")] == after[(30, 1, "overall")]
    assert base and set(base) == set(after)


def test_fold_windows_do_not_overlap(spark):
    df = fact(spark, [(i, "A", 1, 1) for i in range(200)])
    starts = {r.fold: r.start for r in E.walk_forward(R.segment_daily(df)).filter("horizon_days = 30 and level = 'overall'").collect()}
    assert starts == {k + 1: day(199 - 30 * (k + 1) + 1) for k in range(4)}


def test_ranks_of_any_values(spark):
    """Signs, ties, zeros, tiny and huge values; every rank of every group."""
    import random

    rng = random.Random(6)
    groups = {"a": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(300)] + [0.0, -0.0, 0.0], "b": [5.0] * 40 + [rng.random() for _ in range(60)], "c": [1.25]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    ranks = spark.createDataFrame([(g, str(k), k + 1) for g, vs in groups.items() for k in range(len(vs))], "g string, name string, rank long")
    got = {(r.g, int(r.name)): r.value for r in E.values_at_ranks(df, ["g"], "v", ranks).collect()}
    assert got == {(g, k): v for g, vs in groups.items() for k, v in enumerate(sorted(vs))}
    q = {r.g: r.m for r in E.interpolated_quantiles(df, ["g"], "v", {"m": 0.37}).collect()}
    import numpy as np

    assert all(abs(q[g] - np.quantile(vs, 0.37)) <= 1e-9 * max(1, abs(q[g])) for g, vs in groups.items())


def test_thin_campaigns_pool_the_residuals_of_their_channel(spark):
    """Against a plain computation; a campaign with enough rows and one without any residual of its own are covered."""
    import numpy as np

    from adtide.operators.windows import one_step_residuals

    days = [(i, c, f"{c}{k}", 100.0 + (i * (7 + k)) % 31) for c, k, n in (("A", 1, 60), ("A", 2, 12), ("B", 1, 9), ("B", 2, 1), ("C", 1, 40)) for i in range(n)]
    df = spark.createDataFrame(
        [(day(i), c, "Search", name, 10.0, 1.0, 1.0, 1.0, v) for i, c, name, v in days],
        "date date, channel string, campaign_type string, campaign_name string, spend double, clicks double, impressions double, conversions double, revenue double",
    )
    residuals = one_step_residuals(R.segment_daily(df), ["level", "segment"])
    got = {r.segment: (r.n, r.total, r.z) for r in E.parent_channel_pool(df, residuals).collect()}

    def series(pick):
        by_day = {}
        for i, c, name, v in days:
            if pick(c, name):
                by_day[i] = by_day.get(i, 0.0) + v
        values = [by_day[i] for i in sorted(by_day)]
        return [v - np.mean(values[max(0, i - 7) : i]) for i, v in enumerate(values) if i]

    want = {}
    for c, name in {(c, name) for _, c, name, _ in days}:
        if sum(x[2] == name for x in days) < 30:
            pool = np.array(series(lambda a, b: b == name) + series(lambda a, b: a == c))
            z = 0.0
            if len(pool) >= 8 and pool.std(ddof=1) > 1e-9:
                z = float(np.clip(np.quantile(np.abs(pool - pool.mean()) / pool.std(ddof=1), 0.72), 0.75, 1.65))
            want[name] = (len(pool), pool.sum(), z)
    assert set(got) == set(want) == {"A2", "B1", "B2"}
    for name, (n, total, z) in want.items():
        assert got[name][0] == n and abs(got[name][1] - total) < 1e-6 and abs(got[name][2] - z) < 1e-4
    assert got["A2"][2] > 0
    both = E.parent_channel_pool(df.withColumn("account", F.lit(1)), residuals.withColumn("account", F.lit(1)), ["account"])
    assert {(r.account, r.segment, r.z) for r in both.collect()} == {(1, k, v[2]) for k, v in got.items()}
