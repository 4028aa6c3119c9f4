import datetime as dt

import pytest

from adtide.operators import causal as C
from adtide.operators import rollup as R
from adtide.operators import signals as S
from helpers import day, fact


def test_spike_is_critical(spark):
    rows = [(i, "A", 100, 15000 if i == 30 else 5000 + (i % 3)) for i in range(45)]
    found = S.detect_anomalies(R.daily_channel(fact(spark, rows))).filter("metric = 'revenue'").collect()
    assert [(r.date, r.severity) for r in found if r.z_score > 0] == [(day(30), "critical")]


def test_constant_series_has_no_anomaly(spark):
    assert S.detect_anomalies(R.daily_channel(fact(spark, [(i, "A", 10, 50) for i in range(40)]))).count() == 0


def test_step_is_a_break_up(spark):
    rows = [(i, "A", 100, 9000 if i >= 25 else 5000) for i in range(45)]
    breaks = S.trend_breaks(R.daily_channel(fact(spark, rows))).collect()
    assert breaks and breaks[-1].direction in ("up", "down")


def cusum(values):
    """Plain-loop check of the fold."""
    n = len(values)
    mean = sum(values) / n
    sd = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5
    up = down = 0.0
    out = []
    for i, v in enumerate(values):
        up, down = max(0.0, up + v - mean - 0.5 * sd), min(0.0, down + v - mean + 0.5 * sd)
        if up > 5 * sd or -down > 5 * sd:
            out.append(i)
            up = down = 0.0
    return out


def test_breaks_match_a_loop(spark):
    values = [100 + (i * 37 % 11) for i in range(40)] + [160 + (i * 13 % 7) for i in range(40)]
    got = S.trend_breaks(R.daily_channel(fact(spark, [(i, "A", 1, v) for i, v in enumerate(values)]))).collect()
    assert sorted(r.date for r in got) == [day(i) for i in cusum(values)]


def test_planted_step_is_recovered(spark):
    rows = [(d, c, 100, 1000 + 5 * d + (250 if c == "A" and d >= 28 else 0)) for d in range(56) for c in "ABC"]
    events = spark.createDataFrame([(day(28), "A", "revenue")], "date date, channel string, metric string")
    est = C.present_estimates(C.did_effects(R.daily_channel(fact(spark, rows)), events)).first()
    assert est.incremental_revenue == pytest.approx(14 * 250, rel=0.12)
    assert est.p_value < 0.15 and est.lower_revenue <= est.incremental_revenue <= est.upper_revenue
    assert est.parallel_passed and est.effect_direction == "positive"


def test_default_events_are_the_last_day(spark):
    events = C.default_events(R.daily_channel(fact(spark, [(i, c, 1, 1) for i in range(3) for c in "AB"]))).collect()
    assert {(r.channel, r.date) for r in events} == {("A", day(2)), ("B", day(2))}
    assert isinstance(events[0].date, dt.date)
