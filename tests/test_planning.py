import math
import random

import pytest
from pyspark.sql import functions as F

from adtide.operators import planning as P
from adtide.operators import rollup as R
from helpers import fact


def allocate(spark, cases, capped=True):
    rows = [(k, str(i).zfill(2), float(t), float(w), float(c)) for k, (t, ws, cs) in enumerate(cases) for i, (w, c) in enumerate(zip(ws, cs))]
    df = spark.createDataFrame(rows, "plan int, channel string, total double, weight double, cap double")
    out = P.capped_allocation(df, "total", "weight", "cap" if capped else None, ["plan"]).orderBy("plan", "channel").collect()
    return [[r.allocation for r in out if r.plan == k] for k in range(len(cases))]


def reference(total, weights, caps):
    """Round-by-round filling, as a check of the closed form."""
    n = len(weights)
    target = min(total, sum(caps))
    got, active, rest = [0.0] * n, set(range(n)), target
    while active and rest > 1e-9:
        s = sum(weights[i] for i in active)
        share = {i: weights[i] / s if s > 0 else 1 / len(active) for i in active}
        full = [i for i in sorted(active) if rest * share[i] >= caps[i] - got[i] - 1e-9]
        if not full:
            for i in active:
                got[i] += rest * share[i]
            break
        for i in full:
            got[i] = caps[i]
            active.discard(i)
        rest = max(0.0, target - sum(got))
    raw = [g * 100 for g in got]
    cents = [math.floor(x + 1e-9) for x in raw]
    room = [math.floor(c * 100 + 1e-9) for c in caps]
    left = max(0, int(math.floor(target * 100 + 0.5)) - sum(cents))
    order = sorted(range(n), key=lambda i: (-(raw[i] - cents[i]), i))
    while left > 0:
        moved = False
        for i in order:
            if left and cents[i] < room[i]:
                cents[i] += 1
                left -= 1
                moved = True
        if not moved:
            break
    return [c / 100 for c in cents]


def test_cents_are_exact(spark):
    assert allocate(spark, [(100.01, [1, 1, 1], [50, 50, 50])]) == [[33.34, 33.34, 33.33]]


def test_allocation_matches_rounds(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(150):
        n = rnd.randint(1, 6)
        ws = [rnd.choice([0, rnd.randint(1, 20), rnd.random() * 5]) for _ in range(n)]
        cs = [round(rnd.random() * 60, rnd.choice([0, 1, 2])) for _ in range(n)]
        cases.append((round(rnd.random() * 200, 2), ws, cs))
    got = allocate(spark, cases)
    for (t, ws, cs), a in zip(cases, got):
        want = reference(t, ws, cs)
        assert sum(a) == pytest.approx(sum(want), abs=1e-6)
        assert all(abs(x - y) <= 0.0101 for x, y in zip(a, want)), (t, ws, cs, a, want)


@pytest.mark.parametrize("planned,zone", [(300, "SUPPORTED"), (301, "CAUTION"), (330, "CAUTION"), (331, "HIGH_EXTRAPOLATION"), (450, "HIGH_EXTRAPOLATION"), (451, "UNSUPPORTED")])
def test_zone_boundaries(spark, planned, zone):
    daily = R.daily_channel(fact(spark, [(i, "A", 10, 50) for i in range(40)]))
    plan = spark.createDataFrame([("A", float(planned))], "channel string, planned double")
    got = P.channel_zones(daily, plan).first()
    assert (got.zone, got.window_count, got.historical_p90) == (zone, 11, 300.0)


def test_short_history_is_unsupported(spark):
    daily = R.daily_channel(fact(spark, [(i, "A", 10, 50) for i in range(31)]))
    plan = spark.createDataFrame([("A", 10.0), ("B", 5.0)], "channel string, planned double")
    got = {r.channel: (r.zone, r.window_count) for r in P.channel_zones(daily, plan).collect()}
    assert got == {"A": ("UNSUPPORTED", 2), "B": ("UNSUPPORTED", 0)}


def test_outcomes(spark):
    cases = [(5.0, 1.0, False, True), (0.0, 1.0, True, False), (-1.0, 1.0, False, False), (1.0, 1.0, False, False), (2.0, 1.0, False, False)]
    df = spark.createDataFrame(cases, "g double, n double, u boolean, i boolean")
    out = df.select(P.optimizer_outcome(F.col("g"), F.col("n"), F.col("u"), F.col("i")).alias("o")).collect()
    assert [r.o for r in out] == ["INFEASIBLE", "NO_CHANGE", "DEGRADED", "IMPROVED_WITHIN_NOISE", "IMPROVED_ABOVE_NOISE"]


def test_spend_curve_has_falling_marginals(spark):
    summary = R.channel_summary(fact(spark, [(i, c, 10 + j, 50 + j) for i in range(70) for j, c in enumerate("AB")]))
    rows = P.spend_curve(summary, None).orderBy("channel", "multiplier").collect()
    for c in "AB":
        m = [r.marginal for r in rows if r.channel == c and r.marginal is not None]
        assert m == sorted(m, reverse=True)
