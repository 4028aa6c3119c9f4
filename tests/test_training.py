"""Boosted trees, the grid of fits and the walk-forward of fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtide.operators import features as X
from adtide.operators import rollup as R
from adtide.operators import training as T
from adtide.operators.boosting import Settings, fit
from helpers import fact


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[:, 4] = 3.0
    return x, np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] + rng.normal(size=n) * (0.1 + (x[:, 2] > 0))


def test_boosting_learns_and_ranks_features():
    x, y = table(1500, 1)
    trees = fit(x, y, Settings(120, 0.1, 3, 0.8, 0.8, 5))
    there, want = table(800, 2)
    assert 1 - ((want - trees.predict(there)) ** 2).mean() / want.var() > 0.7
    assert set(np.argsort(-trees.gain)[:2]) == {0, 1} and trees.gain[4] == 0
    again = fit(x, y, Settings(120, 0.1, 3, 0.8, 0.8, 5))
    assert (again.predict(there) == trees.predict(there)).all()
    assert trees.predict(there[:0]).shape == (0,)


def test_quantile_bands_follow_the_features():
    x, y = table(3000, 3)
    low, high = (fit(x, y, Settings(150, 0.1, 2, 0.9, quantile=q)) for q in (0.12, 0.88))
    there, want = table(3000, 4)
    lo, hi = low.predict(there), high.predict(there)
    assert abs(((lo <= want) & (want <= hi)).mean() - 0.76) < 0.05
    assert (hi - lo).std() > 0.05


def test_boosting_of_constant_and_few_rows():
    assert (fit(np.zeros((5, 2)), np.full(5, 7.0), Settings(10, 0.1, 3)).predict(np.ones((3, 2))) == 7.0).all()
    x = np.array([[0.0], [1.0]])
    assert abs(fit(x, np.array([0.0, 10.0]), Settings(200, 0.1, 1)).predict(x) - [0, 10]).max() < 0.01


def series(days, spike=None):
    return [(i, c, 50 + i % 7, (10**6 if spike is not None and i >= spike else 500 + 3 * i + 40 * (i % 7))) for i in range(days) for c in "AB"]


def vectors(spark, rows):
    df = fact(spark, rows)
    return X.segment_features(df, R.category_codes(df, "channel"), R.category_codes(df, "campaign_type")).persist(), R.segment_daily(df)


@pytest.fixture(scope="module")
def plain(spark):
    return vectors(spark, series(330))


def test_samples_of_a_fold_end_before_it_starts(spark, plain):
    rows, _ = plain
    last = rows.agg(F.max("date").alias("_last"))
    marked = T.in_folds(X.training_set(rows), last, (), 4)
    start = F.date_sub(F.lit(rows.agg(F.max("date")).first()[0]), F.col("horizon_days") * F.col("fold") - 1)
    assert marked.where((F.col("fold") > 0) & (F.col("target_end") >= start)).count() == 0
    sizes = {(r.horizon_days, r.fold): r["count"] for r in marked.groupBy("horizon_days", "fold").count().collect()}
    assert sizes[30, 0] == X.training_set(rows).where("horizon_days = 30").count() and sizes[30, 0] > sizes[30, 1] > sizes[30, 4] > 0


def test_sample_is_bounded_and_seeded(spark):
    many = spark.range(20000).select(F.lit("campaign").alias("level"), F.col("id").cast("string").alias("segment"), F.lit("2026-01-01").cast("date").alias("date"), F.lit(30).alias("horizon_days"), F.lit(0).alias("fold"))
    few = many.limit(40).withColumn("fold", F.lit(1))
    both = many.unionByName(few)
    got = T.sample(both, (), 500)
    assert abs(got.where("fold = 0").count() - 500) < 100 and got.where("fold = 1").count() == 40
    assert {r.segment for r in got.collect()} == {r.segment for r in T.sample(both.repartition(9), (), 500).collect()}


def many_samples(spark, n):
    """Labelled rows of horizon 60 and fold 0."""
    wave = F.sin(F.col("id") * 0.7)
    names = {"level": F.lit("campaign"), "segment": (F.col("id") % 37).cast("string"), "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 37).cast("int")), "horizon_days": F.lit(60), "fold": F.lit(0)}
    figures = {"revenue_target": wave, "roas_target": wave * 2, "future_revenue": wave + 5, "baseline_revenue_forecast": F.lit(4.0)}
    values = {c: (wave + i if i < 3 else F.lit(1.0)) for i, c in enumerate(X.FEATURES)}
    return spark.range(n).withColumns({**values, **names, **figures}).withColumn("target_end", F.date_add("date", 60))


def test_fits_take_all_rows(spark):
    """Every fit of a horizon and fold sees all of its labelled rows, in one order; too few rows give no model."""
    rows = many_samples(spark, 2600).unionByName(many_samples(spark, 5).withColumn("fold", F.lit(1)))
    fits = {r.task: r for r in T.fit_grid(rows).collect()}
    assert set(fits) == set(T.grid(60)) and {r.fold for r in fits.values()} == {0} and {r.n for r in fits.values()} == {2600}
    again = {r.task: r for r in T.fit_grid(rows.repartition(7)).collect()}
    assert all(again[t] == fits[t] for t in fits)


def test_models_come_from_all_rows(spark):
    """A model's holdout figures are those of all labelled rows: the last fifth by target end, however many there are."""
    rows = many_samples(spark, 2600)
    (model,) = T.fit_all(rows.where("fold = 0").drop("fold"), samples=rows.drop("fold")).values()
    held = rows.orderBy("target_end", F.pmod(T.pick(()), F.lit(T.PICKS)), T.pick(())).select("future_revenue").toPandas()["future_revenue"].to_numpy()[2080:]
    assert model.diagnostics["baseline_mae"] == pytest.approx(abs(held - 4.0).mean())


def test_later_rows_do_not_reach_a_fold(spark, plain):
    """Models and forecasts of a fold are the same whatever happens from its first day on."""
    out = []
    for rows, daily in (plain, vectors(spark, series(330, 300))):
        models = {k: m for k, m in T.fit_all(rows, (), 1).items()}
        scored = T.trained_walk_forward(rows, daily, models, (), 1).where("horizon_days = 30")
        out.append({(r.level, r.segment): (r.trained_expected_revenue, r.trained_lower_revenue, r.model_type) for r in scored.collect()})
    assert out[0] == out[1] and len(out[0]) == 6
    assert {t for *_, t in out[0].values()} == {"trained_model"}


@pytest.fixture(scope="module")
def models(plain):
    return T.fit_all(plain[0])


def test_budgets_and_estimated_spend(spark, plain, models):
    """Budgets move only their channel's segments; forecasts on estimated spend say so."""
    df = fact(spark, series(330))
    budgets = spark.createDataFrame([(" a ", 3000.0), ("Other", 5.0)], "channel string, budget double")
    last = X.last_features(plain[0])
    before = {(r.level, r.segment, r.horizon_days): r for r in last.collect()}
    after = {(r.level, r.segment, r.horizon_days): r for r in T.with_plan(last, T.planned_spend(df, budgets)).collect()}
    b = before["channel", "B", 60].projected_spend_horizon
    assert after["channel", "B", 60].projected_spend_horizon == b and after["channel", "A", 60].projected_spend_horizon == pytest.approx(6000)
    assert after["overall", "all", 60].projected_spend_horizon == pytest.approx(6000 + b)
    run = before["channel", "A", 60].spend_28 / 28 * 60
    assert after["channel", "A", 60].planned_spend_delta_28_horizon == pytest.approx(6000 / run - 1)
    point = lambda out: {(r.segment, r.horizon_days): (r.expected_revenue, r.expected_roas, r.upper_roas) for r in out.where("level = 'channel'").collect()}
    without, planned = point(T.trained_predictions(plain[0], models, (), df)), point(T.trained_predictions(plain[0], models, (), df, budgets))
    assert len(planned) == 6 and {k for k in without if without[k] != planned[k]} <= {("A", h) for h in (30, 60, 90)}
    filled = T.estimate_missing_spend(df.withColumn("spend", F.lit(0.0)), R.roas_benchmarks(df))
    rows = X.segment_features(filled, R.few_codes(df, "channel"), R.few_codes(df, "campaign_type"))
    out = T.trained_predictions(rows, models, (), filled, None, filled.agg(F.max("spend_estimated").alias("spend_estimated"))).collect()
    assert len(out) == 18 and {r.model_type for r in out} <= {"trained_model_estimated_spend", "trained_model_baseline_anchored"}


def test_report_measures_r2(spark, plain, models):
    report = {r.horizon_days: r for r in T.training_report(spark, models).collect()}
    assert set(report) == {30, 60, 90} and all(r.cv_r2 is not None for r in report.values())
    assert {h: (r.revenue_trees, r.roas_trees) for h, r in report.items()} == {30: (200, 80), 60: (85, 70), 90: (75, 60)}
    out = T.trained_predictions(plain[0], models)
    assert out.count() == 18 and out.where("lower_revenue > expected_revenue OR expected_revenue > upper_revenue").count() == 0


def test_quartiles_and_correlations_are_exact(spark):
    """Against numpy: nulls, a constant feature and ties."""
    rng = np.random.default_rng(4)
    names = X.FEATURES
    values = np.round(rng.normal(size=(200, len(names))), 1)
    values[:, 3] = 2.0
    y = values[:, 0] * 2 + rng.normal(size=200)
    rows = [(*map(float, v), float(t)) for v, t in zip(values, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*names, "label")))
    df = df.withColumn(names[1], F.when(F.col(names[1]) < 0, None).otherwise(F.col(names[1])))
    kept = {n: values[:, i] if i != 1 else values[values[:, 1] >= 0, 1] for i, n in enumerate(names)}
    got = {r.feature: r for r in T.feature_quartiles(df, names).collect()}
    assert set(got) == set(names)
    for n in names:
        assert got[n].n == len(kept[n]) and np.allclose([got[n].low, got[n].mid, got[n].high], np.quantile(kept[n], [0.25, 0.5, 0.75]))
    signs = {r.feature: r.correlation for r in T.label_correlations(df, "label").collect()}
    assert signs[names[3]] is None
    assert abs(signs[names[0]] - np.corrcoef(values[:, 0], y)[0, 1]) < 1e-9
