"""Per-horizon gradient-boosted trees, fit as a grid of tasks and blended with the run-rate baseline."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, lookup, safe_ratio
from adtide.functions.tables import attach
from adtide.operators import boosting
from adtide.operators.boosting import Settings, Trees
from adtide.operators.evaluate import fold_list, fold_states, interpolated_quantiles, parent_channel_pool, walk_forward
from adtide.operators.features import FEATURES, last_features, training_set
from adtide.operators.forecast import POINTS, baseline_points, planned_spend, roas_interval, sanitize_monotone, segment_state
from adtide.operators.rollup import segment_daily
from adtide.operators.windows import SEGMENT, one_step_residuals
from adtide.schema import (
    BASELINE_ANCHORED_SCALE,
    DEFAULT_SELECTED_WEIGHT,
    HORIZON_Z,
    HORIZONS,
    INTERVAL_FLOOR_PCT,
    INTERVAL_MULTIPLIER,
    INTERVAL_MULTIPLIER_LOW_SAMPLE,
    LEVEL_INTERVAL_FACTOR,
    LONG_HORIZON_SCALE,
    MIN_TRAINED_ROWS,
    SAFE_BASELINE,
    TRAINED,
    TRAINED_ANCHORED,
    TRAINED_ESTIMATED_SPEND,
)

# Functions of fits and predictions travel to Python workers by value.
cloudpickle.register_pickle_by_value(boosting)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Revenue weights by holdout evidence, per horizon: strong, fair, beats only, none. Fixed values.
REVENUE_WEIGHTS = {30: (0.60, 0.25, 0.10, 0.10), 60: (0.10, 0.10, 0.10, 0.08), 90: (0.50, 0.40, 0.25, 0.08)}
# Trees, rate, depth, share of rows and of features; ROAS and holdout fits have these trees at rate 0.05 and depth 2. Fixed values.
REVENUE_PARAMS = {30: (200, 0.05, 4, 0.8, 0.8), 60: (85, 0.045, 3, 1.0, 1.0), 90: (75, 0.04, 3, 1.0, 1.0)}
ROAS_TREES = {30: 80, 60: 70, 90: 60}
BAND = {"lower": 0.12, "upper": 0.88}
CV_SPLITS = 3
LOW_SAMPLE_ROWS = 30  # training rows of all horizons together


@dataclass
class HorizonModel:
    """Fitted trees of one horizon and the figures its forecasts need."""

    revenue: Trees
    roas: Trees
    lower: Trees | None
    upper: Trees | None
    revenue_weight: float
    roas_weight: float
    log_bias: float
    residual_sd: float
    diagnostics: dict[str, float | None] = field(default_factory=dict)
    low_sample: bool = False


def revenue_settings(h: int) -> Settings:
    n, rate, depth, rows, features = REVENUE_PARAMS[h]
    return Settings(n, rate, depth, rows, features, 42 + h)


def grid(h: int) -> dict[str, tuple[str, Settings]]:
    """Label and settings of every fit of a horizon."""
    small = Settings(ROAS_TREES[h], 0.05, 2, seed=142 + h)
    fits = {"revenue": ("revenue_target", revenue_settings(h)), "roas": ("roas_target", small),
            "holdout_revenue": ("revenue_target", small), "holdout_roas": ("roas_target", replace(small, seed=243 + h))}
    fits |= {side: ("revenue_target", Settings(45, 0.05, 2, 0.9, seed=340 + h + 100 * (side == "upper"), quantile=q)) for side, q in BAND.items()}
    return fits | {f"cv_{k}": ("revenue_target", revenue_settings(h)) for k in range(CV_SPLITS)}


FITS = "horizon_days int, fold int, task string, n long, figures array<double>, start double, feature array<int>, threshold array<double>, value array<double>, gain array<double>"
_LIST = pa.list_(pa.float64())
FITTED_ROW = pa.schema([("horizon_days", pa.int32()), ("fold", pa.int32()), ("task", pa.string()), ("n", pa.int64()), ("figures", _LIST), ("start", pa.float64()),
                        ("feature", pa.list_(pa.int32())), ("threshold", _LIST), ("value", _LIST), ("gain", _LIST)])
PICKS = 1 << 30


def fit_one(rows: pa.Table) -> pa.Table:
    """One fit of the grid: all rows of a horizon and fold, marked with the task, to its trees and figures.

    Figures: of a cross-validation R2; of the holdouts mean bias, error of the model and of the baseline (for ROAS the mean
    of the training rows) on the last fifth by target end; of the final revenue fit sd of the residuals and mean level.
    Too few rows give no fit.
    """
    if rows.num_rows < MIN_TRAINED_ROWS:
        return FITTED_ROW.empty_table()
    column = lambda c: rows[c].to_numpy()
    turn = np.lexsort((column("pick"), column("pick") % PICKS, column("day")))
    h, fold, task = (rows[c][0].as_py() for c in ("horizon_days", "fold", "task"))
    label, settings = grid(h)[task]
    y, base, actual, n = column(label)[turn], column("baseline_revenue_forecast")[turn], column("future_revenue")[turn], len(turn)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(n, -1)[turn]
    del rows, turn
    revenue = lambda delta, part: np.maximum(np.expm1(np.log1p(np.maximum(base[part], 0.0)) + delta), 0.0)
    if task.startswith("cv_"):
        held = np.random.default_rng(420 + h).permutation(n) % CV_SPLITS == int(task[3:])
        trees = boosting.fit(x[~held], y[~held], settings)
        spread = ((y[held] - y[held].mean()) ** 2).sum()
        figures = [float(1.0 - ((y[held] - trees.predict(x[held])) ** 2).sum() / spread)] if spread > 0 else []
    elif task.startswith("holdout"):
        cut = n - max(1, n // 5)
        trees, last = boosting.fit(x[:cut], y[:cut], settings), slice(cut, n)
        guess = trees.predict(x[last])
        if task == "holdout_revenue":
            bias = float((y[last] - guess).mean())
            figures = [bias, float(np.abs(actual[last] - revenue(guess + bias, last)).mean()), float(np.abs(actual[last] - base[last]).mean())]
        else:
            figures = [0.0, float(np.abs(y[last] - guess).mean()), float(np.abs(y[last] - y[:cut].mean()).mean())]
    else:
        trees, figures = boosting.fit(x, y, settings), []
        if task == "revenue":
            figures = [float(np.std(actual - revenue(trees.predict(x), slice(0, n)), ddof=1)), float(np.abs(actual).mean())]
    kept = trees if not task.startswith(("cv_", "holdout")) else Trees(0.0, *(np.zeros(0),) * 4)
    row = (h, fold, task, n, figures, kept.start, *(v.ravel() for v in (kept.feature, kept.threshold, kept.value, kept.gain)))
    return pa.table([pa.array([v], c.type) for v, c in zip(row, FITTED_ROW, strict=True)], FITTED_ROW)


def vector() -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in FEATURES])


def pick(keys: Sequence[str]) -> Column:
    """A hash of the row's name: the order of the rows of one day in a fit, whatever their partitions."""
    return F.xxhash64(F.lit(420), *keys, *SEGMENT, "date", "horizon_days")


def sample(samples: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """About ``rows`` labelled rows of each horizon and fold by a hash of the row's name; all of them where there are fewer.

    For a look at large training sets. The fits take all rows."""
    marked = samples.withColumn("pick", F.pmod(pick(keys), F.lit(PICKS)) / float(PICKS))
    sizes = marked.groupBy("horizon_days", "fold").agg(F.count("*").alias("of"))
    return marked.join(sizes, ["horizon_days", "fold"]).where((F.col("pick") * F.col("of") < rows) & (F.col("of") >= MIN_TRAINED_ROWS))


def in_folds(samples: DataFrame, last: DataFrame, keys: Sequence[str] = (), folds: int = 0) -> DataFrame:
    """Samples with fold 0, all of them, and each walk-forward fold that starts after the sample's target has ended."""
    df = attach(samples, last, keys)
    mine = F.filter(fold_list(F.col("_last"), folds), lambda f: (f["horizon_days"] == F.col("horizon_days")) & (F.col("target_end") < f["start"])) if folds else F.array()
    number = F.transform(mine, lambda f: f["fold"]) if folds else F.array().cast("array<int>")
    return df.withColumn("fold", F.explode(F.concat(F.array(F.lit(0)), number))).drop("_last")


def fit_grid(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every fit of every horizon and fold on all of its rows, one task each. ``samples`` are rows of the training set with a fold."""
    day = F.datediff("target_end", F.to_date(F.lit("1970-01-01")))
    rows = samples.select("horizon_days", "fold", pick(keys).alias("pick"), day.alias("day"), vector().alias("x"), "revenue_target", "roas_target", "future_revenue", "baseline_revenue_forecast")
    tasks = F.explode(F.array(*[F.lit(t) for t in grid(30)])).alias("task")
    return rows.select("*", tasks).groupBy("horizon_days", "fold", "task").applyInArrow(fit_one, FITS)


def revenue_weight(horizon: int, beats: bool, r2: float | None) -> float:
    """Weight of the trained revenue by holdout evidence; without a measured R2 the two higher tiers are out of reach."""
    strong, fair, only, none = REVENUE_WEIGHTS[horizon]
    if not beats:
        return none
    return only if r2 is None or r2 < 0.05 else fair if r2 < 0.15 else strong


def collected(fits: DataFrame) -> dict[tuple[int, int], HorizonModel]:
    """(horizon, fold) to its model: some ten rows of trees each, whatever the number of samples."""
    found: dict[tuple[int, int], dict] = {}
    for r in fits.collect():
        found.setdefault((r.horizon_days, r.fold), {})[r.task] = r
    few = {fold: sum(t["revenue"].n for (_, k), t in found.items() if k == fold) < LOW_SAMPLE_ROWS for _, fold in found}
    models = {}
    for (h, fold), t in sorted(found.items()):
        r2 = [t[f"cv_{k}"].figures[0] for k in range(CV_SPLITS) if t[f"cv_{k}"].figures]
        cv = float(np.mean(r2)) if r2 else None
        (bias, mae, base_mae), (_, roas_mae, roas_base) = t["holdout_revenue"].figures, t["holdout_roas"].figures
        sd, level = t["revenue"].figures
        models[h, fold] = HorizonModel(
            *[_trees(t[k], grid(h)[k][1]) for k in ("revenue", "roas", "lower", "upper")], revenue_weight(h, mae < base_mae, cv), 0.60 if roas_mae < roas_base else 0.10,
            bias, max(sd, level * 0.05), {"cv_r2": cv, "beats": float(mae < base_mae), "model_mae": mae, "baseline_mae": base_mae, "roas_beats": float(roas_mae < roas_base)}, few[fold])
    return models


def _trees(r, s: Settings) -> Trees:
    inner = 2**s.depth - 1
    return Trees(r.start, np.array(r.feature, np.int64).reshape(-1, inner), np.array(r.threshold).reshape(-1, inner), np.array(r.value).reshape(-1, inner + 1), np.array(r.gain))


def predictor(parts: dict[tuple[int, int], dict[str, Trees]]) -> Callable[..., Column]:
    """A column of predictions by horizon, fold and feature vector; null where there is no model."""
    names = sorted({n for p in parts.values() for n in p})

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def predict(h: pd.Series, fold: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=range(len(x)), columns=names)
        h, fold = h.to_numpy(), fold.to_numpy()
        for (a, b), trees in parts.items():
            at = np.flatnonzero((h == a) & (fold == b))
            if len(at):
                rows = np.stack(x.to_numpy()[at])
                for n, t in trees.items():
                    out.loc[at, n] = t.predict(rows)
        return out

    return predict


def residual_bands(fitted: DataFrame, by: Sequence[str]) -> DataFrame:
    """12% and 88% quantiles of residuals per group, by exact ranks that no single task sorts."""
    return interpolated_quantiles(fitted, by, "residual", {"lower_q": BAND["lower"], "upper_q": BAND["upper"]})


def thin_weight(rows: Column, least: int = MIN_TRAINED_ROWS) -> Column:
    """Shrinks the trained share of segments with little history."""
    return F.when(rows < least, clamp(rows / float(least) * 0.55, 0.15, 0.65)).otherwise(1.0)


def blend(df: DataFrame) -> DataFrame:
    """Trained and baseline figures to one centre.

    Needs trained_revenue, trained_roas, baseline_revenue_forecast, baseline_roas_forecast, revenue_weight,
    roas_weight and history_days.
    """
    base, thin = F.col("baseline_revenue_forecast"), thin_weight(F.col("history_days"))
    w = F.col("revenue_weight") * thin
    held = clamp(F.col("trained_revenue"), base * 0.5, base * 2.5)
    revenue = F.when(base > 0, held * w + base * (1.0 - w)).otherwise(F.greatest("trained_revenue", F.lit(0.0)))
    base_roas, wr = F.col("baseline_roas_forecast"), F.col("roas_weight") * thin
    guarded = clamp(F.col("trained_roas"), 0.0, F.greatest(base_roas * 2.5, F.lit(15.0)))
    roas = F.when(base_roas > 0, guarded * wr + base_roas * (1.0 - wr)).otherwise(guarded)
    return df.withColumns({"expected_revenue": revenue, "blended_roas": roas})


def pooled_z(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, level, segment, pooled_z) of the campaigns with fewer than 30 rows: z of their residuals pooled with those
    of their channel, 0 for constant ones. Campaigns with fewer than 8 pooled residuals have no row."""
    by = [*keys, *SEGMENT]
    z = parent_channel_pool(fact, one_step_residuals(segment_daily(fact, keys), by), keys).filter(F.col("n") >= 8)
    return z.select(*keys, F.lit("campaign").alias("level"), "segment", F.col("z").alias("pooled_z"))


def assemble_interval(df: DataFrame) -> DataFrame:
    """Half width: the largest of model residual, floor, local volatility and the capped quantile band, scaled
    by level, history and horizon.

    Optional columns: pooled_z (see ``pooled_z``) raises z of the model residual, interval_multiplier replaces the
    multiplier of the horizon."""
    h, e = F.col("horizon_days"), F.col("expected_revenue")
    least = MIN_TRAINED_ROWS
    n = F.col("history_days")
    z, wide = lookup(h, HORIZON_Z), lookup(h, INTERVAL_MULTIPLIER)
    z = F.greatest(z, F.col("pooled_z")) if "pooled_z" in df.columns else z
    wide = F.coalesce("interval_multiplier", wide) if "interval_multiplier" in df.columns else wide
    model = z * F.col("residual_sd") * F.greatest(wide, F.lit(1.0))
    floor = e * F.greatest(lookup(h, INTERVAL_FLOOR_PCT), F.lit(0.04))
    local = F.greatest(lookup(h, HORIZON_Z) * F.col("revenue_sd") * F.sqrt(h.cast("double")), e * lookup(h, INTERVAL_FLOOR_PCT))
    base, w = F.col("baseline_revenue_forecast"), F.col("revenue_weight") * thin_weight(n)

    def edge(c: str) -> Column:
        return F.greatest(F.col(c), F.lit(0.0)) * w + base * (1.0 - w)

    cap = e * 0.50 * F.when(n < least, 1.25).otherwise(1.0)
    band = F.least(F.greatest(e - edge("lower_band"), edge("upper_band") - e, F.lit(0.0)), cap)
    level = (
        lookup(F.col("level"), LEVEL_INTERVAL_FACTOR, 1.10)
        + F.when(n < least, 0.12).otherwise(0.0)
        + F.when(n < 2 * least, 0.06).otherwise(0.0)
    )
    anchored = F.when(F.col("revenue_weight") <= 1e-9, lookup(h, BASELINE_ANCHORED_SCALE)).otherwise(1.0)
    half = F.greatest(model, floor, local, band) * clamp(level, 0.95, 1.35) * anchored * lookup(h, LONG_HORIZON_SCALE)
    return df.withColumn("half_width", half).withColumns(
        {"lower_revenue": F.greatest(e - F.col("half_width"), F.lit(0.0)), "upper_revenue": e + F.col("half_width")}
    )


def selected_weight(horizon: int, configured: float, policy: dict[int, float] = DEFAULT_SELECTED_WEIGHT) -> float:
    """The champion policy switches the trained share off where the baseline won."""
    return max(configured, 0.0) if policy.get(horizon, 0.0) > 0 else 0.0


def score(features: DataFrame, models: dict[tuple[int, int], HorizonModel]) -> DataFrame:
    """Forecasts of each vector by the model of its horizon and fold; the caller gives those without one the baseline."""
    predict = predictor({k: {"revenue": m.revenue, "roas": m.roas, "lower": m.lower, "upper": m.upper} for k, m in models.items()})
    figures = {
        "revenue_weight": lambda h, m: selected_weight(h, m.revenue_weight), "roas_weight": lambda h, m: m.roas_weight, "residual_sd": lambda h, m: m.residual_sd,
        "_bias": lambda h, m: m.log_bias, "interval_multiplier": lambda h, m: (INTERVAL_MULTIPLIER_LOW_SAMPLE if m.low_sample else INTERVAL_MULTIPLIER)[h],
    }
    of = F.struct("horizon_days", "fold")
    known = {c: F.coalesce(*[F.when(of == F.struct(F.lit(h), F.lit(k)), F.lit(float(f(h, m)))) for (h, k), m in models.items()]) for c, f in figures.items()}
    rows = features.withColumns(known).where(F.col("residual_sd").isNotNull()).withColumn("_p", predict("horizon_days", "fold", vector()))
    centre = F.log1p(F.greatest("baseline_revenue_forecast", F.lit(0.0))) + F.col("_bias")
    return rows.withColumns(
        {
            "trained_revenue": F.expm1(centre + F.col("_p.revenue")),
            "lower_band": F.expm1(centre + F.col("_p.lower")),
            "upper_band": F.expm1(centre + F.col("_p.upper")),
            "trained_roas": F.col("_p.roas"),
        }
    ).drop("_p", "_bias")


def trained_points(vectors: DataFrame, state: DataFrame, models: dict[tuple[int, int], HorizonModel], by: Sequence[str], pooled: DataFrame | None = None) -> DataFrame:
    """(by, horizon_days, points, model_type) of the vectors that have a model and a figure from it."""
    df = blend(score(vectors, models)).join(state, list(by))
    if pooled is not None:
        df = df.join(pooled, [c for c in by if c in pooled.columns], "left")
    df = assemble_interval(df)
    if "expected_spend" not in df.columns:
        df = df.withColumn("expected_spend", F.col("spend_28") / F.least(F.col("n"), F.lit(28)) * F.col("horizon_days"))
    df = roas_interval(df, F.col("blended_roas"))
    df = df.withColumn("model_type", F.when(F.col("revenue_weight") <= 1e-9, TRAINED_ANCHORED).otherwise(TRAINED))
    kept = list(dict.fromkeys([*by, "horizon_days", *POINTS, "model_type"]))
    return df.select(*kept).filter(F.col("expected_revenue").isNotNull() & ~F.isnan("expected_revenue"))


def with_plan(vectors: DataFrame, planned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vectors under a plan (``planned_spend``): planned spend where the segment has a budget, else its 7-day run rate."""
    h = F.col("horizon_days")
    run = F.col("spend_28") / F.least(F.col("n"), F.lit(28)) * h
    budgeted = F.greatest(F.col("planned_daily_spend") * h, F.lit(0.0))
    spend = F.when(F.coalesce("has_budget", F.lit(False)), budgeted).otherwise(F.col("projected_spend_horizon"))
    df = vectors.join(planned, [*keys, *SEGMENT], "left").withColumns({"projected_spend_horizon": spend, "expected_spend": spend})
    delta = safe_ratio(F.col("expected_spend") - run, run)
    return df.withColumn("planned_spend_delta_28_horizon", delta).drop("planned_daily_spend", "has_budget")


def trained_predictions(
    features: DataFrame,
    models: dict[tuple[int, int], HorizonModel],
    keys: Sequence[str] = (),
    fact: DataFrame | None = None,
    budgets: DataFrame | None = None,
    estimated: DataFrame | None = None,
) -> DataFrame:
    """All segments and horizons in the output contract. ``features`` are unfiltered as-of vectors.

    ``fact``, the campaign fact behind them, widens the intervals of thin campaigns by ``pooled_z``. ``budgets`` (keys, channel,
    budget for 30 days; needs ``fact``) replace the run-rate spend of their channels. ``estimated`` has one row (keys,
    spend_estimated) for each key, as ``estimate_missing_spend`` marks them, and labels the forecasts that rest on such spend.

    A horizon without a fitted model, and any segment that a model gives no figure, takes the safe baseline.
    """
    by = [*keys, *SEGMENT]
    state = segment_state(features.filter(F.col("horizon_days") == HORIZONS[0]).select(*by, "date", *["spend", "revenue"]), keys)
    planned = None if budgets is None else planned_spend(fact, budgets, keys)
    safe = baseline_points(state, planned, keys).select(*by, "horizon_days", *POINTS, F.lit(SAFE_BASELINE).alias("model_type"))
    now = {k: m for k, m in models.items() if k[1] == 0}
    if not now:
        return sanitize_monotone(safe, keys)
    vectors = last_features(features, keys).withColumn("fold", F.lit(0))
    if planned is not None:
        vectors = with_plan(vectors, planned, keys)
    fitted = trained_points(vectors, state.select(*by, "revenue_sd", "roas_residuals", "roas_sd"), now, by, None if fact is None else pooled_z(fact, keys))
    if estimated is not None:
        label = F.when(F.col("spend_estimated") & (F.col("model_type") == TRAINED), TRAINED_ESTIMATED_SPEND).otherwise(F.col("model_type"))
        fitted = attach(fitted, estimated, keys).withColumn("model_type", label).drop("spend_estimated")
    rest = safe.join(fitted.select(*by, "horizon_days"), [*by, "horizon_days"], "left_anti")
    return sanitize_monotone(fitted.unionByName(rest.select(fitted.columns)), keys)


def trained_walk_forward(features: DataFrame, daily: DataFrame, models: dict[tuple[int, int], HorizonModel], keys: Sequence[str] = (), folds: int = 4) -> DataFrame:
    """``walk_forward`` with the forecasts of each fold's own models in ``trained_*`` and their ``model_type``.

    A fold's models saw samples whose targets ended before its start (``in_folds``), and its vectors are those of each
    segment's last day before it. Folds without a model take the safe forecast.
    """
    by, at = [*keys, *SEGMENT], [*keys, *SEGMENT, "horizon_days", "fold"]
    safe = walk_forward(daily, keys, folds).drop("_run_rate")
    states = fold_states(daily, keys, folds)
    cut = states.select(*at, F.col("last_date").alias("date"))
    vectors = features.join(cut, [*by, "horizon_days", "date"])
    trained = trained_points(vectors, states.select(*at, "revenue_sd", "roas_residuals", "roas_sd"), models, at)
    renamed = trained.select(*at, "model_type", *[F.col(p).alias(f"trained_{p}") for p in POINTS])
    df = safe.join(renamed, at, "left")
    own = {f"trained_{p}": F.coalesce(f"trained_{p}", f"safe_{p}") for p in POINTS}
    return df.withColumns({**own, "model_type": F.coalesce("model_type", F.lit(SAFE_BASELINE))})


def fit_all(features: DataFrame, keys: Sequence[str] = (), folds: int = 0, samples: DataFrame | None = None) -> dict[tuple[int, int], HorizonModel]:
    """Models by horizon and fold, fit on all rows, where there are enough: fold 0 on all, ``folds`` more for a walk-forward.

    ``samples`` is the training set of the features, if it is written already."""
    last = features.groupBy(*keys).agg(F.max("date").alias("_last"))
    samples = training_set(features, keys) if samples is None else samples
    return collected(fit_grid(in_folds(samples, last, keys, folds), keys))


def training_report(spark: SparkSession, models: dict[tuple[int, int], HorizonModel]) -> DataFrame:
    """Evidence and weights of each fitted horizon: three rows of model scalars."""
    fields = ("cv_r2", "beats", "model_mae", "baseline_mae", "roas_beats")
    rows = [
        (h, *(None if m.diagnostics[f] is None else float(m.diagnostics[f]) for f in fields), float(m.revenue_weight), float(m.roas_weight),
         float(m.log_bias), float(m.residual_sd), len(m.revenue.value), len(m.roas.value))
        for (h, fold), m in models.items() if fold == 0
    ]
    names = ", ".join(f"{f} double" for f in (*fields, "revenue_weight", "roas_weight", "log_bias", "residual_sd"))
    return spark.createDataFrame(rows, f"horizon_days int, {names}, revenue_trees int, roas_trees int")


def estimate_missing_spend(fact: DataFrame, benchmarks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend from benchmark ROAS for keys whose spend is all 0 although they have revenue."""
    totals = fact.groupBy(*keys).agg(F.sum("spend").alias("_s"), F.sum("revenue").alias("_r"))
    df = attach(fact, totals, keys)

    def side(level: str, column: str) -> DataFrame:
        return benchmarks.filter(F.col("level") == level).select(F.col("segment").alias(column), F.col("benchmark_roas").alias(f"_{column}"))

    df = df.join(side("channel", "channel"), "channel", "left").join(side("campaign_type", "campaign_type"), "campaign_type", "left")
    overall = benchmarks.filter(F.col("level") == "overall").select("benchmark_roas").scalar()
    roas = clamp(F.coalesce("_channel", "_campaign_type", overall), 0.5, 25.0)
    needed = (F.col("_s") <= 1e-9) & (F.col("_r") > 1e-9)
    spend = F.when(needed, F.when(F.col("revenue") > 0, F.col("revenue") / roas).otherwise(0.0)).otherwise(F.col("spend"))
    out = df.withColumns({"spend": spend, "spend_estimated": needed})
    return out.withColumn("roas", safe_ratio("revenue", "spend")).drop("_s", "_r", "_channel", "_campaign_type")


def label_correlations(samples: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, correlation) of every feature with the label, all in one pass; null for constant ones."""
    y = F.col(label)

    def correlation(f: str) -> Column:
        spread = F.stddev_pop(f) * F.stddev_pop(y)
        return F.when(spread > 1e-12, F.covar_pop(F.col(f), y) / spread)

    one = samples.groupBy(*by).agg(*[correlation(f).alias(f"_r_{f}") for f in FEATURES])
    return one.select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_r_{f}").alias("correlation")) for f in FEATURES])))


def feature_quartiles(samples: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, n, mid, low, high): exact interpolated median and quartiles, found by rank without sorting a feature in one task."""
    long = samples.select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    return interpolated_quantiles(long, [*by, "feature"], "value", {"mid": 0.5, "low": 0.25, "high": 0.75})


def feature_importance(model: Trees, samples: DataFrame, label: str, n: int = 6) -> DataFrame:
    """Normalised importance of the top features, signed by their correlation with the label."""
    weights = {f: float(w) for f, w in zip(FEATURES, model.gain, strict=True)}
    total = sum(weights.values()) or 1.0
    share = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w / total * 100.0)])
    rows = label_correlations(samples, label).select("feature", share[F.col("feature")].alias("importance"), "correlation")
    sign = F.when(F.col("correlation") < 0, "negative").otherwise("positive")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(n).withColumn("direction", sign)


def local_drivers(
    current: DataFrame, samples: DataFrame, model: Trees, features: Sequence[str], by: Sequence[str], n: int = 3
) -> DataFrame:
    """Largest prediction change when one feature takes its median or a quartile; top n each way per row.

    All replacements are rows of one frame, so the model runs once over segments x features x 3.
    """
    values = feature_quartiles(samples, features).select("feature", F.explode(F.array("mid", "low", "high")).alias("value"))
    # One row of at most three values per feature.
    quartiles = values.agg(F.collect_list(F.struct("feature", "value")).alias("_q"))
    rows = attach(current, quartiles, ()).withColumn("_o", F.explode("_q")).drop("_q")
    changed = rows.withColumns({f: F.when(F.col("_o.feature") == f, F.col("_o.value")).otherwise(F.col(f)) for f in features})
    predict = predictor({(0, 0): {"p": model}})
    guess = predict(F.lit(0), F.lit(0), vector())["p"]
    before = current.select(*by, guess.alias("_before"))
    after = changed.select(*by, F.col("_o.feature").alias("feature"), guess.alias("_after"))
    impact = after.join(before, list(by)).withColumn("impact", F.col("_before") - F.col("_after"))
    strongest = impact.groupBy(*by, "feature").agg(F.max_by("impact", F.abs("impact")).alias("impact"))
    kept = strongest.filter(F.abs("impact") > 1e-6).withColumn("direction", F.when(F.col("impact") > 0, "positive").otherwise("negative"))
    rank = F.row_number().over(Window.partitionBy(*by, "direction").orderBy(F.abs("impact").desc(), F.col("feature")))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= n)
