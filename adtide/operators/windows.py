"""Trailing windows over daily series.

Windows count observed rows, not calendar days, unless the name says so. They run after the daily
rollup, so one window partition holds at most one row per day of a segment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, safe_ratio
from adtide.functions.tables import attach
from adtide.schema import BLACK_FRIDAYS, HOLIDAY_WEEKS

SEGMENT = ["level", "segment"]


def trailing(by: Sequence[str], rows: int):
    return Window.partitionBy(*by).orderBy("date").rowsBetween(-(rows - 1), 0)


def before(by: Sequence[str], rows: int):
    return Window.partitionBy(*by).orderBy("date").rowsBetween(-rows, -1)


def trailing_sums(
    series: DataFrame, by: Sequence[str], columns: Sequence[str], widths: Sequence[int] = (7, 14, 28, 56)
) -> DataFrame:
    """Sums over the last n rows at every row, so every row is an as-of point."""
    return series.withColumns(
        {f"{c}_{n}": F.sum(c).over(trailing(by, n)) for n in widths for c in columns}
    )


def half_trend(by: Sequence[str], column: str, width: int, low: float = -0.9, high: float = 2.0) -> Column:
    """Change of the mean between the halves of the last ``width`` rows; 0 below four rows.

    Full windows use two fixed frames. The first ``width - 1`` rows of a series, where the split point
    moves, use the short array of those rows only.
    """
    spec = Window.partitionBy(*by).orderBy("date")
    rn = F.row_number().over(spec)
    half = width // 2
    first_full = F.avg(column).over(spec.rowsBetween(-(width - 1), -(width - half)))
    second_full = F.avg(column).over(spec.rowsBetween(-(width - half) + 1, 0))
    # Later rows pass NULL and are skipped, so the array never grows past width - 1 values.
    start = F.collect_list(F.when(F.col("_rn") < width, F.col(column))).over(trailing(by, width))
    mid = F.greatest(F.floor(F.col("_rn") / 2), F.lit(1)).cast("int")

    def mean(arr: Column, n: Column) -> Column:
        return safe_ratio(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), n)

    first = F.when(F.col("_rn") >= width, first_full).otherwise(mean(F.slice(start, F.lit(1), mid), mid))
    second = F.when(F.col("_rn") >= width, second_full).otherwise(
        mean(F.slice(start, mid + 1, F.col("_rn")), F.col("_rn") - mid)
    )
    change = clamp(F.try_divide(second - first, first), low, high)
    return F.when((F.col("_rn") < 4) | (first <= 0), 0.0).otherwise(change)


def with_half_trends(
    series: DataFrame, by: Sequence[str], columns: Sequence[str], widths: Sequence[int] = (28, 56)
) -> DataFrame:
    numbered = series.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("date")))
    return numbered.withColumns(
        {f"{c}_trend_{n}": half_trend(by, c, n) for n in widths for c in columns}
    ).drop("_rn")


def revenue_trend(series: DataFrame, by: Sequence[str]) -> DataFrame:
    numbered = series.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("date")))
    return numbered.withColumn("revenue_trend", half_trend(by, "revenue", 28, -0.25, 0.25)).drop("_rn")


def lag_roll_features(series: DataFrame, by: Sequence[str], target: str = "revenue") -> DataFrame:
    """Lags 1/7/14, means of the 7 and 28 rows before, and guarded rolling deviations."""
    spec = Window.partitionBy(*by).orderBy("date")
    names = list(dict.fromkeys([target, "spend"]))
    cols = {f"{c}_lag_{n}": F.lag(c, n).over(spec) for n in (1, 7, 14) for c in names}
    cols |= {f"{c}_roll_{n}": F.avg(c).over(before(by, n)) for n in (7, 28) for c in names}
    for n, least in ((14, 4), (28, 7)):
        w = trailing(by, n)
        cols[f"rev_std_{n}"] = F.when(F.count("revenue").over(w) >= least, F.stddev_samp("revenue").over(w)).otherwise(0.0)
    return series.withColumns(cols)


def calendar_columns(date: Column, index: Column) -> dict[str, Column]:
    """Weekday (Monday 0), month, quarter and cyclic encodings of a date and a row index."""
    turn = F.lit(2 * math.pi)
    doy = F.dayofyear(date)
    cols = {
        "dow": F.weekday(date).cast("double"),
        "month": F.month(date).cast("double"),
        "day_of_year": doy.cast("double"),
        "quarter": F.quarter(date).cast("double"),
    }
    for period in (7, 30, 365):
        cols[f"sin_{period}"] = F.sin(turn * index / period)
        cols[f"cos_{period}"] = F.cos(turn * index / period)
    cols["sin_year"] = F.sin(turn * doy / 365.25)
    cols["cos_year"] = F.cos(turn * doy / 365.25)
    cols["month_sin"] = F.sin(turn * F.month(date) / 12)
    cols["month_cos"] = F.cos(turn * F.month(date) / 12)
    cols["week_sin"] = F.sin(turn * F.weekofyear(date) / 52.18)
    cols["week_cos"] = F.cos(turn * F.weekofyear(date) / 52.18)
    return cols


def calendar_features(series: DataFrame, by: Sequence[str]) -> DataFrame:
    index = F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1
    return series.withColumns(calendar_columns(F.col("date"), index))


def holiday_features(df: DataFrame, region: str = "US") -> DataFrame:
    """Holiday-week flag, Q4 flag and signed days to the nearest Black Friday.

    The calendar is a fixed list of a few dates, so it is a constant expression, not a join.
    """
    if region.strip().casefold() in {"none", "neutral", "global", "off"}:
        zero = F.lit(0).cast("bigint")
        return df.withColumns({"is_holiday_week": zero, "is_q4": zero, "days_to_black_friday": zero})
    monday = F.date_trunc("week", "date").cast("date")
    distances = F.array(
        *[F.struct(F.abs(F.datediff("date", F.to_date(F.lit(d)))).alias("far"), F.lit(i).alias("i"),
                   F.datediff("date", F.to_date(F.lit(d))).alias("days")) for i, d in enumerate(BLACK_FRIDAYS)]
    )
    return df.withColumns(
        {
            "is_holiday_week": monday.cast("string").isin(HOLIDAY_WEEKS).cast("bigint"),
            "is_q4": (F.month("date") >= 10).cast("bigint"),
            "days_to_black_friday": F.array_min(distances)["days"].cast("bigint"),
        }
    )


def horizon_target(series: DataFrame, by: Sequence[str], horizon: int, column: str = "revenue") -> DataFrame:
    """Sum of the next ``horizon`` rows; NULL where the future is incomplete."""
    ahead = Window.partitionBy(*by).orderBy("date").rowsBetween(1, horizon)
    full = F.count(column).over(ahead) == horizon
    return series.withColumn(f"{column}_next_{horizon}", F.when(full, F.sum(column).over(ahead)))


def one_step_residuals(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value less the mean of up to seven rows before it, for revenue and for ROAS of paid rows."""
    revenue = F.col("revenue") - F.avg("revenue").over(before(by, 7))
    # Unpaid rows sit in their own partition, so the ROAS window skips them without another shuffle.
    paid = F.col("spend") > 1e-9
    ratio = F.when(paid, safe_ratio("revenue", "spend"))
    flagged = series.withColumn("_paid", paid).withColumn("_ratio", ratio)
    roas = F.when(F.col("_paid"), F.col("_ratio") - F.avg("_ratio").over(before([*by, "_paid"], 7)))
    return (
        flagged.withColumn("revenue_residual", revenue)
        .withColumn("roas_residual", roas)
        .drop("_paid", "_ratio")
    )


def zscore(by: Sequence[str], column: str, rows: int = 28, least: int = 7) -> dict[str, Column]:
    """Expected value and z against the rows before; NULL for short or constant history."""
    w = before(by, rows)
    enough = F.count(column).over(w) >= least
    mean, sd = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return {
        "expected": F.when(enough, mean),
        "z": F.when(enough & (sd > 0), F.try_divide(F.col(column) - mean, sd)),
    }


def pct_change_3(series: DataFrame, by: Sequence[str], column: str = "roas") -> DataFrame:
    past = F.lag(column, 3).over(Window.partitionBy(*by).orderBy("date"))
    return series.withColumn(f"{column}_past_3", past).withColumn(
        f"{column}_change_3", F.try_divide(F.col(column), F.col(f"{column}_past_3")) - 1.0
    )


def delta_lag(series: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    spec = Window.partitionBy(*by).orderBy("date")
    deltas = series.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(spec) for c in columns})
    return deltas.withColumns({f"{c}_delta_lag": F.lag(f"{c}_delta").over(spec) for c in columns})


def calendar_complete(daily: DataFrame, by: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per member and calendar day of its account's whole range; missing days are 0."""
    span = daily.groupBy(*keys).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    members = attach(daily.select(*keys, by).distinct(), span, keys)
    days = members.select(*keys, by, F.explode(F.sequence("_from", "_to")).alias("date"))
    filled = days.join(daily.select(*keys, by, "date", *columns), [*keys, by, "date"], "left")
    return filled.select(*keys, by, "date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def comparable_windows(
    daily: DataFrame, by: str, keys: Sequence[str], horizons: Sequence[int] = (30,)
) -> DataFrame:
    """Rolling spend sums over full calendar windows of each horizon."""
    filled = calendar_complete(daily, by, keys, ["spend"])
    part = [*keys, by]
    sized = filled.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy("date")))
    sized = sized.withColumns({f"_w{h}": F.sum("spend").over(trailing(part, h)) for h in horizons})
    rows = F.inline(
        F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(f"_w{h}").alias("window_spend")) for h in horizons])
    )
    return sized.select(*part, "date", "_rn", rows).filter(F.col("_rn") >= F.col("horizon_days")).drop("_rn")


def dow_seasonality(series: DataFrame, by: Sequence[str], columns: Sequence[str] = ("spend",)) -> DataFrame:
    """Weekday profile of the last 28 rows: mean and factor against the window's mean, 1 if unseen."""
    recent = series.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc()))
    ).filter(F.col("_rn") <= 28)
    aggs = []
    for c in columns:
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        aggs += [F.avg(F.when(F.weekday("date") == k, F.col(c))).alias(f"_{c}{k}") for k in range(7)]
    wide = recent.groupBy(*by).agg(*aggs)
    days = F.array(
        *[
            F.struct(
                F.lit(k).alias("weekday"),
                *[F.col(f"_{c}{k}").alias(f"{c}_day") for c in columns],
            )
            for k in range(7)
        ]
    )
    rows = wide.select(*by, *[f"{c}_mean" for c in columns], F.inline(days))
    return rows.withColumns(
        {
            f"{c}_factor": F.when(F.col(f"{c}_day").isNull() | (F.col(f"{c}_mean") <= 0), 1.0).otherwise(
                safe_ratio(f"{c}_day", f"{c}_mean")
            )
            for c in columns
        }
    )
