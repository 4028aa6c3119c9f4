"""Column helpers. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def as_col(value: ColumnLike) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def safe_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, 0 where the denominator is 0 (ANSI division would raise)."""
    return F.coalesce(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")), F.lit(0.0))


def pct_change(new: ColumnLike, old: ColumnLike) -> Column:
    return safe_ratio(as_col(new) - as_col(old), old) * 100.0


def clamp(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    low_col = as_col(low) if not isinstance(low, (int, float)) else F.lit(float(low))
    high_col = as_col(high) if not isinstance(high, (int, float)) else F.lit(float(high))
    return F.least(F.greatest(as_col(value), low_col), high_col)


def non_negative(value: ColumnLike) -> Column:
    """Negative, missing and non-finite values become 0."""
    v = as_col(value).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")), 0.0).otherwise(v)


def round_to(value: ColumnLike, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: one rule for every rounded output."""
    scale = float(10**digits)
    return F.floor(as_col(value) * scale + 0.5).cast("double") / scale


def clean_number(value: ColumnLike) -> Column:
    """Two-digit rounding; missing, non-finite and tiny values become 0."""
    v = as_col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (F.abs(v) < 0.005)
    return F.when(bad, 0.0).otherwise(round_to(v, 2))


def round_score(value: ColumnLike) -> Column:
    return F.least(F.greatest(F.floor(as_col(value) + 0.5), F.lit(0)), F.lit(100)).cast("bigint")


def lookup(key: Column, table: Mapping[int | str, float], default: float | None = None) -> Column:
    """A constant table as one CASE expression."""
    expr = reduce(
        lambda acc, item: acc.when(key == item[0], F.lit(item[1])),
        list(table.items())[1:],
        F.when(key == next(iter(table)), F.lit(next(iter(table.values())))),
    )
    return expr if default is None else expr.otherwise(F.lit(default))


def present(flags: Iterable[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in flags]))


def explode_values(values: Iterable[float | int]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def normal_two_sided_p(t: ColumnLike) -> Column:
    """erfc(|t| / sqrt 2) by the Abramowitz-Stegun 7.1.26 polynomial (error below 1.5e-7)."""
    x = F.abs(as_col(t)) / F.sqrt(F.lit(2.0))
    k = 1.0 / (x * 0.3275911 + 1.0)
    poly = k * (
        (k * (k * (k * (k * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736)) + 0.254829592
    )
    return poly * F.exp(-x * x)


def spend_response(multiplier: ColumnLike) -> Column:
    """Concave response of revenue to a spend multiplier, linear between 1.0 and 1.5."""
    m = as_col(multiplier)
    return (
        F.when(m <= 0, 0.0)
        .when(m < 1.0, F.least(F.pow(m, F.lit(0.72)), m * 1.35))
        .when(m <= 1.5, m)
        .otherwise((m - 1.5) * F.pow(m / 1.5, F.lit(-0.45)) + 1.5)
    )


def elasticity_plan(trend_pct: ColumnLike) -> Column:
    return clamp(as_col(trend_pct) / 400.0 + 0.72, 0.55, 0.92)


def elasticity_simulation(trend_pct: ColumnLike) -> Column:
    return clamp(as_col(trend_pct) / 500.0 + 0.78, 0.58, 0.92)


def power_response(revenue: ColumnLike, ratio: ColumnLike, elasticity: ColumnLike) -> Column:
    r = as_col(ratio)
    return F.when(r <= 0, 0.0).otherwise(as_col(revenue) * F.pow(r, as_col(elasticity)))


def freshness(days_old: ColumnLike, future_rows: ColumnLike) -> Column:
    d = as_col(days_old)
    return (
        F.when((as_col(future_rows) > 0) | (d < 0), 0.0)
        .when(d <= 7, 100.0)
        .when(d <= 30, 100.0 - (d - 7) * (25.0 / 23.0))
        .when(d <= 90, 75.0 - (d - 30) * (45.0 / 60.0))
        .when(d <= 180, 30.0 - (d - 90) * (30.0 / 90.0))
        .otherwise(0.0)
    )


def confidence_label(
    width: ColumnLike, revenue: ColumnLike, roas: ColumnLike, low: ColumnLike, high: ColumnLike
) -> Column:
    none = (as_col(roas) <= 0) & (as_col(low) <= 0) & (as_col(high) <= 0)
    w = F.greatest(as_col(width), F.lit(0.0))
    return (
        F.when(none | (as_col(revenue) <= 0), "not_computable")
        .when(w <= 30.0, "high")
        .when(w <= 60.0, "medium")
        .otherwise("low")
    )


def correlation(x: str, y: str, min_obs: int = 6) -> Column:
    """Pearson correlation over complete pairs; NULL for short or constant input (never raises)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    value = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    usable = (F.count(px) >= min_obs) & (F.stddev_pop(px) > 1e-12) & (F.stddev_pop(py) > 1e-12)
    return F.when(usable, value)


def draw_index(rep: ColumnLike, pos: ColumnLike, n: ColumnLike) -> Column:
    """Counter-based resampling index in [0, n): depends on its inputs only, not on partitioning."""
    mixed = F.pmod(
        as_col(rep).cast("bigint") * 7919 + as_col(pos).cast("bigint") * 104729 + 12345, F.lit(1000003)
    )
    mixed = F.pmod(mixed * mixed + mixed * 31 + 17, F.lit(1000003))
    return F.pmod(mixed, as_col(n))


def evidence_hash(struct: Column) -> Column:
    return F.substring(F.sha2(F.to_json(struct), 256), 1, 16)
