"""Rollups: one pass to the daily grain, then small frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import clamp, pct_change, round_to, safe_ratio
from adtide.functions.tables import attach
from adtide.schema import MEASURES
from adtide.session import checkpoint


def sums(columns: Sequence[str] = MEASURES) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def with_roas(df: DataFrame) -> DataFrame:
    return df.withColumn("roas", safe_ratio("revenue", "spend"))


def fact_rollup(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum measures at the finest grain and recompute ROAS."""
    grain = [*keys, "date", "channel", "campaign_type", "campaign_name"]
    return with_roas(fact.groupBy(*grain).agg(*sums()))


def daily_totals(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_roas(fact.groupBy(*keys, "date").agg(*sums()))


def daily_channel(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    daily = with_roas(fact.groupBy(*keys, "date", "channel").agg(*sums()))
    return daily.withColumn("ctr", safe_ratio("clicks", "impressions"))


def segment_daily(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily series at all four grains from one grouping-sets aggregation."""
    dims = ["channel", "campaign_type", "campaign_name"]
    sets = [[*keys, "date"], *[[*keys, "date", d] for d in dims]]
    grouped = fact.groupingSets(sets, *keys, "date", *dims).agg(F.grouping_id().alias("gid"), *sums())
    level = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "channel").when(
        F.col("gid") == 5, "campaign_type"
    ).otherwise("campaign")
    named = grouped.select(
        *keys,
        level.alias("level"),
        F.when(F.col("gid") == 7, "all")
        .otherwise(F.coalesce(*[F.col(d) for d in dims]))
        .alias("segment"),
        "date",
        *MEASURES,
    )
    return with_roas(named.filter(F.col("segment").isNotNull() & (F.col("segment") != "")))


def with_last_day(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds last_day, the latest date of each key (of all rows without keys)."""
    return attach(daily, daily.groupBy(*keys).agg(F.max("date").alias("last_day")), keys)


def channel_summary(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per channel plus the last 30 and the 30 before, on the calendar of all channels."""
    daily = fact.groupBy(*keys, "channel", "date").agg(*sums())
    dated = with_last_day(daily, keys).withColumn("age", F.datediff("last_day", "date"))
    recent, previous = F.col("age") < 30, (F.col("age") >= 30) & (F.col("age") < 60)

    def part(cond: Column, column: str, name: str) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0.0)).alias(name)

    return with_roas(
        dated.groupBy(*keys, "channel").agg(
            *sums(),
            F.count("*").alias("days_active"),
            part(recent, "spend", "recent_spend"),
            part(recent, "revenue", "recent_revenue"),
            part(previous, "spend", "previous_spend"),
            part(previous, "revenue", "previous_revenue"),
            F.greatest(F.count(F.when(recent, 1)), F.lit(1)).alias("recent_days"),
            F.greatest(F.count(F.when(previous, 1)), F.lit(1)).alias("previous_days"),
        )
    )


def tail_rank(keys: Sequence[str]) -> Column:
    """1 for the latest observed date, counting rows backwards."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))


def portfolio_kpis(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, last-30 against prior-30 observed days, profit and marginal ROAS."""
    # Pre-aggregated to (day, campaign) so that the distinct count and the day windows see few rows.
    daily = fact.groupBy(*keys, "date").agg(*sums()).withColumn("rn", tail_rank(keys))
    recent, prior = F.col("rn") <= 30, (F.col("rn") > 30) & (F.col("rn") <= 60)

    def part(cond: Column, column: str) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0.0))

    totals = daily.groupBy(*keys).agg(
        *sums(),
        F.count("*").alias("days"),
        F.count(F.when(recent, 1)).alias("recent_days"),
        part(recent, "revenue").alias("recent_revenue"),
        part(recent, "spend").alias("recent_spend"),
        part(prior, "revenue").alias("prior_revenue"),
        part(prior, "spend").alias("prior_spend"),
    )
    campaigns = (
        fact.groupBy(*keys, "channel", "campaign_name").agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count("*").alias("campaigns"))
    )
    joined = totals.join(campaigns, list(keys)) if keys else totals.withColumn(
        "campaigns", campaigns.scalar()
    )
    last_roas = safe_ratio("recent_revenue", "recent_spend")
    spend_delta = F.col("recent_spend") - F.col("prior_spend")
    revenue_delta = F.col("recent_revenue") - F.col("prior_revenue")

    def or_one(column: str) -> Column:
        return F.when(F.col(column) == 0, 1.0).otherwise(F.col(column))

    return with_roas(joined).select(
        *keys,
        *MEASURES,
        "days",
        "campaigns",
        "roas",
        "recent_revenue",
        "recent_spend",
        "recent_days",
        last_roas.alias("recent_roas"),
        pct_change("recent_revenue", or_one("prior_revenue")).alias("revenue_delta_pct"),
        pct_change("recent_spend", or_one("prior_spend")).alias("spend_delta_pct"),
        pct_change(last_roas, safe_ratio("prior_revenue", "prior_spend")).alias("roas_delta_pct"),
        (F.col("recent_revenue") - F.col("recent_spend")).alias("recent_profit"),
        (F.col("prior_revenue") - F.col("prior_spend")).alias("prior_profit"),
        F.when(spend_delta > 0, safe_ratio(revenue_delta, spend_delta)).otherwise(last_roas).alias(
            "marginal_roas"
        ),
    )


def channel_mix(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    by_channel = with_roas(fact.groupBy(*keys, "channel").agg(*sums(["spend", "revenue"])))
    share = safe_ratio("revenue", F.sum("revenue").over(Window.partitionBy(*keys))) * 100.0
    return by_channel.withColumn("share_pct", share)


def campaign_leaderboard(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_roas(
        fact.groupBy(*keys, "channel", "campaign_name").agg(
            *sums(), F.min("campaign_type").alias("campaign_type")
        )
    )


def campaign_type_breakdown(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_roas(fact.groupBy(*keys, "campaign_type").agg(*sums()))


def monthly_channel(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    month = F.trunc("date", "MM").alias("month")
    return with_roas(fact.groupBy(*keys, "channel", month).agg(*sums()))


def month_over_month(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys, "channel").orderBy("month")
    return monthly_channel(fact, keys).select(
        *keys, "channel", "month", "spend", "revenue",
        F.lag("spend").over(w).alias("previous_spend"),
        F.lag("revenue").over(w).alias("previous_revenue"),
    )


def roas_benchmarks(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall, channel and campaign-type ROAS of rows with money on both sides, held to [0.5, 25]."""
    paid = fact.filter((F.col("spend") > 0) & (F.col("revenue") > 0))
    sets = [[*keys], [*keys, "channel"], [*keys, "campaign_type"]]
    grouped = paid.groupingSets(sets, *keys, "channel", "campaign_type").agg(
        F.grouping_id().alias("gid"), *sums(["spend", "revenue"])
    )
    value = F.when(F.col("spend") > 0, safe_ratio("revenue", "spend")).otherwise(4.0)
    return grouped.select(
        *keys,
        F.when(F.col("gid") == 3, "overall")
        .when(F.col("gid") == 1, "channel")
        .otherwise("campaign_type")
        .alias("level"),
        F.coalesce("channel", "campaign_type", F.lit("all")).alias("segment"),
        clamp(value, 0.5, 25.0).alias("benchmark_roas"),
    )


def few_codes(fact: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``category_codes`` of a dimension with few values for each key, such as channels and types: ranked in one window."""
    values = fact.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value")).distinct()
    code = F.dense_rank().over(Window.partitionBy(*keys).orderBy("value"))
    return values.withColumn("code", code.cast("bigint"))


def category_codes(fact: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Alphabetical codes 1..n of a dimension's distinct values, however many; nulls have none.

    Values are dealt to ranges in their order and written once; a code is the number of values in the earlier ranges of
    the key, one sum per range, and the rank within the range.
    """
    values = fact.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value")).distinct()
    dealt = checkpoint(values.repartitionByRange(*keys, "value").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    listed = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_s"))

    def start(s: Column, i: Column) -> Column:
        earlier = F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x["_n"])
        return F.struct(s["_range"].alias("_range"), earlier.alias("_start"))

    starts = listed.select(*keys, F.inline(F.transform("_s", start)))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("value")))
    joined = ranked.join(starts, [*keys, "_range"])
    return joined.select(*keys, "value", (F.col("_start") + F.col("_rank")).alias("code"))


def encode_category(fact: DataFrame, codes: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Attach codes; values missing from the map become 0."""
    renamed = codes.withColumnRenamed("value", column).withColumnRenamed("code", f"{column}_code")
    joined = fact.join(renamed, [*keys, column], "left")
    return joined.withColumn(f"{column}_code", F.coalesce(F.col(f"{column}_code"), F.lit(0).cast("bigint")))


def unseen_categories(fact: DataFrame, codes: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct values that the trained map does not know."""
    # Rows are counted per value before anything meets the map, so a hot value is one row here.
    observed = (
        fact.select(*keys, F.trim(F.col(column)).alias("value"))
        .filter(F.col("value") != "")
        .groupBy(*keys, "value").agg(F.count("*").alias("n"))
    )
    unseen = observed.join(codes.select(*keys, "value"), [*keys, "value"], "left_anti")
    # Only the first five values of a key are ranked, so each task passes on five.
    first = unseen.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).filter(F.col("rk") <= 5)
    preview = first.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda s: s["value"]), ", ").alias("preview")
    )
    totals = unseen.groupBy(*keys).agg(
        F.lit(column).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("unseen_rows"), F.count("*").alias("unseen_values")
    )
    out = attach(totals, preview, keys)
    return out.withColumn("preview", F.coalesce("preview", F.lit("")))


def channel_evidence_metrics(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last-30 against previous-30 calendar days per channel, with the dominant campaign type.

    A channel without rows in one of the windows falls back to a half of its own observed days.
    """
    by_type = fact.groupBy(*keys, "channel", "campaign_type", "date").agg(*sums(["spend", "revenue"]))
    daily = by_type.groupBy(*keys, "channel", "date").agg(*sums(["spend", "revenue"]))
    w = Window.partitionBy(*keys, "channel")
    dated = (
        with_last_day(daily, keys).withColumn("age", F.datediff("last_day", "date"))
        .withColumn("rn", F.row_number().over(w.orderBy("date")))
        .withColumn("n", F.count("*").over(w))
    )
    recent, prior = F.col("age") < 30, (F.col("age") >= 30) & (F.col("age") < 60)
    half = F.floor(F.col("n") / 2)
    early, late = F.col("rn") <= F.greatest(half, F.lit(1)), F.col("rn") > half

    def part(cond: Column, column: str, name: str) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0.0)).alias(name)

    agg = dated.groupBy(*keys, "channel").agg(
        F.count(F.when(recent, 1)).alias("n_recent"),
        F.count(F.when(prior, 1)).alias("n_prior"),
        *[
            part(cond, c, f"{name}_{c}")
            for name, cond in [("recent", recent), ("prior", prior), ("early", early), ("late", late)]
            for c in ("spend", "revenue")
        ],
    )
    dominant = (
        by_type.groupBy(*keys, "channel", "campaign_type").agg(F.sum("revenue").alias("revenue"))
        .groupBy(*keys, "channel")
        .agg(F.min_by("campaign_type", F.struct(-F.col("revenue"), F.col("campaign_type"))).alias("campaign_type"))
    )
    chosen = agg.select(
        *keys,
        "channel",
        *[
            F.when(F.col("n_prior") > 0, F.col(f"prior_{c}")).otherwise(F.col(f"early_{c}")).alias(f"baseline_{c}")
            for c in ("spend", "revenue")
        ],
        *[
            F.when(F.col("n_recent") > 0, F.col(f"recent_{c}")).otherwise(F.col(f"late_{c}")).alias(f"observed_{c}")
            for c in ("spend", "revenue")
        ],
    )
    return chosen.join(dominant, [*keys, "channel"]).select(
        *keys,
        "channel",
        "campaign_type",
        "baseline_revenue",
        "observed_revenue",
        safe_ratio("baseline_revenue", "baseline_spend").alias("baseline_roas"),
        safe_ratio("observed_revenue", "observed_spend").alias("observed_roas"),
    )


def recent_vs_previous(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last 30 observed rows of a daily series against the 30 before them."""
    ranked = series.withColumn("rn", tail_rank(by)).filter(F.col("rn") <= 60)
    recent = F.col("rn") <= 30

    def part(cond: Column, column: str, name: str) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0.0)).alias(name)

    agg = ranked.groupBy(*by).agg(
        *[part(recent, c, f"recent_{c}") for c in ("revenue", "spend")],
        *[part(~recent, c, f"previous_{c}") for c in ("revenue", "spend")],
    )
    both = agg.withColumns(
        {
            "recent_roas": safe_ratio("recent_revenue", "recent_spend"),
            "previous_roas": safe_ratio("previous_revenue", "previous_spend"),
        }
    )
    return both.withColumns(
        {f"{c}_trend_pct": pct_change(f"recent_{c}", f"previous_{c}") for c in ("revenue", "spend", "roas")}
    )


def run_rate_direction(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily average of the last 30 observed days against the 30 before (or the whole history)."""
    daily = fact.groupBy(*keys, "date").agg(*sums(["spend", "revenue"])).withColumn("rn", tail_rank(keys))
    recent, prior = F.col("rn") <= 30, (F.col("rn") > 30) & (F.col("rn") <= 60)
    agg = daily.groupBy(*keys).agg(
        safe_ratio(F.sum("revenue"), F.sum("spend")).alias("blended_roas"),
        safe_ratio(F.sum(F.when(recent, F.col("revenue"))), F.count(F.when(recent, 1))).alias("recent_daily_avg"),
        F.when(
            F.count(F.when(prior, 1)) > 0,
            safe_ratio(F.sum(F.when(prior, F.col("revenue"))), F.count(F.when(prior, 1))),
        ).otherwise(safe_ratio(F.sum("revenue"), F.count("*"))).alias("trailing_daily_avg"),
    )
    delta = pct_change("recent_daily_avg", "trailing_daily_avg")
    return agg.withColumn("revenue_delta_pct", delta).withColumn(
        "direction",
        F.when(F.col("revenue_delta_pct") > 2.0, "up")
        .when(F.col("revenue_delta_pct") < -2.0, "down")
        .otherwise("flat"),
    )


def weighted_average(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    w = F.greatest(F.col(weight), F.lit(0.0))
    return df.groupBy(*keys).agg(safe_ratio(F.sum(F.col(value) * w), F.sum(w)).alias("weighted_average"))


def count_by(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def top_n(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """First n rows per key; without keys the plan is a distributed top-k, not a one-task sort."""
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def best_worst_channel(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Strongest and weakest ROAS channel, and the value of moving 10% of the weakest one's spend."""
    mix = with_roas(fact.groupBy(*keys, "channel").agg(*sums(["spend", "revenue"])))
    picked = mix.groupBy(*keys).agg(
        F.min_by(F.struct("channel", "roas", "spend"), F.struct(-F.col("roas"), F.col("channel"))).alias("best"),
        F.min_by(F.struct("channel", "roas", "spend"), F.struct("roas", "channel")).alias("worst"),
    )
    gap = F.greatest(F.col("best.roas") - F.col("worst.roas"), F.lit(0.0))
    return picked.select(
        *keys,
        F.col("best.channel").alias("best_channel"),
        F.col("best.roas").alias("best_roas"),
        F.col("worst.channel").alias("worst_channel"),
        F.col("worst.roas").alias("worst_roas"),
        F.col("best.spend").alias("best_spend"),
        F.col("worst.spend").alias("worst_spend"),
        (F.col("worst.spend") * 0.1 * gap).alias("reallocation_value"),
    )


def downsample_series(series: DataFrame, keys: Sequence[str] = (), limit: int = 120, step: int = 3) -> DataFrame:
    """Every third row plus the last one for series longer than the limit (a chart feature)."""
    w = Window.partitionBy(*keys)
    numbered = series.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn(
        "_n", F.count("*").over(w)
    )
    keep = (F.col("_n") <= limit) | (F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)
    return numbered.filter(keep).drop("_i", "_n")


def distinct_members(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct channels, campaign types and campaigns as (dimension, member) rows."""
    dims = ["channel", "campaign_type", "campaign_name"]
    sets = [[*keys, d] for d in dims]
    grouped = fact.groupingSets(sets, *keys, *dims).agg(F.grouping_id().alias("gid"))
    return grouped.select(
        *keys,
        F.when(F.col("gid") == 3, "channel").when(F.col("gid") == 5, "campaign_type").otherwise("campaign")
        .alias("dimension"),
        F.coalesce(*[F.col(d) for d in dims]).alias("member"),
    ).filter(F.col("member").isNotNull())
