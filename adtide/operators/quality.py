"""Row-level validation, the repair policy, and level filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import present, safe_ratio
from adtide.functions.tables import attach
from adtide.functions.text import finite, parse_date, unless_blank
from adtide.operators.rollup import fact_rollup
from adtide.schema import CANONICAL_COLUMNS, LEVEL_COLUMNS, MEASURES, TEXT_DEFAULTS, TEXT_DIMS
from adtide.session import checkpoint

ROW_KEY = ["date", "channel", "campaign_name"]


def filter_level(fact: DataFrame, level: str, value: str | None = None) -> DataFrame:
    """Rows of one segment; the overall level keeps all rows. The filter reaches the scan."""
    if level not in LEVEL_COLUMNS or not value:
        return fact
    return fact.filter(F.col(LEVEL_COLUMNS[level]) == value)


def comparable_rows(fact: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows on the last ``horizon`` distinct dates: ranked on the date list, not on the rows."""
    dates = fact.select(*keys, "date").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))
    first = dates.withColumn("_k", rank).filter(F.col("_k") <= horizon).groupBy(*keys).agg(F.min("date").alias("_from"))
    return attach(fact, first, keys).filter(F.col("date") >= F.col("_from")).drop("_from")


def holdout_split(fact: DataFrame, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows flagged ``train`` before the last ``days`` calendar days and ``test`` within them."""
    last = fact.groupBy(*keys).agg(F.max("date").alias("_last"))
    cut = F.date_sub("_last", days - 1)
    return attach(fact, last, keys).withColumn("part", F.when(F.col("date") < cut, "train").otherwise("test")).drop("_last")


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keys that occur more than once with the first row of each: aggregated, so a hot key is one row."""
    return (
        rows.groupBy(*keys, *ROW_KEY)
        .agg(F.count("*").alias("_copies"), F.min("row").alias("_first_row"))
        .filter(F.col("_copies") > 1)
    )


def flag_duplicates(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``copies`` of each row's key and whether an earlier row has it."""
    joined = rows.join(duplicate_keys(rows, keys), [*keys, *ROW_KEY], "left")
    return joined.withColumns(
        {
            "copies": F.coalesce(F.col("_copies"), F.lit(1)),
            "seen_before": F.coalesce(F.col("row") > F.col("_first_row"), F.lit(False)),
        }
    ).drop("_copies", "_first_row")


def campaign_inconsistency(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Campaigns that map to several channels or types, one issue each at their first row."""
    spread = rows.groupBy(*keys, "campaign_name").agg(
        (F.min("channel") != F.max("channel")).alias("channels"),
        (F.min("campaign_type") != F.max("campaign_type")).alias("types"),
        F.min("row").alias("row"),
    )
    return spread.filter(F.col("channels") | F.col("types")).select(
        *keys,
        F.lit("campaign_inconsistency").alias("type"),
        "row",
        F.format_string("Campaign '%s' maps to multiple channels or campaign types", "campaign_name").alias("message"),
    )


def flag_rows(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical rows with their issue list. ``row`` identifies a row; ``date`` may be text or a date."""
    raw_date = F.col("date").cast("string")
    dated = rows.withColumn("_raw_date", raw_date).withColumn("date", parse_date(raw_date))
    flagged = flag_duplicates(dated, keys)

    def issue(kind: str, message: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("type"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))

    def bad_number(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    rules = [
        (F.col("date").isNull(), issue("invalid_date", F.concat(F.lit("Invalid date: "), F.coalesce("_raw_date", F.lit(""))))),
        *[(F.col(c).isNull() | (F.trim(c) == ""), issue("missing", f"Missing {c}")) for c in TEXT_DIMS],
        *[(bad_number(c), issue("invalid_number", f"Invalid number for {c}")) for c in [*MEASURES, "roas"]],
        (F.col("spend") < 0, issue("negative_spend", "Negative spend")),
        (F.col("revenue") < 0, issue("invalid_revenue", "Negative revenue")),
        *[
            (F.col(c) < 0, issue("invalid_number", f"Negative {c}"))
            for c in ("clicks", "impressions", "conversions", "roas")
        ],
        (F.col("copies") > 1, issue("duplicate", "Duplicate date/channel/campaign record")),
    ]
    return flagged.withColumn("issues", present(rules)).drop("_raw_date", "copies", "seen_before")


def valid_rows(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    clean = flagged.filter(F.size("issues") == 0)
    roas = F.when(F.col("spend") > 0, safe_ratio("revenue", "spend")).otherwise(F.col("roas"))
    return clean.select(*keys, *[c for c in CANONICAL_COLUMNS if c != "roas"], roas.alias("roas"))


def row_issues(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per issue, with the mapping conflicts of the campaigns."""
    listed = flagged.select(*keys, "row", F.explode("issues").alias("i")).select(*keys, "i.type", "row", "i.message")
    return listed.unionByName(campaign_inconsistency(flagged, keys))


def issue_counts(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    unique = issues.dropDuplicates([*keys, "row", "type", "message"])
    return unique.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def _running_index(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0-based position of each row in ``row`` order, in blocks of at most 65,536 rows per task group."""
    block = F.shiftright("row", 16)
    blocked = rows.withColumn("_block", block)
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("row"))
    placed = blocked.withColumn("_within", within).join(starts, [*keys, "_block"])
    return placed.withColumn("_index", F.col("_start") + F.col("_within") - 1).drop("_block", "_start", "_within")


def repair_dates(rows: DataFrame, as_of: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bad dates take the earliest valid date; dates over a year ahead take the latest credible one.

    A key without any valid date gets consecutive days that end at ``as_of``, in row order.
    """
    today = F.to_date(F.lit(as_of))
    # Years far ahead need no special case: a Spark date holds them, and the clamp below moves them.
    dated = rows.withColumn("_date", parse_date(F.col("date")))
    ahead = F.date_add(today, 366)
    stats = dated.groupBy(*keys).agg(
        F.min("_date").alias("_min"),
        F.max(F.when(F.col("_date") <= ahead, F.col("_date"))).alias("_credible"),
        F.count("*").alias("_rows"),
    )
    joined = attach(dated, stats, keys)
    some = joined.filter(F.col("_min").isNotNull())
    filled = F.coalesce(F.col("_date"), F.col("_min"))
    # The one-element array binds the parsed day once; a conditional would repeat the whole parse.
    kept = F.get(F.filter(F.array(filled), lambda d: d <= ahead), F.lit(0))
    some = some.withColumn("date", F.coalesce(kept, F.col("_credible"), today))
    none = _running_index(joined.filter(F.col("_min").isNull()), keys)
    none = none.withColumn(
        "date", F.date_add(today, (F.col("_index") - F.col("_rows") + 1).cast("int"))
    ).drop("_index")
    return some.unionByName(none).drop("_date", "_min", "_credible", "_rows")


def clean_repair(rows: DataFrame, as_of: str, keys: Sequence[str] = ()) -> DataFrame:
    """Batch policy: repair what can be repaired, drop rows of negative money, sum to the fact grain.

    The rows are written first: the dates are read twice, and the filter on money would parse every amount once more.
    """
    used = rows.select(*keys, *(["row"] if "row" in rows.columns else []), *[c for c in CANONICAL_COLUMNS if c != "roas"])
    dated = repair_dates(checkpoint(used), as_of, keys)
    texts = {c: F.coalesce(unless_blank(F.trim(c)), F.lit(TEXT_DEFAULTS[c])) for c in TEXT_DIMS}

    def number(c: str) -> Column:
        return F.coalesce(finite(F.col(c)), F.lit(0.0))

    fixed = dated.withColumns({**texts, **{m: number(m) for m in MEASURES}})
    kept = fixed.filter((F.col("spend") >= 0) & (F.col("revenue") >= 0))
    clamped = kept.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("clicks", "impressions", "conversions")})
    return fact_rollup(clamped, keys)


def unknown_budget_channels(budgets: DataFrame, fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Budget channels that the data does not have, ignoring case and outer blanks."""
    name = F.lower(F.trim("channel")).alias("_name")
    observed = fact.select(*keys, name).distinct()
    return budgets.withColumn("_name", F.lower(F.trim("channel"))).join(observed, [*keys, "_name"], "left_anti").drop("_name")


def budget_value_rules(budgets: DataFrame, spend: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One verdict per plan: bad amounts, and a target without any spend to plan with.

    ``budgets`` has (keys, scenario, channel, budget, target_revenue); ``spend`` one ``spend`` per key.
    """
    by = [*keys, "scenario"]
    amount = F.col("budget")
    bad = amount.isNull() | F.isnan(amount) | (amount < 0) | (amount == float("inf"))
    plans = budgets.groupBy(*by).agg(
        F.sum(bad.cast("int")).alias("bad_budgets"),
        F.sum(F.when(~bad, amount).otherwise(0.0)).alias("total_budget"),
        F.max("target_revenue").alias("target_revenue"),
        F.max(F.lit(1)).alias("explicit"),
    )
    joined = attach(plans, spend.groupBy(*keys).agg(F.sum("spend").alias("observed_spend")), keys)
    wants = F.coalesce(F.col("target_revenue"), F.lit(0.0)) > 0
    verdict = (
        F.when(F.col("bad_budgets") > 0, "invalid_budget")
        .when(wants & (F.col("total_budget") == 0) & (F.col("observed_spend") == 0), "no_spend_basis")
        .when(wants & (F.col("total_budget") == 0), "zero_budget_target")
        .otherwise("ok")
    )
    return joined.select(*by, "bad_budgets", "total_budget", "observed_spend", verdict.alias("verdict"))
