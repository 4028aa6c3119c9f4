"""Campaign facts derived from the order tables: the input of every registered query.

Amounts are whole currency units per order line, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.functions.exprs import safe_ratio

TASK_LINES = 250_000  # order lines that one task joins, about, where the cores would get more at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_campaign() -> Column:
    """Every part as its own campaign: many campaigns with few rows each."""
    return F.concat(F.lit("item "), F.col("p_partkey").cast("string"))


def line_parts(spark: SparkSession, lines: DataFrame, task_lines: int) -> int | None:
    """Partitions that keep a task's lines, and so its sorts and distinct counts, at one size however many lines there are.

    The lines are counted from the file footers. None: each core gets few enough by itself.
    """
    parts = -(-lines.count() // task_lines)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def campaign_lines(spark: SparkSession, sf_dir: str, campaign: Column | None = None) -> DataFrame:
    """One row per order line with its campaign dimensions; the two dimension joins stay on their own side.

    ``campaign`` names the campaign of a part, its brand if not given.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date")
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("account")
    )
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("campaign_type"),
        (F.col("p_brand") if campaign is None else campaign).alias("campaign_name"),
        "p_size",
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    bought = lines.join(part, lines.l_partkey == part.p_partkey)
    parts = line_parts(spark, lines, TASK_LINES)
    if parts:
        bought, placed = bought.repartition(parts, "l_orderkey"), placed.repartition(parts, "o_orderkey")
    joined = bought.join(placed, bought.l_orderkey == placed.o_orderkey)
    return joined.select(
        "account",
        "date",
        "channel",
        "campaign_type",
        "campaign_name",
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount") * 4.0 + 0.5).cast("double").alias("spend"),
        F.col("l_quantity").alias("clicks"),
        (F.col("l_quantity") * (F.col("p_size") + 20)).alias("impressions"),
        F.floor(F.col("l_extendedprice") * (1.0 - F.col("l_discount")) + 0.5).cast("double").alias("revenue"),
    )


def campaign_fact(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = (), campaign: Column | None = None) -> DataFrame:
    """date x channel x campaign type x campaign facts, optionally per account."""
    grain = [*keys, "date", "channel", "campaign_type", "campaign_name"]
    return (
        campaign_lines(spark, sf_dir, campaign)
        .groupBy(*grain)
        .agg(
            F.sum("spend").alias("spend"),
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.countDistinct("order_id").cast("double").alias("conversions"),
            F.sum("revenue").alias("revenue"),
        )
        .withColumn("roas", safe_ratio("revenue", "spend"))
    )
