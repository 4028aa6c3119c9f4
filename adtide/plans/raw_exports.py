"""Untidy text exports derived from the order tables, in the layouts of three source systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.plans.facts import campaign_lines, table


def _text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").cast("string")


def ads_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad platform rows: four date layouts, five amount layouts, blank channels, bad and negative values."""
    lines = campaign_lines(spark, sf_dir)
    n, k = F.col("clicks").cast("bigint"), F.col("revenue").cast("bigint")
    day = (
        F.when(k % 97 == 0, "not a date")
        .when(n % 4 == 0, F.date_format("date", "yyyy-MM-dd"))
        .when(n % 4 == 1, F.date_format("date", "MM/dd/yyyy"))
        .when(n % 4 == 2, F.date_format("date", "yyyyMMdd"))
        .otherwise(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    )
    platform = (
        F.when(F.col("channel") == "AUTOMOBILE", "google / cpc")
        .when(F.col("channel") == "BUILDING", "Facebook ads")
        .when(F.col("channel") == "FURNITURE", "Bing")
        .when(F.col("channel") == "HOUSEHOLD", "  ")
        .otherwise(F.concat(F.lit(" "), "channel", F.lit(" ")))
    )
    marked = F.format_number("spend", 2)
    cost = (
        F.when(k % 5 == 0, F.concat(F.lit("$"), marked))
        .when(k % 5 == 1, F.translate(marked, ",.", ".,"))
        .when(k % 5 == 2, _text("spend"))
        .when(k % 5 == 3, F.format_number("spend", 0))
        .when(k % 35 == 4, "n/a")
        .otherwise(F.concat(_text("spend"), F.lit(" €")))
    )
    return lines.select(
        (F.col("order_id") * 10 + F.col("line_no")).alias("row"),
        day.alias("Day"),
        platform.alias("Platform"),
        F.when(k % 89 == 0, "null").otherwise(F.col("campaign_name")).alias("Campaign"),
        F.col("campaign_type").alias("Campaign type"),
        cost.alias("Cost"),
        _text("clicks").alias("Clicks"),
        _text("impressions").alias("Impressions"),
        F.lit("1").alias("Conversions"),
        F.when(k % 101 == 0, F.concat(F.lit("-"), _text("revenue"))).otherwise(_text("revenue")).alias("Conversion value"),
    )


def web_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web analytics rows: source and medium instead of a channel, revenue only."""
    lines = campaign_lines(spark, sf_dir)
    k = F.col("revenue").cast("bigint")
    return lines.select(
        (F.col("order_id") * 10 + F.col("line_no")).alias("row"),
        F.date_format("date", "yyyyMMdd").alias("Event date"),
        F.when(k % 3 == 0, "").otherwise(F.lower("channel")).alias("Session source"),
        F.when(k % 2 == 0, "organic").otherwise("").alias("Session medium"),
        F.when(k % 7 == 0, "").otherwise(F.col("campaign_name")).alias("Session campaign name"),
        _text("revenue").alias("Purchase revenue"),
        _text("clicks").alias("Sessions"),
        F.lit("1").alias("Transactions"),
    )


def store_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store orders: the revenue of record."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_orderkey") * 10).alias("row"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        _text(F.floor(F.col("o_totalprice") + 0.5)).alias("total_price"),
        F.lit("1").alias("orders"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("product_type"),
    )
