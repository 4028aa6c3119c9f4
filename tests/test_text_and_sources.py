import re

import pytest
from pyspark.sql import functions as F

from adtide.functions.text import friendly_channel, norm_header, parse_date, read_amount, unless_blank
from adtide.sources import exports, normalize, reconcile


def test_norm_header():
    assert norm_header(" Session source / medium ") == "session_source_medium"


def test_amounts(spark):
    cases = {
        "$1,234.56": 1234.56, "1.234,56": 1234.56, "1,234": 1234.0, "1,23": 1.23, "1,234,567": 1234567.0, "€ 12": 12.0,
        "": None, "nan": None, "n/a": None, "-5": -5.0, "1.234.567,8": 1234567.8, "1,23 USD": 123.0, "1,2,3.4": 123.4,
        "1.2,3,4": None, "9" * 400: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {row.t: row.v for row in df.select("t", read_amount(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_dates(spark):
    cases = {
        "2024-01-05": "2024-01-05", "20240105": "2024-01-05", "01/05/2024": "2024-01-05", "13/01/2024": "2024-01-13",
        "2024-01-05T23:59:00Z": "2024-01-05", "Jan 5, 2024": "2024-01-05", "5 Jan 2024": "2024-01-05", "2024/1/5": "2024-01-05",
        "not a date": None, "12:30": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {row.t: row.v for row in df.select("t", parse_date(F.col("t")).cast("string").alias("v")).collect()}
    assert got == cases


def test_channels(spark):
    cases = {"google / cpc": "Google Ads", "Instagram": "Meta Ads", "bing": "Microsoft Ads", "my shopify": "Shopify", " TV ": "TV"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", friendly_channel(F.col("t")).alias("v")).collect()} == cases


@pytest.mark.parametrize(
    "headers,kind",
    [
        (["date", "platform", "cost", "clicks"], "ads"),
        (["sessionSource", "sessions", "day"], "ga4"),
        (["created_at", "total_price", "orders"], "shopify"),
        (["created_at", "total_price", "cost", "clicks"], "mixed"),
        (["a", "b"], "generic_marketing"),
        ([], "empty"),
    ],
)
def test_detect(headers, kind):
    assert normalize.detect_source_schema(headers) == kind


def test_read_exports_keeps_headers_that_differ_in_case(spark, tmp_path):
    (tmp_path / "google_q1.csv").write_text("Date,spend,Spend,revenue\n2026-01-01,,5,10\n2026-01-02,7,5,20\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("created_at,total_price,orders\n2026-01-01T00:00:00Z,100,2\n")
    rows = exports.read_exports(spark, str(tmp_path)).orderBy("source_file", "date").collect()
    assert [(r.source_file, r.spend, r.revenue, r.channel) for r in rows] == [
        ("google_q1.csv", 5.0, 10.0, "Google Ads"),
        ("google_q1.csv", 7.0, 20.0, "Google Ads"),
        ("other.csv", 0.0, 100.0, "Shopify"),
    ]


def test_reconciled_revenue_equals_the_authority(spark):
    schema = "date string, channel string, campaign_type string, campaign_name string, spend double, clicks double, impressions double, conversions double, revenue double, roas double, source_schema string"
    rows = [
        ("2026-01-01", "Shopify", "t", "n", 0.0, 0.0, 0.0, 1.0, 100.0, 0.0, "shopify"),
        ("2026-01-02", "Shopify", "t", "n", 0.0, 0.0, 0.0, 1.0, 40.0, 0.0, "shopify"),
        ("2026-01-01", "Google", "t", "a", 5.0, 1.0, 1.0, 1.0, 30.0, 6.0, "ads"),
        ("2026-01-01", "Meta", "t", "b", 5.0, 1.0, 1.0, 1.0, 10.0, 2.0, "ads"),
        ("2026-01-03", "Meta", "t", "b", 5.0, 1.0, 1.0, 1.0, 10.0, 2.0, "ads"),
    ]
    out = reconcile.reconcile(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r.date, r.channel, r.revenue, r.source_schema) for r in out)
    assert got == [
        ("2026-01-01", "Google", 75.0, "reconciled_shopify_with_media"),
        ("2026-01-01", "Meta", 25.0, "reconciled_shopify_with_media"),
        ("2026-01-02", "Shopify", 40.0, "reconciled_shopify"),
        ("2026-01-03", "Meta", 10.0, "ads"),
    ]


def test_budgets_from_json(spark):
    df = spark.createDataFrame([('{"A": 5, "B": -3, "C": "x"}',), ("broken",)], "doc string")
    assert sorted((r.channel, r.budget) for r in exports.budgets_from_json(df, "doc").collect()) == [("A", 5.0), ("B", 0.0)]


def test_blank_first_line_split_record_and_corrupt_row(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("\n  \ndate,channel,campaign_name,spend,revenue\n2026-01-01,Search,a,5,10\n")
    (tmp_path / "split.csv").write_text('date,channel,campaign_name,spend,revenue\n2026-01-01,Search,"two\nlines",6,20\n2026-01-02,Search,b,7,30\n')
    (tmp_path / "broken.csv").write_text("date,channel,campaign_name,spend,revenue\n2026-01-03,Search,c,8,40\n2026-01-03,Search,short\n")
    (tmp_path / "none.csv").write_text("\n \n")
    (tmp_path / "google ads é.csv").write_text("\ufeffdate,campaign_name,spend,revenue\n2026-01-04,d,9,50\n")
    rows = exports.read_exports(spark, str(tmp_path)).collect()
    got = {(r.source_file, r.campaign_name, r.spend, r.revenue, r.corrupt_record) for r in rows}
    assert got == {
        ("blank.csv", "a", 5.0, 10.0, None), ("split.csv", "two\nlines", 6.0, 20.0, None), ("split.csv", "b", 7.0, 30.0, None),
        ("broken.csv", "c", 8.0, 40.0, None), ("broken.csv", "short", 0.0, 0.0, "2026-01-03,Search,short"), ("google ads é.csv", "d", 9.0, 50.0, None)}
    assert {r.channel for r in rows if r.source_file.startswith("google")} == {"Google Ads"}


def test_folder_counts_sales_once(spark, tmp_path):
    (tmp_path / "store.csv").write_text("created_at,total_price,orders\n2026-01-01T00:00:00Z,100,2\n2026-01-05T00:00:00Z,40,1\n")
    (tmp_path / "ads.csv").write_text("date,channel,campaign_type,campaign_name,spend,revenue\n2026-01-01,Search,s,a,5,30\n2026-01-01,Search,s,b,5,10\n2026-01-03,Search,s,b,5,8\n")
    rows = sorted((r.date, r.campaign_name, r.revenue, r.source_schema) for r in exports.read_folder(spark, str(tmp_path)).collect())
    assert [(d, v) for d, _, v, _ in rows] == [("2026-01-01", 75.0), ("2026-01-01", 25.0), ("2026-01-03", 8.0), ("2026-01-05", 40.0)]
    assert rows[0][3] == "reconciled_shopify_with_media" and rows[3][3] == "reconciled_shopify"


def test_issue_lines_name_unreadable_numbers_and_missing_fields(spark):
    """A source without a date, one without spend and with a bad number, and one that is complete."""
    rows = [("a", None, "x", "5", "n/a"), ("a", None, "y", "6", "7"), ("b", "2026-01-01", "z", None, "bad"), ("b", "2026-01-02", "z", None, "4"), ("c", "2026-01-01", "z", "1", "2")]
    df = spark.createDataFrame(rows, "source_file string, date string, channel string, spend string, revenue string")
    profile = normalize.source_profile(df, "source_file")
    lines = normalize.adapter_issues(normalize.normalize_tagged(df), ["source_file"], profile).collect()
    assert {(r.source_file, r.field, r.issue, r.n, r.replaced_by) for r in lines} == {
        ("a", "date", "missing_field", 2, "synthetic date"), ("a", "revenue", "invalid_values", 1, "0"),
        ("b", "spend", "missing_field", 2, "0"), ("b", "revenue", "invalid_values", 1, "0"),
    }


def test_tagged_rows_meet_the_profile_without_a_shuffle(spark):
    """Two sources are two join keys: shuffled by source, half of all rows would be one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = spark.range(100_000).select(
            F.when(F.col("id") % 2 == 0, "a.csv").otherwise("b.csv").alias("source_file"), F.lit("2024-01-05").alias("Day"),
            F.when(F.col("id") % 2 == 0, "12").alias("metrics_cost_micros"), F.lit("7").alias("Clicks"))
        out = normalize.normalize_tagged(rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(source_file" not in plan
        got = {(r.source_file, r.spend, r.n) for r in out.groupBy("source_file", "spend").agg(F.count("*").alias("n")).collect()}
        assert got == {("a.csv", 12e-6, 50_000), ("b.csv", 0.0, 50_000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_text_rules_stay_out_of_fused_stages(spark):
    """Fused with the joins below, the rules of a normalisation are one method that the JVM never compiles."""
    rows = spark.range(3).select(F.col("id").cast("string").alias("t"))
    for rule in (unless_blank, friendly_channel, parse_date):
        plan = rows.select(rule(F.col("t")).alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if re.match(r"\W*\*\(\d+\) Project", line)], plan
