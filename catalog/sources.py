"""Sources, normalisation, reconciliation, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from adtide.functions import text as TX
from adtide.functions.exprs import round_to
from adtide.operators import forecast as FC
from adtide.operators import quality as Q
from adtide.operators import rollup as R
from adtide.plans.facts import campaign_fact, campaign_lines, table
from adtide.plans.raw_exports import ads_export, store_export, web_export
from adtide.schema import SOURCE_SIGNATURES
from adtide.session import checkpoint
from adtide.sources import exports as EX
from adtide.sources import normalize as N
from adtide.sources import reconcile as RC
from catalog.base import big, cte, div, query, r, sql
from catalog.forecasts import demo_budgets
from catalog.rollups import rounded

MEAS = ["spend", "clicks", "impressions", "conversions", "revenue"]


def txt(c: str) -> str:
    return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


K, NN = "CAST(revenue AS BIGINT)", "CAST(clicks AS BIGINT)"
EURO = "replace(replace(replace(format('{:,.2f}', spend), ',', '#'), '.', ','), '#', '.')"
cte(
    "ads_raw",
    f"""
SELECT order_id * 10 + line_no AS row, CASE WHEN {K} % 97 = 0 THEN 'not a date' WHEN {NN} % 4 = 0 THEN strftime(date, '%Y-%m-%d') WHEN {NN} % 4 = 1 THEN strftime(date, '%m/%d/%Y')
 WHEN {NN} % 4 = 2 THEN strftime(date, '%Y%m%d') ELSE strftime(date, '%Y-%m-%d') || 'T00:00:00Z' END AS day,
 CASE channel WHEN 'AUTOMOBILE' THEN 'google / cpc' WHEN 'BUILDING' THEN 'Facebook ads' WHEN 'FURNITURE' THEN 'Bing' WHEN 'HOUSEHOLD' THEN '  ' ELSE ' ' || channel || ' ' END AS platform,
 CASE WHEN {K} % 89 = 0 THEN 'null' ELSE campaign_name END AS campaign, campaign_type,
 CASE WHEN {K} % 5 = 0 THEN '$' || format('{{:,.2f}}', spend) WHEN {K} % 5 = 1 THEN {EURO}
  WHEN {K} % 5 = 2 THEN {txt('spend')} WHEN {K} % 5 = 3 THEN format('{{:,.0f}}', spend) WHEN {K} % 35 = 4 THEN 'n/a' ELSE {txt('spend')} || ' €' END AS cost,
 {txt('clicks')} AS clicks, {txt('impressions')} AS impressions, '1' AS conversions, CASE WHEN {K} % 101 = 0 THEN '-' ELSE '' END || {txt('revenue')} AS conversion_value
FROM lines""",
    "lines",
)
cte(
    "web_raw",
    f"""
SELECT order_id * 10 + line_no AS row, strftime(date, '%Y%m%d') AS event_date, CASE WHEN {K} % 3 = 0 THEN '' ELSE lower(channel) END AS source,
 CASE WHEN {K} % 2 = 0 THEN 'organic' ELSE '' END AS medium, CASE WHEN {K} % 7 = 0 THEN '' ELSE campaign_name END AS campaign,
 {txt('revenue')} AS revenue, {txt('clicks')} AS sessions, '1' AS transactions FROM lines""",
    "lines",
)
cte(
    "store_raw",
    f"""SELECT o_orderkey * 10 AS row, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, {txt('floor(o_totalprice + 0.5)')} AS total_price, '1' AS orders,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS product_type FROM orders""",
)


def num(c: str) -> str:
    s = f"regexp_replace({c}, '[\\s$€£₹]', '', 'g')"
    last_comma, last_dot = f"instr(reverse({s}), ',')", f"instr(reverse({s}), '.')"
    marked = (
        f"CASE WHEN {last_comma} > 0 AND {last_dot} > 0 THEN CASE WHEN {last_comma} < {last_dot} THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END "
        f"WHEN {last_comma} > 0 THEN CASE WHEN len({s}) - len(replace({s}, ',', '')) = 1 AND {last_comma} - 1 BETWEEN 1 AND 2 THEN replace({s}, ',', '.') ELSE replace({s}, ',', '') END ELSE {s} END"
    )
    return f"TRY_CAST(regexp_replace({marked}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def day(c: str) -> str:
    return f"CAST(try_strptime({c}, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d', '%Y%m%d', '%m/%d/%Y', '%d/%m/%Y']) AS DATE)"


cte(
    "ads_norm",
    f"""
SELECT row, date, channel, campaign_type, campaign_name, coalesce(spend, 0) AS spend, clicks, impressions, conversions, revenue,
 {div('revenue', 'coalesce(spend, 0)')} AS roas, 'ads' AS source_schema, CASE WHEN spend IS NULL THEN 1 ELSE 0 END AS bad_spend FROM (
SELECT row, day AS date, CASE platform WHEN 'google / cpc' THEN 'Google Ads' WHEN 'Facebook ads' THEN 'Meta Ads' WHEN 'Bing' THEN 'Microsoft Ads' WHEN '  ' THEN 'Unknown Channel' ELSE trim(platform) END AS channel,
 campaign_type, CASE WHEN campaign = 'null' THEN 'Unknown Campaign' ELSE campaign END AS campaign_name, {num('cost')} AS spend,
 CAST(clicks AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions, 1.0::DOUBLE AS conversions, {num('conversion_value')} AS revenue FROM ads_raw)""",
    "ads_raw",
)
cte(
    "web_norm",
    """
SELECT row, event_date AS date, CASE WHEN source <> '' THEN source WHEN medium <> '' THEN medium ELSE 'Unknown Channel' END AS channel,
 CASE WHEN medium <> '' THEN medium ELSE 'GA4 Traffic' END AS campaign_type,
 CASE WHEN campaign <> '' THEN campaign WHEN source <> '' AND medium <> '' THEN source || ' / ' || medium WHEN source || medium <> '' THEN source || medium ELSE 'Unknown Campaign' END AS campaign_name,
 0.0::DOUBLE AS spend, CAST(sessions AS DOUBLE) AS clicks, 0.0::DOUBLE AS impressions, 1.0::DOUBLE AS conversions, CAST(revenue AS DOUBLE) AS revenue, 0.0::DOUBLE AS roas, 'ga4' AS source_schema, 0 AS bad_spend FROM web_raw""",
    "web_raw",
)
cte(
    "store_norm",
    """
SELECT row, created_at AS date, 'Shopify' AS channel, coalesce(product_type, 'Shopify Sales') AS campaign_type, coalesce(product_type, 'Unknown Campaign') AS campaign_name,
 0.0::DOUBLE AS spend, 0.0::DOUBLE AS clicks, 0.0::DOUBLE AS impressions, 1.0::DOUBLE AS conversions, CAST(total_price AS DOUBLE) AS revenue, 0.0::DOUBLE AS roas, 'shopify' AS source_schema, 0 AS bad_spend FROM store_raw""",
    "store_raw",
)
NORM_COLS = "row, date, channel, campaign_type, campaign_name, spend, clicks, impressions, conversions, revenue, source_schema"


def norm_select(name: str) -> str:
    return f"SELECT {NORM_COLS}, {r('roas')} AS roas, CAST(bad_spend AS BIGINT) AS invalid FROM {name}"


def normalized(df):
    out = N.normalize_facts(df, {c: c for c in df.columns if c != "row"}, carry=["row"])
    return out


def shown(df):
    return rounded(df.withColumn("invalid", F.size("invalid_fields").cast("bigint")).drop("invalid_fields"), "roas")


@query("prj3_normalize_ads", sql(norm_select("ads_norm"), "ads_norm"))
def normalize_ads(spark, sf):
    return shown(normalized(ads_export(spark, sf)))


@query("prj3_normalize_web", sql(norm_select("web_norm"), "web_norm"))
def normalize_web(spark, sf):
    return shown(normalized(web_export(spark, sf)))


@query("prj3_normalize_store", sql(norm_select("store_norm"), "store_norm"))
def normalize_store(spark, sf):
    return shown(normalized(store_export(spark, sf)))


@query("prj6_parse_numeric", sql(f"SELECT row, cost, {num('cost')} AS value FROM ads_raw", "ads_raw"))
def parse_numeric(spark, sf):
    return ads_export(spark, sf).select("row", F.col("Cost").alias("cost"), TX.read_amount(F.col("Cost")).alias("value"))


@query("prj8_parse_dates", sql(f"SELECT row, day AS text, {day('day')} AS date FROM ads_raw", "ads_raw"))
def parse_dates(spark, sf):
    return ads_export(spark, sf).select("row", F.col("Day").alias("text"), TX.parse_date(F.col("Day")).alias("date"))


@query(
    "prj4_source_medium",
    sql(
        "SELECT row, CASE WHEN source <> '' AND medium <> '' THEN source || ' / ' || medium ELSE source || medium END AS source_medium FROM web_raw",
        "web_raw",
    ),
)
def source_medium(spark, sf):
    return web_export(spark, sf).select(
        "row", TX.source_medium(F.col("Session source"), F.col("Session medium")).alias("source_medium")
    )


@query(
    "prj5_friendly_channel",
    sql(
        "SELECT platform, CASE platform WHEN 'google / cpc' THEN 'Google Ads' WHEN 'Facebook ads' THEN 'Meta Ads' WHEN 'Bing' THEN 'Microsoft Ads' ELSE trim(platform) END AS channel, count(*) AS n FROM ads_raw GROUP BY 1, 2",
        "ads_raw",
    ),
)
def friendly_channel(spark, sf):
    platform = F.col("Platform")
    return ads_export(spark, sf).groupBy(platform.alias("platform"), TX.friendly_channel(platform).alias("channel")).agg(F.count("*").alias("n"))


@query(
    "prj2_coalesce_aliases",
    sql(
        f"SELECT row, CASE WHEN {K} % 3 = 0 THEN {txt('spend')} WHEN {K} % 3 = 1 THEN {txt('clicks')} ELSE {txt('impressions')} END AS value FROM (SELECT order_id * 10 + line_no AS row, * FROM lines)",
        "lines",
    ),
)
def coalesce_aliases(spark, sf):
    """Three spend columns whose headers differ in case and wording; the first filled one wins."""
    k = F.col("revenue").cast("bigint")
    raw = campaign_lines(spark, sf).select(
        (F.col("order_id") * 10 + F.col("line_no")).alias("row"),
        F.when(k % 3 == 0, F.col("spend").cast("bigint").cast("string")).otherwise(" nan ").alias("a"),
        F.when(k % 3 != 2, F.col("clicks").cast("bigint").cast("string")).alias("b"),
        F.col("impressions").cast("bigint").cast("string").alias("c"),
    )
    headers = {"a": "Spend", "b": "spend", "c": "Amount Spent"}
    return raw.select("row", N.coalesce_aliases(raw, "spend", headers).alias("value"))


@query(
    "prj7_scale_micros",
    sql("SELECT order_id * 10 + line_no AS row, spend, clicks FROM lines", "lines"),
)
def scale_micros(spark, sf):
    raw = campaign_lines(spark, sf).select(
        (F.col("order_id") * 10 + F.col("line_no")).alias("row"),
        (F.col("spend") * 1e6).cast("bigint").cast("string").alias("metrics_cost_micros"),
        F.col("clicks").cast("bigint").cast("string").alias("metrics_clicks"),
    )
    return N.normalize_facts(raw, {c: c for c in raw.columns[1:]}, carry=["row"]).select("row", "spend", "clicks")


@query(
    "prj9_fill_text_defaults",
    sql(
        "SELECT channel, campaign_name, count(*) AS n FROM ads_norm WHERE channel = 'Unknown Channel' OR campaign_name = 'Unknown Campaign' GROUP BY 1, 2",
        "ads_norm",
    ),
)
def fill_text_defaults(spark, sf):
    rows = normalized(ads_export(spark, sf))
    filled = rows.filter((F.col("channel") == "Unknown Channel") | (F.col("campaign_name") == "Unknown Campaign"))
    return filled.groupBy("channel", "campaign_name").agg(F.count("*").alias("n"))


cte("three", "SELECT * FROM ads_norm UNION ALL SELECT * FROM web_norm UNION ALL SELECT * FROM store_norm", "ads_norm", "web_norm", "store_norm")


def three_sources(spark, sf):
    return RC.union_sources([normalized(f(spark, sf)) for f in (ads_export, web_export, store_export)])


@query("set1_union_sources", sql("SELECT source_schema, count(*) AS n, sum(revenue) AS revenue, sum(spend) AS spend FROM three GROUP BY 1", "three"))
def union_sources(spark, sf):
    return three_sources(spark, sf).groupBy("source_schema").agg(
        F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend")
    )


def tagged_upload(spark, sf):
    """One upload with all three sources' columns side by side and a file tag."""
    frames = [
        f(spark, sf).drop("row").withColumn("source_file", F.lit(n))
        for f, n in ((ads_export, "google_ads.csv"), (web_export, "web.csv"), (store_export, "store.csv"))
    ]
    return RC.union_sources(frames)


@query(
    "src3_tag_sources",
    sql(
        "SELECT 'google_ads.csv' AS source_file, count(*) AS source_rows, 'ads' AS source_kind, false AS has_micros, false AS is_microsoft, 'campaign_name,campaign_type,channel,clicks,conversions,date,impressions,revenue,spend' AS mapped FROM lines "
        "UNION ALL SELECT 'web.csv', count(*), 'ga4', false, false, 'campaign_name,campaign_type,channel,clicks,conversions,date,revenue' FROM lines "
        "UNION ALL SELECT 'store.csv', count(*), 'shopify', false, false, 'campaign_name,campaign_type,conversions,date,revenue' FROM orders",
        "lines",
    ),
)
def tag_sources(spark, sf):
    """Source kinds and mapped fields from the cells each tagged source fills (also prj1)."""
    profile = N.source_profile(tagged_upload(spark, sf), "source_file")
    return profile.withColumn("mapped", F.array_join(F.array_sort("mapped"), ","))


@query(
    "src3_normalize_tagged",
    sql(
        "SELECT CASE source_schema WHEN 'ads' THEN 'google_ads.csv' WHEN 'ga4' THEN 'web.csv' ELSE 'store.csv' END AS source_file, source_schema, channel, count(*) AS n, sum(revenue) AS revenue, sum(spend) AS spend, sum(clicks) AS clicks "
        "FROM three GROUP BY 1, 2, 3",
        "three",
    ),
)
def normalize_tagged(spark, sf):
    rows = N.normalize_tagged(tagged_upload(spark, sf))
    return rows.groupBy("source_file", "source_schema", "channel").agg(
        F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks")
    )


HEADERS = {
    "ads": ["Day", "Platform", "Campaign", "Campaign type", "Cost", "Clicks", "Impressions", "Conversions", "Conversion value"],
    "web": ["Event date", "Session source", "Session medium", "Session campaign name", "Purchase revenue", "Sessions", "Transactions"],
    "store": ["created_at", "total_price", "orders", "product_type"],
    "fact": ["date", "channel", "campaign_type", "campaign_name", "spend", "clicks", "impressions", "conversions", "revenue", "roas"],
    "totals": ["date", "total"],
}
HEADERS["upload"] = [*HEADERS["ads"], *HEADERS["web"], *HEADERS["store"]]
ROWS = {"ads": "lines", "web": "lines", "store": "orders", "fact": "fact", "totals": "lines", "upload": "three"}


def signature_hits(names: list[str]) -> str:
    return f"CAST(len(list_filter(names, lambda x: list_contains({names!r}, x))) >= 2 AS INTEGER)"


@query(
    "prj1_detect_source_schema",
    sql(
        f"""SELECT layout, CASE kinds WHEN 0 THEN 'generic_marketing' WHEN 1 THEN CASE WHEN ads = 1 THEN 'ads' WHEN ga4 = 1 THEN 'ga4' ELSE 'shopify' END ELSE 'mixed' END AS source_schema, n
FROM (SELECT *, {' + '.join(SOURCE_SIGNATURES)} AS kinds FROM (SELECT layout, n, {', '.join(f'{signature_hits(v)} AS {k}' for k, v in SOURCE_SIGNATURES.items())}
FROM (SELECT layout, n, list_distinct(list_transform(headers, lambda h: trim(regexp_replace(lower(h), '[^a-z0-9]+', '_', 'g'), '_'))) AS names FROM (
"""
        + " UNION ALL ".join(f"SELECT '{k}' AS layout, {v!r} AS headers, (SELECT count(*) FROM {ROWS[k]}) AS n" for k, v in HEADERS.items())
        + "))))",
        "three",
        "fact",
    ),
)
def detect_source_schema(spark, sf):
    """The class of six header sets, with the rows each covers. The fact's headers carry ad signatures, which decide first."""
    frames = {
        "ads": ads_export(spark, sf).drop("row"), "web": web_export(spark, sf).drop("row"), "store": store_export(spark, sf).drop("row"),
        "fact": campaign_fact(spark, sf), "totals": campaign_lines(spark, sf).select("date", F.col("revenue").alias("total")),
        "upload": tagged_upload(spark, sf).drop("source_file"),
    }
    kinds = [df.select(F.lit(k).alias("layout"), F.lit(N.detect_source_schema(df.columns)).alias("source_schema")) for k, df in frames.items()]
    return RC.union_sources(kinds).groupBy("layout", "source_schema").agg(F.count("*").alias("n"))


def upload_issues(spark, sf):
    """Source profile and issue lines of two uploads: all three sources, and the store export alone."""
    shop = F.when(F.col("source_file") == "store.csv", "store")
    rows = tagged_upload(spark, sf).withColumn("upload", F.explode(F.array_compact(F.array(F.lit("all"), shop))))
    by = ["upload", "source_file"]
    kinds = checkpoint(N.source_profile(rows, "source_file", ["upload"]))
    return kinds, N.adapter_issues(N.normalize_tagged(rows, "source_file", ["upload"]), by, kinds)


cte(
    "issue_lines",
    """
SELECT 'all' AS upload, 'google_ads.csv' AS source_file, 'spend' AS field, 'invalid_values' AS issue, CAST(sum(bad_spend) AS BIGINT) AS n, '0' AS replaced_by FROM ads_norm HAVING sum(bad_spend) > 0
UNION ALL SELECT 'all', 'web.csv', 'spend', 'missing_field', count(*), '0' FROM web_raw
UNION ALL SELECT u, 'store.csv', 'spend', 'missing_field', count(*), '0' FROM store_raw, (SELECT unnest(['all', 'store']) AS u) GROUP BY u""",
    "ads_norm",
    "web_raw",
    "store_raw",
)


@query("prj3_issue_lines", sql("SELECT * FROM issue_lines", "issue_lines"))
def issue_lines(spark, sf):
    return upload_issues(spark, sf)[1]


@query(
    "src2_channel_from_filename",
    sql(
        "SELECT CASE WHEN channel = 'Unknown Channel' THEN 'Google Ads' ELSE channel END AS channel, count(*) AS n, sum(revenue) AS revenue FROM ads_norm GROUP BY 1",
        "ads_norm",
    ),
)
def channel_from_filename(spark, sf):
    rows = normalized(ads_export(spark, sf)).withColumn("source_file", F.lit("google_export_2024.csv"))
    return EX.channel_from_source(rows).groupBy("channel").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))


@query(
    "src1_read_exports",
    sql(
        "SELECT source_schema, CASE WHEN source_schema = 'ads' AND channel = 'Unknown Channel' THEN 'Google Ads' ELSE channel END AS channel, campaign_type, count(*) AS n, sum(revenue) AS revenue, sum(spend) AS spend, CAST(sum(bad_spend) AS BIGINT) AS invalid "
        "FROM three GROUP BY 1, 2, 3",
        "three",
    ),
)
def read_exports(spark, sf):
    """Writes the three exports as CSV, then reads the folder back through the export reader."""
    folder = EX.scratch_dir(spark, "exports")
    for f, n in ((ads_export, "google_ads"), (web_export, "web"), (store_export, "store")):
        f(spark, sf).drop("row").write.option("header", True).csv(f"{folder}/{n}")
    rows = RC.union_sources([EX.read_exports(spark, f"{folder}/{n}") for n in ("google_ads", "web", "store")])
    # Part files carry no platform name, so the folder name stands in for the file name.
    return (
        EX.channel_from_source(rows.withColumn("source_file", F.when(F.col("source_schema") == "ads", "google_ads.csv").otherwise(F.col("source_file"))))
        .groupBy("source_schema", "channel", "campaign_type")
        .agg(
            F.count("*").alias("n"),
            F.sum("revenue").alias("revenue"),
            F.sum("spend").alias("spend"),
            F.sum(F.size("invalid_fields")).alias("invalid"),
        )
    )


@query(
    "src4_read_budgets",
    sql("SELECT channel, CASE WHEN channel = 'BUILDING' THEN 0 ELSE recent_spend END AS budget FROM summary WHERE channel <> 'FURNITURE'", "summary"),
)
def read_budgets(spark, sf):
    """One JSON object per channel, one of them negative and one unreadable (also fn14)."""
    summary = R.channel_summary(campaign_fact(spark, sf))
    amount = F.when(F.col("channel") == "BUILDING", -F.col("recent_spend")).otherwise(F.col("recent_spend"))
    body = F.to_json(F.map_from_arrays(F.array("channel"), F.array(amount)))
    docs = summary.select(F.when(F.col("channel") == "FURNITURE", "{broken").otherwise(body).alias("doc"))
    return EX.budgets_from_json(docs, "doc")


# --- validation -----------------------------------------------------------------------------------
cte("parsed", f"SELECT * REPLACE ({day('date')} AS date), date AS raw_date FROM ads_norm", "ads_norm")
cte(
    "flagged",
    """
SELECT *, date IS NULL AS f_date, revenue < 0 AS f_rev, roas < 0 AS f_roas, count(*) OVER (PARTITION BY date, channel, campaign_name) > 1 AND date IS NOT NULL AS f_dup,
 min(row) OVER (PARTITION BY date, channel, campaign_name) AS first_row FROM parsed""",
    "parsed",
)
cte(
    "issues",
    """
SELECT 'invalid_date' AS type, row, 'Invalid date: ' || raw_date AS message FROM flagged WHERE f_date
UNION ALL SELECT 'invalid_revenue', row, 'Negative revenue' FROM flagged WHERE f_rev
UNION ALL SELECT 'invalid_number', row, 'Negative roas' FROM flagged WHERE f_roas
UNION ALL SELECT 'duplicate', row, 'Duplicate date/channel/campaign record' FROM flagged WHERE f_dup
UNION ALL SELECT 'campaign_inconsistency', min(row), 'Campaign ''' || campaign_name || ''' maps to multiple channels or campaign types' FROM flagged
 GROUP BY campaign_name HAVING count(DISTINCT channel) > 1 OR count(DISTINCT campaign_type) > 1""",
    "flagged",
)


def flagged(spark, sf):
    """Parsed once: the duplicate check joins the rows with their own counts."""
    return Q.flag_rows(checkpoint(normalized(ads_export(spark, sf))))


def dated_keys(spark, sf):
    """Rows and their duplicate keys, parsed once: the duplicate check reads them twice."""
    rows = normalized(ads_export(spark, sf)).withColumn("date", TX.parse_date(F.col("date")))
    return checkpoint(rows.select("row", *Q.ROW_KEY))


@query("val1_validate_strict", sql(f"SELECT date, channel, campaign_type, campaign_name, spend, clicks, impressions, conversions, revenue, {r('roas')} AS roas FROM flagged WHERE NOT (f_date OR f_rev OR f_roas OR f_dup)", "flagged"))
def validate_strict(spark, sf):
    return rounded(Q.valid_rows(flagged(spark, sf)), "roas")


@query("val1_row_issues", sql("SELECT * FROM issues", "issues"))
def row_issues(spark, sf):
    return Q.row_issues(flagged(spark, sf))


@query("val2_duplicate_rows", sql("SELECT row FROM flagged WHERE f_dup", "flagged"))
def duplicate_rows(spark, sf):
    return Q.flag_duplicates(dated_keys(spark, sf)).filter(F.col("copies") > 1).select("row")


@query("val3_campaign_inconsistency", sql("SELECT row, message FROM issues WHERE type = 'campaign_inconsistency'", "issues"))
def campaign_inconsistency(spark, sf):
    return Q.campaign_inconsistency(normalized(ads_export(spark, sf))).select("row", "message")


cte(
    "repaired",
    """
SELECT date, channel, campaign_type, campaign_name, sum(spend) AS spend, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(conversions) AS conversions, sum(revenue) AS revenue FROM (
SELECT CASE WHEN d > DATE '1999-06-01' + 366 THEN (SELECT max(date) FROM parsed WHERE date <= DATE '1999-06-01' + 366) ELSE d END AS date, channel, campaign_type, campaign_name, spend, clicks, impressions, conversions, revenue
FROM (SELECT *, coalesce(date, (SELECT min(date) FROM parsed)) AS d FROM parsed) WHERE spend >= 0 AND revenue >= 0) GROUP BY 1, 2, 3, 4""",
    "parsed",
)


@query("val4_clean_repair", sql(f"SELECT *, {r(div('revenue', 'spend'))} AS roas FROM repaired", "repaired"))
def clean_repair(spark, sf):
    """Bad dates to the first valid day, dates beyond the as-of year to the last credible one."""
    return rounded(Q.clean_repair(normalized(ads_export(spark, sf)), "1999-06-01"), "roas")


@query(
    "val4_sequential_dates",
    sql(
        "SELECT row, DATE '2024-06-30' - CAST((SELECT count(*) FROM lines) - 1 - (row_number() OVER (ORDER BY row) - 1) AS INTEGER) AS date FROM (SELECT order_id * 10 + line_no AS row FROM lines)",
        "lines",
    ),
)
def sequential_dates(spark, sf):
    """No readable date at all: consecutive days in row order up to the as-of day."""
    rows = ads_export(spark, sf).select("row", F.lit("n/a").alias("date"))
    return Q.repair_dates(rows, "2024-06-30").select("row", "date")


@query("val6_issue_counts", sql("SELECT type, count(*) AS n FROM (SELECT DISTINCT * FROM issues) GROUP BY 1", "issues"))
def issue_counts(spark, sf):
    return Q.issue_counts(Q.row_issues(flagged(spark, sf)))


@query("val7_duplicate_first_seen", sql("SELECT row FROM flagged WHERE f_dup AND row > first_row", "flagged"))
def duplicate_first_seen(spark, sf):
    return Q.flag_duplicates(dated_keys(spark, sf)).filter("seen_before").select("row")


# --- reconciliation -------------------------------------------------------------------------------
cte("keyed", f"SELECT *  REPLACE (coalesce(strftime({day('date')}, '%Y-%m-%d'), substr(date, 1, 10)) AS date) FROM three", "three")
cte(
    "weighted",
    "SELECT *, "
    + "CASE " + " ".join(f"WHEN t_{c} > 0 THEN {c} / t_{c}" for c in RC.WEIGHT_ORDER) + " ELSE 1.0 / n END AS weight FROM (SELECT *, count(*) OVER w AS n, "
    + ", ".join(f"sum({c}) OVER w AS t_{c}" for c in RC.WEIGHT_ORDER)
    + " FROM keyed WHERE source_schema <> 'shopify' WINDOW w AS (PARTITION BY date))",
    "keyed",
)
cte(
    "reconciled",
    """
SELECT w.date, w.channel, w.campaign_type, w.campaign_name, w.spend, CASE WHEN a.revenue IS NOT NULL THEN w.weight * a.revenue ELSE w.revenue END AS revenue,
 CASE WHEN a.revenue IS NOT NULL THEN 'reconciled_shopify_with_media' ELSE w.source_schema END AS source_schema, w.row
FROM weighted w LEFT JOIN (SELECT date, sum(revenue) AS revenue FROM keyed WHERE source_schema = 'shopify' GROUP BY date) a ON a.date = w.date
UNION ALL SELECT date, channel, campaign_type, campaign_name, spend, revenue, 'reconciled_shopify', row FROM keyed WHERE source_schema = 'shopify' AND date NOT IN (SELECT date FROM weighted)""",
    "weighted",
)


def keyed(spark, sf, texts=("channel", "campaign_type", "campaign_name")):
    """Parsed once: reconciliation reads its input several times. ``texts`` are the text columns that the query reads."""
    rows = three_sources(spark, sf).withColumn("date", RC.date_key(F.col("date")))
    return checkpoint(rows.select("row", "source_schema", "date", *texts, *MEAS))


@query(
    "jn1_reconcile_authority",
    sql(
        """SELECT upload, CASE WHEN shop AND (web OR ads) THEN 'shopify' WHEN web AND ads THEN 'ga4' END AS authority, n FROM (
SELECT upload, bool_or(source_schema = 'shopify') AS shop, bool_or(source_schema = 'ga4') AS web, bool_or(source_schema = 'ads') AS ads, count(*) AS n FROM (
 SELECT 'all' AS upload, source_schema FROM three UNION ALL SELECT 'without store', source_schema FROM three WHERE source_schema <> 'shopify'
 UNION ALL SELECT 'ads alone', source_schema FROM three WHERE source_schema = 'ads') GROUP BY upload)""",
        "three",
    ),
)
def reconcile_authority(spark, sf):
    """Three uploads of an account: all sources, those without the store, and the ads alone, which have no authority."""
    from adtide.functions.tables import attach

    kind = F.col("source_schema")
    uploads = F.array_compact(F.array(F.lit("all"), F.when(kind != "shopify", "without store"), F.when(kind == "ads", "ads alone")))
    rows = three_sources(spark, sf).select("source_schema", F.explode(uploads).alias("upload"))
    return attach(rows, RC.revenue_authority(rows, ["upload"]), ["upload"]).groupBy("upload", "authority").agg(F.count("*").alias("n"))


@query(
    "src1_read_folder",
    sql(f"SELECT source_schema, channel, campaign_type, count(*) AS n, {r('sum(revenue)', 2)} AS revenue, sum(spend) AS spend FROM reconciled GROUP BY 1, 2, 3", "reconciled"),
)
def read_folder(spark, sf):
    """The three exports as files of one folder, read back with one revenue of record."""
    folder = EX.scratch_dir(spark, "folder")
    for f in (ads_export, web_export, store_export):
        f(spark, sf).drop("row").write.mode("append").option("header", True).csv(folder)
    out = EX.read_folder(spark, folder).groupBy("source_schema", "channel", "campaign_type")
    return rounded(out.agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend")), "revenue", digits=2)


@query("jn2_allocate_authority_revenue", sql(f"SELECT row, source_schema, date, channel, campaign_name, spend, {r('revenue')} AS revenue FROM reconciled", "reconciled"))
def allocate_authority_revenue(spark, sf):
    out = RC.reconcile(keyed(spark, sf, ("channel", "campaign_name")))
    return rounded(out.select("row", "source_schema", "date", "channel", "campaign_name", "spend", "revenue"), "revenue")


@query("jn3_allocation_weights", sql(f"SELECT row, source_schema, date, {r('weight', 8)} AS weight FROM weighted", "weighted"))
def allocation_weights(spark, sf):
    support = keyed(spark, sf, ()).filter(F.col("source_schema") != "shopify")
    return RC.allocation_weights(support, ["date"]).select("row", "source_schema", "date", round_to("weight", 8).alias("weight"))


@query(
    "set2_date_overlap",
    sql(
        f"SELECT {r('100.0 * count(CASE WHEN n = 3 THEN 1 END) / count(*)')} AS date_overlap_pct FROM (SELECT date, count(DISTINCT source_schema) AS n FROM keyed GROUP BY date)",
        "keyed",
    ),
)
def date_overlap(spark, sf):
    return rounded(RC.date_overlap(keyed(spark, sf), "source_schema"), "date_overlap_pct")


@query(
    "set3_duplicate_sources",
    sql(
        """SELECT upload, CAST(count(*) - count(DISTINCT print) AS BIGINT) AS duplicate_sources FROM (SELECT upload, source_file, (count(*), sum(CAST(h AS HUGEINT)), bit_xor(h)) AS print FROM (
 SELECT upload, source_file, hash(date, channel, campaign_type, campaign_name, spend, clicks, impressions, conversions, revenue, roas) AS h FROM (
  SELECT 'plain' AS upload, source_schema AS source_file, * FROM three UNION ALL SELECT 'doubled', source_schema, * FROM three UNION ALL SELECT 'doubled', 'copy', * FROM three WHERE source_schema = 'ga4')) GROUP BY 1, 2) GROUP BY 1""",
        "three",
    ),
)
def duplicate_sources(spark, sf):
    """The three sources as they are, and with a second copy of one of them under another name."""
    rows = three_sources(spark, sf)
    files = F.array_compact(
        F.array(*[F.struct(F.lit(u).alias("upload"), F.col("source_schema").alias("source_file")) for u in ("plain", "doubled")],
                F.when(F.col("source_schema") == "ga4", F.struct(F.lit("doubled").alias("upload"), F.lit("copy").alias("source_file"))))
    )
    columns = [c for c in rows.columns if c not in ("row", "source_schema", "invalid_fields")]
    return RC.duplicate_sources(rows.select("*", F.inline(files)), "source_file", columns, ["upload"])


@query(
    "set4_unseen_channels",
    sql("SELECT DISTINCT channel FROM ads_norm WHERE channel NOT IN (SELECT DISTINCT channel FROM fact)", "ads_norm", "fact"),
)
def unseen_channels(spark, sf):
    return normalized(ads_export(spark, sf)).select("channel").subtract(campaign_fact(spark, sf).select("channel"))


# --- filters and budgets --------------------------------------------------------------------------
@query(
    "flt2_comparable_rows",
    sql("SELECT date, channel, campaign_name, campaign_type, revenue FROM fact WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM fact ORDER BY date DESC LIMIT 30))", "fact"),
)
def comparable_rows(spark, sf):
    return Q.comparable_rows(campaign_fact(spark, sf), 30).select("date", "channel", "campaign_name", "campaign_type", "revenue")


@query(
    "flt3_holdout_split",
    sql("SELECT CASE WHEN date < (SELECT max(date) FROM fact) - 29 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(revenue) AS revenue, min(date) AS first_day, max(date) AS last_day FROM fact GROUP BY 1", "fact"),
)
def holdout_split(spark, sf):
    return (
        Q.holdout_split(campaign_fact(spark, sf), 30)
        .groupBy("part")
        .agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    )


@query("flt4_budget_channel_check", sql("SELECT p AS channel, n AS budget FROM (SELECT trim(platform) || ' ' AS p, CAST(count(*) AS DOUBLE) AS n FROM ads_raw GROUP BY 1) WHERE lower(trim(p)) NOT IN (SELECT lower(channel) FROM fact)", "ads_raw", "fact"))
def budget_channel_check(spark, sf):
    budgets = ads_export(spark, sf).groupBy(F.concat(F.trim("Platform"), F.lit(" ")).alias("channel")).agg(F.count("*").cast("double").alias("budget"))
    return Q.unknown_budget_channels(budgets, campaign_fact(spark, sf))


@query(
    "flt5_budget_value_rules",
    sql(
        """SELECT scenario, CAST(sum(bad) AS BIGINT) AS bad_budgets, sum(CASE WHEN bad = 1 THEN 0 ELSE budget END) AS total_budget, (SELECT sum(spend) FROM fact) AS observed_spend,
 CASE WHEN sum(bad) > 0 THEN 'invalid_budget' WHEN max(target) > 0 AND sum(budget) = 0 THEN 'zero_budget_target' ELSE 'ok' END AS verdict
FROM (SELECT s AS scenario, CASE s WHEN 'negative' THEN -budget WHEN 'zero' THEN 0 ELSE budget END AS budget, CASE WHEN s = 'negative' AND -budget < 0 THEN 1 ELSE 0 END AS bad, CASE WHEN s = 'plan' THEN NULL ELSE 100 END AS target
 FROM budgets, (SELECT unnest(['plan', 'negative', 'zero']) AS s)) GROUP BY scenario""",
        "budgets",
        "fact",
    ),
)
def budget_value_rules(spark, sf):
    fact = campaign_fact(spark, sf)
    plans = demo_budgets(fact).select("*", F.explode(F.array(*[F.lit(s) for s in ("plan", "negative", "zero")])).alias("scenario"))
    s = F.col("scenario")
    amount = F.when(s == "negative", -F.col("budget")).when(s == "zero", 0.0).otherwise(F.col("budget"))
    plans = plans.select("scenario", "channel", amount.alias("budget"), F.when(s != "plan", 100.0).alias("target_revenue"))
    return Q.budget_value_rules(plans, fact.select("spend"))


# --- sinks ----------------------------------------------------------------------------------------
@query("snk1_write_predictions", sql("SELECT * FROM predictions", "predictions"))
def write_predictions(spark, sf):
    """Writes the predictions partitioned by level and reads them back."""
    path = EX.scratch_dir(spark, "predictions")
    EX.write_predictions(FC.baseline_forecast(campaign_fact(spark, sf)), path)
    return spark.read.parquet(path)


@query("snk2_write_canonical", sql(f"SELECT date, channel, campaign_type, campaign_name, {', '.join(MEAS)}, {r('roas')} AS roas FROM fact", "fact"))
def write_canonical(spark, sf):
    path = EX.scratch_dir(spark, "canonical")
    EX.write_canonical(rounded(campaign_fact(spark, sf), "roas"), path)
    schema = "date DATE, channel STRING, campaign_type STRING, campaign_name STRING, " + ", ".join(f"{c} DOUBLE" for c in [*MEAS, "roas"])
    return spark.read.option("header", True).schema(schema).csv(path)


cte(
    "flat_roas",
    """
SELECT level, segment, date_add(last_date, CAST(k AS INTEGER)) AS date, greatest(mean, 0) AS value, greatest(mean - margin, 0) AS lower, greatest(mean + margin, 0) AS upper FROM (
SELECT *, greatest(sd, mean * 0.08) * 1.96 * sqrt(k / 30.0 + 1.0) AS margin FROM (
SELECT level, segment, max(date) AS last_date, avg(roas) AS mean, coalesce(stddev_samp(roas), 0) AS sd FROM last28 GROUP BY 1, 2), (SELECT unnest(range(1, 31)) AS k))""",
    "last28",
)
EXPORT = [f"{b}_{n}" for n in ("revenue", "roas") for b in ("expected", "lower", "upper")]


@query(
    "snk3_daily_forecast_export",
    sql(
        f"""SELECT a.date, {r('a.value')} AS expected_revenue, {r('a.lower')} AS lower_revenue, {r('a.upper')} AS upper_revenue, {r('b.value')} AS expected_roas, {r('b.lower')} AS lower_roas,
 {r('b.upper')} AS upper_roas, CAST(30 AS BIGINT) AS horizon_days, a.level, a.segment AS value, 'flat_projection' AS model_type FROM flat_points a LEFT JOIN flat_roas b USING (level, segment, date)""",
        "flat_points",
        "flat_roas",
    ),
)
def daily_forecast_export(spark, sf):
    series = R.segment_daily(campaign_fact(spark, sf))
    by = ["level", "segment"]
    out = EX.daily_forecast_export(
        FC.flat_projection(series, by, 30), FC.flat_projection(series, by, 30, "roas"), by, "flat_projection"
    )
    return rounded(out, *EXPORT)
