"""Plans that keep work and memory in proportion to the rows, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import catalog
from adtide.functions.text import parse_date, read_amount
from adtide.operators import quality as Q
from adtide.plans import facts
from adtide.sources import exports, normalize, reconcile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    """Two orders of one customer and two parts; the first order has two lines of one part."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    write("orders", [(1, 7, dt.date(1996, 1, 2), 300.0, "1-URGENT"), (2, 7, dt.date(1996, 1, 2), 90.0, "5-LOW")], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string")
    write("customer", [(7, "MACHINERY", 3)], "c_custkey long, c_mktsegment string, c_nationkey int")
    write("part", [(5, "TIN", "Brand#1", 10), (6, "TIN", "Brand#2", 20)], "p_partkey long, p_type string, p_brand string, p_size int")
    lines = [(1, 5, 1, 2.0, 100.0, 0.5), (1, 5, 2, 3.0, 100.0, 0.1), (2, 5, 1, 4.0, 50.0, 0.0), (2, 6, 2, 5.0, 40.0, 0.0)]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    return folder


def test_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """A task joins a fixed number of lines; the fact counts an order with two lines of a campaign once."""
    folder = tables(spark, str(tmp_path))
    assert facts.line_parts(spark, spark.range(1000), 10) == 100
    assert facts.line_parts(spark, spark.range(1000), 1000) is None
    expected = [("Brand#1", 9.0, 2.0, 190.0), ("Brand#2", 5.0, 1.0, 40.0)]
    for parts in (None, 7):
        monkeypatch.setattr(facts, "line_parts", lambda *_: parts)
        fact = facts.campaign_fact(spark, folder)
        assert sorted((r.campaign_name, r.clicks, r.conversions, r.revenue) for r in fact.collect()) == expected
        assert ("REPARTITION_BY_NUM" in plan(fact)) == (parts == 7)


def test_duplicate_queries_parse_rows_once(spark, tmp_path):
    folder = tables(spark, str(tmp_path))
    for name in ("val2_duplicate_rows", "val7_duplicate_first_seen"):
        out = catalog.QUERIES[name](spark, folder)
        assert "regexp_replace" not in plan(out) and "lineitem" not in plan(out)
        # Revenues 50, 90, 50 and 40 are four readable days of two campaigns: three rows share the first.
        assert sorted(r.row for r in out.collect()) == ([11, 12, 21] if name.startswith("val2") else [12, 21])


def test_repair_reads_amounts_and_dates_once(spark):
    rows = [(1, "01/05/2026", "a", "$1,200.50"), (2, "20260106", "a", "-3"), (3, "bad", "b", "7")]
    raw = spark.createDataFrame(rows, "row long, date string, campaign_name string, money string").withColumns(
        {"channel": F.lit("x"), "campaign_type": F.lit("y"), "spend": F.lit(1.0), "clicks": F.lit(1.0), "impressions": F.lit(1.0), "conversions": F.lit(1.0), "roas": F.lit(0.0), "revenue": read_amount(F.col("money"))})
    out = Q.clean_repair(raw, "2026-07-10")
    assert "₹" not in plan(out)
    assert sorted((r.campaign_name, str(r.date), r.revenue) for r in out.collect()) == [("a", "2026-01-05", 1200.5), ("b", "2026-01-05", 7.0)]


def test_rows_meet_the_totals_of_their_date_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, "2024-01-05").otherwise("2024-01-06").alias("date"),
                                           *[F.lit(2.0).alias(c) for c in reconcile.WEIGHT_ORDER])
        out = reconcile.allocation_weights(rows, ["date"])
        assert "BroadcastHashJoin" in plan(out) and "hashpartitioning(date" not in plan(out)
        assert out.agg(F.min("weight"), F.max("weight"), F.count("*")).collect()[0][:] == (2e-5, 2e-5, 100_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_field_with_one_column_is_not_searched_for_blanks(spark):
    rows = spark.range(3).select(F.lit("2024-01-05").alias("Day"), F.concat(F.lit("c"), "id").alias("Campaign"), F.col("id").cast("string").alias("Clicks"))
    out = normalize.normalize_facts(rows)
    # The blank rule is left for the campaign name, the one text of this frame that may need another in its place.
    assert plan(out).count("nan|none|null") <= 1
    assert sorted((r.campaign_name, r.clicks, r.channel) for r in out.collect()) == [("c0", 0.0, "Unknown Channel"), ("c1", 1.0, "Unknown Channel"), ("c2", 2.0, "Unknown Channel")]


def test_common_days_skip_the_rewriting(spark):
    texts = {"19960102": "1996-01-02", "01/02/1996": "1996-01-02", "13/02/1996": "1996-02-13", "1996-01-02T00:00:00Z": "1996-01-02", "19961302": None, "12/31/0000": "0000-12-31",
             "1/2/1996": "1996-01-02", " 19960102 ": "1996-01-02", "1996/1/2": "1996-01-02", "2 Jan 1996": "1996-01-02", "1996-01-02T25:00:00Z": None, "00/10/1996": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date(F.col("t")).cast("string").alias("d"), reconcile.date_key(F.col("t")).alias("k"))
    assert {r.t: r.d for r in df.collect()} == texts
    assert {r.t: r.k for r in df.collect()} == {t: d if d else (t or "")[:10] for t, d in texts.items()}


def test_header_pass_does_not_sort_the_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n \nday,cost\n2026-01-01,"5"\n')
    (tmp_path / "b.csv").write_text('day,name\n2026-01-01,"x\ny"\n')
    found = exports.first_lines(spark, str(tmp_path))
    assert "ObjectHashAggregate" in plan(found) and "SortAggregate" not in plan(found)
    assert sorted((h, s) for _, h, s in exports.file_headers(spark, str(tmp_path))) == [(("day", "cost"), False), (("day", "name"), True)]


@pytest.mark.parametrize("name", ["st4_did_effects", "st9_structured_evidence", "st10_evidence_labels", "st11_rank_hypotheses"])
def test_event_effects_read_the_lines_once(spark, tmp_path, name):
    """The order lines are joined once, for the written days or facts; all later steps start from these."""
    assert "o_custkey" not in plan(catalog.QUERIES[name](spark, tables(spark, str(tmp_path))))
