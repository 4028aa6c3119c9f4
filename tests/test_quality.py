import datetime as dt

from adtide.operators import quality as Q
from adtide.operators import readiness as D
from adtide.operators import rollup as R

SCHEMA = "row long, date string, channel string, campaign_type string, campaign_name string, spend double, clicks double, impressions double, conversions double, revenue double, roas double, invalid_fields array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, c, "t", n, s, 1.0, 1.0, 1.0, r, 1.0, []) for i, (d, c, n, s, r) in enumerate(rows)], SCHEMA)


def test_strict_drops_all_copies_and_bad_rows(spark):
    df = frame(spark, [
        ("2026-01-01", "A", "x", 1.0, 2.0), ("2026-01-01", "A", "x", 1.0, 2.0), ("nope", "A", "x", 1.0, 2.0),
        ("2026-01-02", "A", "x", -1.0, 2.0), ("2026-01-03", "B", "x", 1.0, 2.0),
    ])
    flagged = Q.flag_rows(df)
    assert [r.date for r in Q.valid_rows(flagged).collect()] == [dt.date(2026, 1, 3)]
    counts = {r["type"]: r.n for r in Q.issue_counts(Q.row_issues(flagged)).collect()}
    assert counts == {"duplicate": 2, "invalid_date": 1, "negative_spend": 1, "campaign_inconsistency": 1}


def test_repair_fills_and_clamps_dates(spark):
    df = frame(spark, [("2026-07-01", "A", "x", 1.0, 2.0), ("2099-01-01", "A", "y", 1.0, 2.0), ("bad", "A", "z", 1.0, 2.0), ("2026-07-02", "A", "w", 1.0, -2.0)])
    got = {r.campaign_name: r.date for r in Q.clean_repair(df, "2026-07-10").collect()}
    assert got == {"x": dt.date(2026, 7, 1), "y": dt.date(2026, 7, 2), "z": dt.date(2026, 7, 1)}


def test_all_bad_dates_become_consecutive_days(spark):
    df = frame(spark, [("bad", "A", str(i), 1.0, 2.0) for i in range(5)])
    got = sorted((r.row, r.date) for r in Q.repair_dates(df, "2026-01-05").collect())
    assert got == [(i, dt.date(2026, 1, 1 + i)) for i in range(5)]


def test_issue_rates_count_each_row_once(spark):
    """As distinct rows of the listed issues: a conflict adds its first row unless that row is blocked already."""
    df = frame(spark, [
        ("2026-01-01", "A", "x", 1.0, 2.0), ("2026-01-01", "A", "x", 1.0, 2.0), ("2026-01-02", "B", "x", 1.0, 2.0),  # conflict, first row free
        ("nope", "A", "y", -1.0, -2.0), ("2026-01-02", "B", "y", 1.0, 2.0),  # conflict, first row blocked twice over
        ("2026-01-03", "A", "z", 1.0, 2.0), ("2026-01-04", "A", "z", -1.0, 2.0),
    ])
    flagged = Q.flag_rows(df)
    assert D.issue_rates(flagged).select("invalid_rows", "duplicate_rows", "invalid_cells").collect() == [(3, 2, 0)]
    by = flagged.withColumn("account", flagged["row"] > 4)
    got = D.issue_rates(by, ["account"]).select("account", "invalid_rows", "duplicate_rows").collect()
    assert sorted(got) == [(False, 2, 2), (True, 1, 0)]
    assert D.issue_rates(flagged.limit(0)).select("invalid_rows", "duplicate_rows").collect() == [(0, 0)]


def test_category_codes_over_ranges(spark):
    """Codes run on over the ranges of values, each key for itself; nulls have none."""
    df = spark.range(3000).selectExpr("id % 2 AS account", "CASE WHEN id % 7 > 0 THEN concat('n', id % 997) END AS name")
    got = {(r.account, r.value): r.code for r in R.category_codes(df, "name", ["account"]).collect()}
    for account in (0, 1):
        names = sorted({f"n{i % 997}" for i in range(3000) if i % 7 and i % 2 == account})
        assert [got.pop((account, n)) for n in names] == list(range(1, len(names) + 1))
    assert not got
    alone = R.category_codes(df, "name").orderBy("value").collect()
    assert [r.code for r in alone] == list(range(1, 998))
    assert R.category_codes(df.limit(0), "name").collect() == []
