"""Every SQL text belongs to a query; a few families are compared in full on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", ["fc12_baseline_predictions", "prj3_normalize_ads", "val1_row_issues", "pl7_capped_allocation", "st1_detect_anomalies", "agg4_channel_summary", "jn6_event_window_join", "st10_evidence_labels", "win8_horizon_features"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(x) for x in r)) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(str(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())
    assert sorted(names) == cols and got == want and got
