"""Hand-made campaign rows."""

import datetime as dt

FACT = "date date, channel string, campaign_type string, campaign_name string, spend double, clicks double, impressions double, conversions double, revenue double"


def day(i, start=dt.date(2026, 1, 1)):
    return start + dt.timedelta(days=i)


def fact(spark, rows):
    """rows: (day index, channel, spend, revenue)."""
    full = [(day(i), c, "Search", f"{c}-1", float(s), 10.0, 100.0, 1.0, float(r)) for i, c, s, r in rows]
    return spark.createDataFrame(full, FACT)
