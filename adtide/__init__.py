"""Campaign-performance analytics expressed as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a lazy DataFrame. ``keys`` names the leading
grouping columns (for example an account id), so one job serves every account.
"""
