"""Merkle fixity audit of WARC records: trees over ordered records, and a descent along mismatching branches only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.store import materialise

FANOUT = 16
CRLF = "\r\n"


def warc_record(id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> Column:
    """A WARC response record as one string; null parts count as empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:record:"), part(id_col), F.lit(f">{CRLF}WARC-Target-URI: "), part(url_col),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(part(body_col)).cast("string"), F.lit(CRLF + CRLF), part(body_col), F.lit(CRLF + CRLF))


def _leaves(records: DataFrame) -> DataFrame:
    """One leaf for each id: the record's SHA-256, or for several records of an id a hash of their multiset."""
    chunk = [F.sum(F.conv(F.substring("sha", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    several = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *chunk), 256)
    return records.groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.when(F.count(F.lit(1)) == 1, F.max("sha")).otherwise(several).alias("hash"))


def _parents(level: DataFrame) -> DataFrame:
    """Nodes over runs of keys; a hash covers the children's order, hashes and byte lengths, at most FANOUT of them."""
    kids = F.array_sort(F.collect_list(F.struct("key", "hash", "bytes")))
    line = F.array_join(F.transform(kids, lambda c: F.concat_ws(":", c["key"].cast("string"), c["hash"], c["bytes"].cast("string"))), ",")
    return level.groupBy(F.floor(F.col("key") / FANOUT).cast("long").alias("key")).agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(line, 256).alias("hash"))


def merkle_tree(records: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Levels from leaves to root, written once each; a level has a sixteenth of the nodes below it."""
    tree = [materialise(_leaves(records), f"{name}-0")]
    for k in range(1, levels + 1):
        tree.append(materialise(_parents(tree[-1]), f"{name}-{k}"))
    return tree


def _keyed(df: DataFrame, id_col: str, record: Column, low: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), record.alias("record")).select(
        "id", F.coalesce(F.col("id") - low + 1, F.lit(0)).alias("key"), F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("sha"))


def audit(original: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The records in which a replica differs from the original, with their byte range in the original archive.

    An archive is its records in order of id. Leaves stand at the place of their id, so a lost or added record leaves the
    other branches as they are. Each inner node hashes up to 16 children in order with their byte lengths. The two roots are
    compared first; then, level by level, only the children of mismatching nodes are read and joined, and the offset of a child
    is its parent's plus the bytes of its earlier siblings. Equal archives take one comparison.

    Null urls and bodies count as empty, a null id as one place before all others. Records of one id share a leaf, hashed
    as a multiset by sums, so repeats of any number need no gathering. Two empty archives give no rows; other columns are
    ignored. Result: id, status (altered, missing, extra), start_byte, bytes (in the original), expected, found (hashes).
    """
    spark, record = original.sparkSession, warc_record(id_col, url_col, body_col)
    ends = original.select(id_col).union(replica.select(id_col)).agg(F.min(id_col), F.max(id_col)).first()
    low, span, levels = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1, 0
    while span >= FANOUT**levels:
        levels += 1
    trees = [merkle_tree(_keyed(df, id_col, record, low), levels, f"merkle-{side}") for side, df in (("a", original), ("b", replica))]
    bad = spark.createDataFrame([(0, 0)], "parent long, off long")
    for k in range(levels, -1, -1):
        up = F.floor(F.col("key") / FANOUT).cast("long") if k < levels else F.lit(0).cast("long")
        side = [t[k].withColumn("parent", up).join(bad.select("parent"), "parent", "left_semi") for t in trees]
        extra = [F.col("id")] if k == 0 else [F.lit(None).cast("long").alias("id")]
        a, b = (s.select("parent", "key", F.col("hash").alias(f"h{i}"), F.col("bytes").alias(f"b{i}"), extra[0].alias(f"i{i}")) for i, s in enumerate(side))
        both = a.join(b, ["parent", "key"], "full").join(bad, "parent")
        before = F.sum(F.coalesce("b0", F.lit(0))).over(Window.partitionBy("parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        node = both.withColumn("at", F.col("off") + F.coalesce(before, F.lit(0))).where(~F.col("h0").eqNullSafe(F.col("h1")))
        if k:
            bad = materialise(node.select(F.col("key").alias("parent"), F.col("at").alias("off")), f"merkle-bad-{k}")
    status = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "extra").otherwise("altered")
    return node.select(F.coalesce("i0", "i1").alias(id_col), status.alias("status"), F.col("at").alias("start_byte"),
                       F.coalesce("b0", F.lit(0)).alias("bytes"), F.col("h0").alias("expected"), F.col("h1").alias("found"))
