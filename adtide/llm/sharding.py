"""Minimax contiguous partition of atomic groups into shards, with built-in functions only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.store import materialise

BLOCKS = 65_536
PIECE = 256
OVERHEAD = 16


class _Line:
    """Prefix sums of the ordered group sizes: block totals on the driver, a block's inner sums fetched when a cut meets it."""

    def __init__(self, totals: list, inner: DataFrame):
        self.inner, self.known = inner, {}
        self.block, self.upto, self.rows = [], [0], [0]
        for r in totals:
            self.block.append(r["block"])
            self.upto.append(self.upto[-1] + r["bytes"])
            self.rows.append(self.rows[-1] + r["n"])
        self.total = self.upto[-1]

    def fetch(self, wanted: set[int]) -> None:
        want = {i for k in wanted for i in (k - 1, k, k + 1) if 0 <= i < len(self.block)} - self.known.keys()
        at = {self.block[i]: i for i in want}
        for i in want:
            self.known[i] = []
        for r in self.inner.where(F.col("block").isin(list(at))).select("block", "upto", "upto_n").collect():
            self.known[at[r["block"]]].append((r["upto"], r["upto_n"]))
        for i in want:
            self.known[i].sort()

    def cut(self, start: int, capacity: int, missing: set[int] | None) -> tuple[int, int]:
        """Byte and row position behind the last group that still fits; unknown blocks go to ``missing``."""
        target = start + capacity
        k = bisect_right(self.upto, target) - 1
        if k >= len(self.block):
            return self.total, self.rows[-1]
        if k not in self.known:
            if missing is not None:
                missing.add(k)
            return self.upto[k], self.rows[k]
        j = bisect_right(self.known[k], (target - self.upto[k], float("inf")))
        into, rows = self.known[k][j - 1] if j else (0, 0)
        return self.upto[k] + into, self.rows[k] + rows

    def greedy(self, capacity: int, shards: int, exact: bool = True) -> list[tuple[int, int]] | None:
        """The cuts behind each full shard, or None where ``shards`` of this capacity do not hold all groups."""
        while True:
            missing: set[int] = set()
            cuts, at = [(0, 0)], 0
            while at < self.total and len(cuts) <= shards:
                nxt = self.cut(at, capacity, missing if exact else None)
                if nxt[0] <= at and not missing:
                    return None
                if nxt[0] <= at:
                    break
                cuts.append(nxt)
                at = nxt[0]
            if missing:
                self.fetch(missing)
                continue
            return cuts if at >= self.total else None


def _smallest(lo: int, hi: int, holds) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid + 1, hi)
    return lo


def minimax_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = OVERHEAD, blocks: int = BLOCKS) -> DataFrame:
    """Shard and slot of every row so that the largest shard is as small as whole groups of equal texts allow.

    Groups are ordered by the SHA-256 of their text. A group larger than an even share of what is left gets a shard of
    its own, ahead of the others. For the rest the smallest capacity is binary-searched: a check walks the ordered
    prefix sums greedily, with block totals (at most ``blocks`` rows) on the driver and the inner sums of just the
    blocks in which cuts fall. Slots count from 0 without gaps; members of a group are numbered in pieces of about 256
    rows, so a group of any size is spread.

    A null text has no bytes and checksum 0, and null texts form one group. A null id sorts first; repeated rows each
    get a slot. An empty table gives no rows. Columns other than the id and text are ignored. Result: ``id_col``,
    size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).
    """
    text = F.col(text_col)
    items = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("gid"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("crc"),
    )
    block = F.conv(F.substring("gid", 1, 12), 16, 10).cast("decimal(20,0)") % blocks
    groups = materialise(
        items.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select("*", F.coalesce(block.cast("long"), F.lit(0)).alias("block")), "shard-groups")
    total = groups.agg(F.sum("bytes"), F.max("n")).first()
    top = groups.select("gid", "bytes").orderBy(F.desc("bytes"), "gid").limit(shards).collect()
    own, left = [], total[0] or 0
    for r in top[: shards - 1]:
        if r["bytes"] * (shards - len(own)) <= left:
            break
        own.append(r["gid"])
        left -= r["bytes"]
    rest = shards - len(own)

    in_block = Window.partitionBy("block").orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)
    inner = materialise(
        groups.where(~F.col("gid").isin(own) if own else F.lit(True)).select(
            "*", F.sum("bytes").over(in_block).alias("upto"), F.sum("n").over(in_block).alias("upto_n")), "shard-line")
    sums = inner.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("most"))
    totals = sums.orderBy("block").collect()
    line = _Line(totals, inner)
    cuts = [(0, 0)]
    if totals:
        least = max(-(-line.total // rest), max(r["most"] for r in totals))
        coarse = _smallest(least, line.total, lambda c: line.greedy(c, rest, exact=False) is not None)
        cuts = line.greedy(_smallest(least, coarse, lambda c: line.greedy(c, rest) is not None), rest)

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("off"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off_n"))
    at, at_n = F.col("off") + F.col("upto") - F.col("bytes"), F.col("off_n") + F.col("upto_n") - F.col("n")
    inside: Column = F.lit(0)
    base: Column = F.lit(0).cast("long")
    for k, (pos, rows) in enumerate(cuts[1:-1], 1):
        inside, base = F.when(at >= pos, k).otherwise(inside), F.when(at >= pos, F.lit(rows).cast("long")).otherwise(base)
    placed = inner.join(offsets, "block").select("gid", "n", (inside + len(own)).alias("shard"), (at_n - base).alias("base"))
    if own:
        lead: Column = F.lit(None).cast("int")
        for k, gid in enumerate(own):
            lead = F.when(F.col("gid") == gid, k).otherwise(lead)
        placed = placed.unionByName(groups.where(F.col("gid").isin(own)).select("gid", "n", lead.alias("shard"), F.lit(0).cast("long").alias("base")))

    piece = F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("n") / PIECE))
    members = items.join(placed, "gid").withColumn("piece", piece)
    members = members.withColumn("rank", F.row_number().over(Window.partitionBy("gid", "piece").orderBy("id")) - 1)
    skip: Column = F.lit(0)
    if (total[1] or 0) > PIECE:
        each = items.join(placed.where(F.col("n") > PIECE), "gid").groupBy("gid", piece.alias("piece")).count()
        earlier = Window.partitionBy("gid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        members = members.join(each.select("gid", "piece", F.sum("count").over(earlier).alias("skip")), ["gid", "piece"], "left")
        skip = F.coalesce("skip", F.lit(0))
    return members.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("base") + skip + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
