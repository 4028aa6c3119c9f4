"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.store import free_names, materialise
from adtide.llm.words import chunks, word_counts

MAX_PATTERNS = 100_000
BUCKET_DIGITS = 3  # of the hexadecimal order key: 4096 buckets a pattern


def _count_words(batches):
    for batch in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2)), pa.int64())], ["id", "pattern", "size"])


def targets(sizes: dict, weights: Sequence[int], cap: int) -> dict:
    """Shares of the sum of sizes by weight (cycled over the sources by code point, null last), each at most cap sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    total = Fraction(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(weight[s] for s in open_)
        now = {s: rest * weight[s] / share for s in open_}
        over = [s for s in open_ if now[s] > cap * sizes[s]]
        if not over:
            return {s: float(x) for s, x in {**fixed, **now}.items()}
        fixed.update({s: Fraction(cap * sizes[s]) for s in over})


def route(capacity: dict, quota: dict, cap: int) -> dict:
    """Min-cost flow from patterns to source quotas; the e-th pass over a pattern costs e a word.

    ``capacity``: words of each pattern (a tuple of sources); ``quota``: whole words of each source. Returns the flow of
    each (pattern, source). Shortest augmenting paths with potentials; the graph has the patterns and sources only.
    """
    patterns, names = list(capacity), list(quota)
    node = {("p", p): 1 + i for i, p in enumerate(patterns)} | {("s", s): 1 + len(patterns) + i for i, s in enumerate(names)}
    end = len(node) + 1
    arcs: list[list[int]] = []  # to, room, cost; arc k and k ^ 1 are opposite
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def add(a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])
        return len(arcs) - 2

    flows = {}
    for p in patterns:
        for e in range(1, cap + 1):
            add(0, node["p", p], capacity[p], e)
        for s in p:
            flows[p, s] = add(node["p", p], node["s", s], cap * capacity[p], 0)
    for s in names:
        add(node["s", s], end, quota[s], 0)
    potential = [0] * (end + 1)
    while True:
        far, via, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in out[a]:
                b, room, cost = arcs[k]
                if room and (n := d + cost + potential[a] - potential[b]) < far.get(b, n + 1):
                    far[b], via[b] = n, k
                    heapq.heappush(heap, (n, b))
        if end not in far:
            return {key: arcs[k ^ 1][1] for key, k in flows.items()}
        for a, d in far.items():
            potential[a] += d
        most = max(far.values())
        for a in range(end + 1):
            if a not in far:
                potential[a] += most
        path, a = [], end
        while a:
            path.append(via[a])
            a = arcs[via[a] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room


def _whole(quota: dict) -> dict:
    return {s: int(q + 0.5) for s, q in quota.items()}


def membership(sources: Column | None = None) -> Column:
    """The sorted distinct sources of a row as JSON; null or none at all counts as the one null source."""
    member = F.array(F.col("source")) if sources is None else sources
    return F.to_json(F.when(F.size(member) > 0, F.array_sort(F.array_distinct(member))).otherwise(F.array(F.lit(None).cast("string"))))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None,
                weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Words to take from each document so that every source comes near its target.

    ``sources`` is an array column: the sources a document belongs to (default: the one of column ``source``). Documents
    are aggregated by this membership pattern; only patterns (at most 100,000, or an error) reach the driver, where the
    flow is solved. A pattern gives whole passes to all its documents and one more to those that come first in the seeded
    order md5(seed:id), up to the document whose middle passes the remaining words; so a pattern misses its flow by half a
    document at most. The order's cumulative sums are taken over 4096 hash buckets a pattern and inside the one bucket
    with the cut, so no pattern is gathered in one task.

    Null or empty texts have no words and take none. A null source is a source of its own, last in order; a null or
    empty array counts as it. Rows with equal ids are ordered together and share one fate. An empty table gives no rows.
    Result: documents (id, pattern as JSON, size, repeats, taken) and sources (source, size, target, routed).
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), membership(sources).alias("pattern"), F.col(text_col).alias("text"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    items = materialise(raw.mapInArrow(_count_words, f"id {id_type}, pattern string, size long").withColumn("key", key), "mix-items")

    found = items.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    name = {tuple(json.loads(r["pattern"])): r["pattern"] for r in found}
    capacity = {tuple(json.loads(r["pattern"])): r["size"] for r in found}
    total: dict = {}
    for p, n in capacity.items():
        for s in p:
            total[s] = total.get(s, 0) + n
    wanted = targets(total, weights, cap) if total else {}
    if sum(capacity.values()) < sum(total.values()):  # overlaps: targets share the words that exist
        scale = sum(capacity.values()) / sum(total.values())
        wanted = {s: x * scale for s, x in wanted.items()}
    flow = route(capacity, _whole(wanted), cap)
    rows = []
    for p, n in capacity.items():
        take = sum(flow[p, s] for s in p)
        rows.append((name[p], take // n if n else 0, take % n if n else 0))
    plan = spark.createDataFrame(rows, "pattern string, passes long, rest long")

    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = items.withColumn("bucket", bucket).groupBy("pattern", "bucket").agg(F.sum("size").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cut = (sums.withColumn("upto", upto).join(F.broadcast(plan), "pattern")
           .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("here") <= F.col("rest")))
           .select("pattern", "bucket", (F.col("upto") - F.col("here")).alias("before"), "rest"))
    edge = items.withColumn("bucket", bucket).join(F.broadcast(cut), ["pattern", "bucket"])
    running = Window.partitionBy("pattern").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("pattern", "key")
    middle = F.col("before") + F.sum("size").over(running) - F.sum("size").over(alike) / 2
    last = (edge.withColumn("middle", middle).groupBy("pattern", "bucket")
            .agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("key"))).alias("last")))
    limits = {r["pattern"]: r["last"] or r["bucket"] for r in last.collect()}
    plan = spark.createDataFrame([(*r, limits.get(r[0])) for r in rows], "pattern string, passes long, rest long, last string")
    more = F.when((F.col("rest") > 0) & (F.col("key") <= F.col("last")), 1).otherwise(0)
    chosen = items.join(F.broadcast(plan), "pattern").withColumn("repeats", F.col("passes") + more).select(
        F.col("id").alias(id_col), "pattern", "size", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    routed = {s: sum(f for (_, t), f in flow.items() if t == s) for s in total}
    table = spark.createDataFrame([(s, total[s], wanted[s], routed[s]) for s in total], "source string, size long, target double, routed long")
    return chosen, table


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it (see ``mix_sources``)."""
    chosen, _ = mix_sources(docs, id_col, text_col, **options)
    own = free_names(docs, "id", "pattern", "repeats", "copy")
    times = chosen.select(F.col(id_col).alias(own[0]), F.col("pattern").alias(own[1]), F.col("repeats").alias(own[2])).where(F.col(own[2]) > 0).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own[0])) & (membership(options.get("sources")) == F.col(own[1]))
    return (docs.join(times, same)
            .withColumn(own[3], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own[2])))).select(docs.columns))
