"""Exact top-k inner-product search with KD-trees per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.store import materialise

SAMPLE_ROWS = 20_000
SHARD_ROWS = 8_192
LEAF_ROWS = 256
QUERY_BLOCK = 16_384
ROUTE_ROWS = 256  # of queries whose bounds of all boxes are held at a time
SCALE = 256


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product, by floats where they are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b


class KDTree:
    """Median splits of the widest side, with the tight bounding box of every node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.points, self.ids = points, ids
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._build(np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low, np.float64), np.array(self.high, np.float64)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        mine, here = len(self.low), self.points[rows]
        low, high = here.min(0), here.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        axis = int((high - low).argmax())
        if len(rows) > leaf and high[axis] > low[axis]:
            half = len(rows) // 2
            by = np.argpartition(here[:, axis], half)
            self.kids[mine] = (self._build(rows[by[:half]], leaf), self._build(rows[by[half:]], leaf))
            self.rows[mine] = None
        return mine

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, leaving out ``own`` and whatever is below ``floor``.

        Nodes are taken by the largest inner product that their box allows; the k-th score so far, or the floor that an
        earlier shard left, ends the search.
        """
        bound = np.maximum(self.low * query, self.high * query).sum(1)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst in front
        todo = [(-bound[0], 0)]
        while todo:
            top, node = heapq.heappop(todo)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -top < least:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(todo, (-bound[kid], kid))
                continue
            rows = self.rows[node]
            score = dot(self.points[rows], query)
            keep = np.arange(len(rows)) if least is None else np.flatnonzero(score >= least)
            if len(keep) > 4 * k:
                edge = np.partition(score[keep], -(k + 1))[-(k + 1)]
                keep = keep[score[keep] >= edge]
            for s, i in zip(score[keep].tolist(), self.ids[rows[keep]].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _cells(sample: np.ndarray, depth: int) -> list:
    """The upper levels of the tree, (axis, cut) by node number, fit on a sample; a missing node ends there."""
    nodes, line = {}, [(1, sample)]
    while line:
        n, rows = line.pop()
        if n >= 1 << depth or len(rows) < 2:
            continue
        axis = int((rows.max(0) - rows.min(0)).argmax())
        cut = int(np.median(rows[:, axis]))
        left = rows[:, axis] <= cut
        if left.all() or not left.any():
            continue
        nodes[n] = (axis, cut)
        line += [(2 * n, rows[left]), (2 * n + 1, rows[~left])]
    return nodes


def _cell(nodes: dict, v: Column, n: int = 1) -> Column:
    if n not in nodes:
        return F.lit(n)
    axis, cut = nodes[n]
    return F.when(v[axis] <= cut, _cell(nodes, v, 2 * n)).otherwise(_cell(nodes, v, 2 * n + 1))


def _group_search(k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            tree = KDTree(np.array(points["v"].tolist(), np.int64), points["id"].to_numpy(np.int64))
            for qid, v, floor in zip(queries["query_id"], queries["v"], queries["floor"], strict=True):
                floor = None if pd.isna(floor) else int(floor)
                out += [(qid, i, s) for s, i in tree.search(np.asarray(v, np.int64), qid, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The best inner product that each vector can have in each box."""
    most = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)).astype(object) * np.abs(vectors).max(initial=0).astype(object) * vectors.shape[1]
    if most >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return dot(np.maximum(vectors, 0), high.T) + dot(np.minimum(vectors, 0), low.T)


def _routes(numbers: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool):
    """Send queries (query_id, v) to the shard of the largest bound, or (query_id, v, seen, floor) to the others whose bound
    reaches the floor; a query's bounds of all boxes exist only here."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTE_ROWS):
                part = batch.slice(at, ROUTE_ROWS)
                v = part.column(1)
                bound = _bounds(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), low, high)
                if first:
                    row, to = np.arange(len(v)), bound.argmax(1)
                    floor = pa.nulls(len(v), pa.int64())
                else:
                    floor = part.column(3)
                    least = floor.fill_null(np.iinfo(np.int64).min).to_numpy()
                    row, to = np.nonzero((bound >= least[:, None]) & (numbers[None, :] != part.column(2).to_numpy()[:, None]))
                    floor = floor.take(pa.array(row))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), v.take(take), pa.array(numbers[to].astype(np.int32)), floor], ["query_id", "v", "shard", "floor"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row the k rows with the largest integer inner product, itself left out.

    Components become floor(scale * x). Equal vectors are one point with its k + 1 smallest ids, the only ones that can rank; they
    are cut to these before any shuffle. The upper levels of one KD-tree, fit on at most 20,000 rows chosen by hash, deal
    the points to cells; cells are dealt on by hash to shards of about ``shard_rows`` points, each with its own tree. A
    query first visits the shard with the largest bound (its box's best inner product); its k-th score then goes with it to
    just the other shards whose bound reaches that score. The boxes, one for each ``shard_rows`` points, reach the driver and go
    to the tasks that send the queries, so neither bounds nor points are written for each query: a shard's points are
    sent once for each ``query_block`` queries that visit it, and a task holds one shard and one block.

    Vectors that are null, empty, of another length than the first in order of id, or hold null or non-finite components
    take no part, nor do rows without an id. Rows with equal ids and vectors count once; with equal ids and different
    vectors each is a candidate, and the query is the one least in order. Fewer than k other rows give fewer results. An empty table
    gives no rows; other columns are ignored. Result: query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    quant = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & good).select(
        F.col(id_col).cast("long").alias("id"), quant.alias("v"), queries.alias("asks"))
    head = valid.orderBy("id").select(F.size("v")).first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    valid = materialise(valid.where(F.size("v") == head[0]).distinct(), "kd-vectors")
    alike = Window.partitionBy("v").orderBy("id")
    points = valid.withColumn("turn", F.row_number().over(alike)).where(F.col("turn") <= k + 1).select("id", "v")
    n = valid.count()
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 20)) + 1
    sample = np.array([r[0] for r in valid.where(share).select("v").limit(SAMPLE_ROWS).collect()] or [[0] * head[0]], np.int64)
    depth = max(0, min(8, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    cells = points.withColumn("cell", _cell(_cells(sample, depth), F.col("v")))
    room = {r["cell"]: -(-r["count"] // shard_rows) for r in cells.groupBy("cell").count().collect()}
    base, shards = {}, 0
    for c in sorted(room):
        base[c], shards = shards, shards + room[c]
    number = lambda of: F.create_map(*[F.lit(int(x)) for c in room for x in (c, of[c])])[F.col("cell")]
    placed = materialise(cells.select("id", "v", (number(base) + F.pmod(F.xxhash64("id"), number(room))).cast("int").alias("shard")), "kd-points")
    axes = placed.select("shard", F.posexplode("v").alias("axis", "x")).groupBy("shard", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    corner = F.array_sort(F.collect_list(F.struct("axis", "low", "high")))
    boxes = axes.groupBy("shard").agg(corner.alias("box")).select("shard", "box.low", "box.high").orderBy("shard").collect()
    numbers, low, high = (np.array([r[i] for r in boxes], np.int64) for i in range(3))

    asked = materialise(valid.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query_id"), "v"), "kd-asked")
    routed = "query_id long, v array<long>, shard int, floor long"

    def visit(which: DataFrame) -> DataFrame:
        need = which.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
        rows = which.join(need, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        sent = placed.join(need, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return sent.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInPandas(
            _group_search(k), "query_id long, vec_id long, score long")

    first = materialise(asked.mapInArrow(_routes(numbers, low, high, True), routed), "kd-first")
    near = materialise(visit(first), "kd-near")
    floor = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    left = first.select("query_id", "v", F.col("shard").alias("seen")).join(floor, "query_id", "left")
    rest = visit(materialise(left.mapInArrow(_routes(numbers, low, high, False), routed), "kd-others"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
