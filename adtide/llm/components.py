"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from adtide.llm.store import materialise

LINKS = 1 << 20  # that a task replaces by stars at a time
MANY = 1 << 12  # links that are worth a second replacement
SPREAD = 4  # tasks of the second replacement, at least


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after the links (a, b): the smallest label that a row reaches."""
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stars(batches):
    """Links that reach as far as the given ones: of each run of links, one from each end to one end of its component."""

    def stars(held):
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
        code = ends.indices.to_numpy().astype(np.int64)
        label = merged(np.arange(len(ends.dictionary)), *np.split(code, 2))
        node = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(x)) for x in (node, label[node])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LINKS:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def _written(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The distinct links, written, with their number and a sum of their hashes, taken by the way."""
    seen = Observation()
    edges = materialise(links.distinct().observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total")), name)
    return edges, (seen.get["n"], seen.get["total"])


def components(links: DataFrame, name: str = "components", rounds: int = 100) -> DataFrame:
    """The smallest id reachable from each linked id: columns id, component.

    ``links`` has columns a and b; order, repeats and self-links are without effect, null ends are left out. A step joins
    each link with the smallest neighbour of one end, found by a partial aggregation, so a hub is never gathered in one
    task. Before the first step each task replaces its links, a bounded number at a time, by stars of the same reach; then
    the stars' links, in as few tasks as that number allows, are replaced likewise, so that an id in links of all tasks
    keeps few of them.
    Every round is written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    given = links.where("a <> b").select("a", "b")
    stars = lambda e: e.mapInArrow(_stars, given.schema).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, was = _written(stars(given), name)
    if was[0] > MANY:
        edges, was = _written(stars(edges.coalesce(max(SPREAD, -(-was[0] // LINKS)))), name)
    for _ in range(rounds if was[0] else 0):
        least = both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: larger neighbours of a node go to its smallest neighbour (or itself)
        large = (edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # small-star: a node and its smaller neighbours go to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        low = large.join(small, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, now = _written(small.select("a", F.col("m").alias("b")).union(low), name)
        if was == now:
            break
        edges, was = after, now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
