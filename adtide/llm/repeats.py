"""Routing of repeated windows: what suffix-automaton and suffix-array deduplication share.

A window is L consecutive units (words or bytes) of one text. Its anchor is the k-gram with the least hash in it, so equal
windows have equal anchors at equal offsets. Windows of a text that follow each other with one anchor form a segment. Only
segments whose anchor occurs again can hold a repeat; they are cut out of the text, equal ones become one row, and all
segments of an anchor meet in one shard, where an index decides. What it finds goes back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adtide.llm.packing import pack, unpacked
from adtide.llm.store import materialise
from adtide.llm.words import _BYTE, buffers, prefix, window_hash, words

LAST = (1 << 63) - 1
_POS = np.uint64(27)


class Rule(NamedTuple):
    length: int  # units in a window
    gram: int  # units in an anchor
    by_word: bool
    all_go: bool  # remove every copy, or all but the first


class Segment(NamedTuple):
    sid: bytes
    data: bytes
    n: int  # windows in it
    off: int  # of the anchor, in units
    doc: int
    start: int
    copies: int


#: Takes the segments of whole anchors; yields (segment, removed runs (first window, number)).
Judge = Callable[[list[Segment], Rule], Iterator[tuple[Segment, list[tuple[int, int]]]]]


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    grid = padded.reshape(-1, w)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def segments(sums: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Document, first window (both as unit position in the chunk), number of windows, anchor and its hash, by segment."""
    n, length = len(sums) - 1, rule.length
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    at = np.arange(n - rule.gram + 1)
    gram = window_hash(sums, at, at + rule.gram)
    low = np.uint64((1 << 27) - 1)
    least = _sliding_min(((gram >> _POS) << _POS) | (at.astype(np.uint64) & low), length - rule.gram + 1)
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    sizes = np.diff(first)
    valid = start + length <= np.repeat(first[1:], sizes)[: len(anchor)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    head, tail = np.flatnonzero(new), np.flatnonzero(last)
    doc = np.searchsorted(first, head, "right") - 1
    return doc, head, tail - head + 1, anchor[head], gram[anchor[head]]


def _find(rule: Rule):
    def find(batches):
        for batch in unpacked(batches):
            column = batch.column(1)
            if rule.by_word:
                w = words(column)
                sums, first = prefix(w.hash), w.first
            else:
                data, first = buffers(column)
                sums = prefix(_BYTE[data])
            doc, head, n, anchor, h = segments(sums, first, rule)
            yield pa.RecordBatch.from_arrays([
                pa.array(h.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((head - first[doc]).astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array((anchor - head).astype(np.int32))], ["h", "row", "start", "n", "off"])

    return find


def _cut(rule: Rule):
    def cut(batches):
        for batch in unpacked(batches):
            key, rows, ids, start, n, off, sid, data = [], [], [], [], [], [], [], []
            for row, doc, parts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = text.split() if rule.by_word else None
                for p in parts:
                    stop = p["start"] + p["n"] + rule.length - 1
                    piece = b" ".join(units[p["start"] : stop]) if rule.by_word else text[p["start"] : stop]
                    for col, x in zip((key, rows, ids, start, n, off, data), (p["h"], row, doc, p["start"], p["n"], p["off"], piece), strict=True):
                        col.append(x)
                    sid.append(hashlib.blake2b(piece, digest_size=16, salt=p["off"].to_bytes(8, "little")).digest())
            yield pa.RecordBatch.from_arrays([
                pa.array(key, pa.int64()), pa.array(sid, pa.binary()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(data, pa.binary())],
                ["h", "sid", "row", "doc", "start", "n", "off", "data"])

    return cut


def _judged(rule: Rule, judge: Judge, shard_bytes: int):
    """Judge the segments of whole anchors, about ``shard_bytes`` at a time; rows arrive in the order of anchors."""

    def run(batches):
        shard, group, size, at = [], [], 0, None

        def close():
            nonlocal group, size
            if len(group) > 1:
                shard.extend((at, s) for s in group)
                size += sum(len(s.data) for s in group)
                group = []
                return []
            out = [(at, s, [(0, s.n)] if rule.all_go and s.copies > 1 else []) for s in group]
            group = []
            return out

        def flush():
            nonlocal size
            keys = {s.sid: k for k, s in shard}
            out = [(keys[s.sid], s, runs) for s, runs in judge([s for _, s in shard], rule)] if shard else []
            shard.clear()
            size = 0
            return out

        def batch_of(found):
            kept = [(k, s.sid, s.doc, s.start, [{"at": a, "len": b} for a, b in runs]) for k, s, runs in found if runs or s.copies > 1]
            cols = list(zip(*kept, strict=True)) if kept else [()] * 5
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
                pa.array(cols[4], pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32())])))], ["h", "sid", "doc", "start", "runs"])

        for batch in batches:
            found = []
            for h, sid, data, n, off, doc, start, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != at:
                    found += close()
                    if size >= shard_bytes:
                        found += flush()
                    at = h
                group.append(Segment(sid, data, n, off, doc, start, copies))
            if found:
                yield batch_of(found)
        yield batch_of(close() + flush())

    return run


def _by_window(rule: Rule):
    """The single windows of segments, by 128-bit hash: the way for anchors with too many different segments."""

    def split(batches):
        for batch in batches:
            out = []
            for row, doc, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = data.split() if rule.by_word else data
                for i in range(n):
                    piece = b" ".join(units[i : i + rule.length]) if rule.by_word else units[i : i + rule.length]
                    out.append((hashlib.blake2b(piece, digest_size=16).digest(), row, doc, start + i))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["w", "row", "doc", "start"])

    return split


def removed_windows(docs: DataFrame, id_col: str, text_col: str, rule: Rule, judge: Judge, name: str,
                    shard_bytes: int = 4 << 20, most_segments: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (tid, row, doc, copies, packed) and the window runs to remove from each (row, runs).

    ``doc`` is the smallest id of the rows with this text (null counts as the largest number). The runs hold for that
    document; every window of a copy with another id occurs earlier.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tid"), F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("doc"), text.alias("text"))
    packed = rows.mapInArrow(pack, "tid binary, doc long, packed binary")
    texts = materialise(packed.groupBy("tid").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"))
                        .withColumn("row", F.monotonically_increasing_id()), f"{name}-texts")
    found = texts.select("row", "packed").mapInArrow(_find(rule), "h long, row long, start int, n int, off int")
    again = found.groupBy("h").count().where("count > 1").select("h")
    spots = found.join(again, "h").groupBy("row").agg(F.collect_list(F.struct("h", "start", "n", "off")).alias("parts"))
    cut = materialise(texts.select("row", "doc", "packed").join(spots, "row").select("row", "doc", "parts", "packed").mapInArrow(
        _cut(rule), "h long, sid binary, row long, doc long, start int, n int, off int, data binary"), f"{name}-segments")
    kinds = cut.select("h", "sid").distinct()
    crowded = materialise(kinds.groupBy("h").count().where(F.col("count") > most_segments).select("h"), f"{name}-crowded")
    many = crowded.count()
    plain = cut.join(crowded, "h", "left_anti") if many else cut
    distinct = plain.groupBy("h", "sid").agg(
        F.first("data").alias("data"), F.first("n").alias("n"), F.first("off").alias("off"), F.min(F.struct("doc", "start")).alias("head"), F.count(F.lit(1)).alias("copies"))
    ready = distinct.select("h", "sid", "data", "n", "off", "head.doc", "head.start", "copies").repartition("h").sortWithinPartitions("h")
    judged = ready.mapInArrow(_judged(rule, judge, shard_bytes), "h long, sid binary, doc long, start int, runs array<struct<at:int,len:int>>")
    verdict = materialise(judged, f"{name}-verdict").select("h", "sid", F.col("doc").alias("head_doc"), F.col("start").alias("head_start"), "runs")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("len")))
    runs = F.when((F.col("doc") == F.col("head_doc")) & (F.col("start") == F.col("head_start")), F.col("runs")).otherwise(whole)
    gone = plain.select("h", "sid", "row", "doc", "start", "n").join(verdict, ["h", "sid"]).select(
        "row", F.transform(runs, lambda r: F.struct((F.col("start") + r["at"]).alias("at"), r["len"].alias("len"))).alias("runs")).where(F.size("runs") > 0)
    if many:
        single = cut.join(crowded, "h", "left_semi").select("row", "doc", "start", "n", "data").mapInArrow(
            _by_window(rule), "w binary, row long, doc long, start int")
        single = materialise(single, f"{name}-windows")
        first = single.groupBy("w").agg(F.min(F.struct("doc", "start")).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        later = single.join(first, "w").where(F.lit(rule.all_go) | (F.struct("doc", "start") != F.col("head")))
        gone = gone.union(later.select("row", F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("len")))))
    return texts, materialise(gone.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs")), f"{name}-gone")


def cover(n: int, runs: list[dict], length: int) -> np.ndarray:
    """Which of n units lie in a removed window."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edge[r["at"]] += 1
        edge[r["at"] + r["len"] + length - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def finished(docs: DataFrame, id_col: str, text_col: str, texts: DataFrame, gone: DataFrame, finish, fields: str) -> DataFrame:
    """Results of ``finish(text, runs, copies, first)`` for each document: ``first`` for the row whose id heads its text."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in unpacked(batches):
            out = []
            for tid, doc, copies, runs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append({"tid": tid, "doc": doc, **{
                    side: dict(zip(names, finish(text, runs, copies, side == "lead"), strict=True)) if side == "lead" or copies > 1 else None
                    for side in ("lead", "rest")}})
            yield pa.RecordBatch.from_pylist(out, arrow)

    typed = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    each = pa.struct([(f.split()[0], typed[f.split()[1]]) for f in fields.split(", ")])
    arrow = pa.schema([("tid", pa.binary()), ("doc", pa.int64()), ("lead", each), ("rest", each)])
    inner = f"struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>"
    done = texts.join(gone, "row", "left").select("tid", "doc", "copies", "runs", "packed").mapInArrow(
        run, f"tid binary, doc long, lead {inner}, rest {inner}").withColumnRenamed("doc", "head")
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).alias("id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tid"))
    mine = F.when(F.coalesce("id", F.lit(LAST)) == F.col("head"), F.col("lead")).otherwise(F.col("rest"))
    return light.join(done, "tid").select(F.col("id").alias(id_col), mine.alias("r")).select(id_col, *[F.col(f"r.{k}") for k in names])
