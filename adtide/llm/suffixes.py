"""Suffix-array deduplication with a logarithmic family of indexes."""

from __future__ import annotations

from bisect import bisect_left
from heapq import merge
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from adtide.llm.repeats import Rule, Segment, cover, finished, removed_windows

WINDOW = 400
GRAM = 32
BATCH = 256


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    diff = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (diff.bit_length() + 7) // 8


class SuffixLevels:
    """Sorted arrays of anchored suffixes; equal-sized levels merge, and a merge scan finds the long matches.

    An entry is (suffix from the anchor on, what stands before the anchor, reversed, number). Entries that share the anchor
    stand together. ``found[number]`` gathers intervals of anchor offsets at which a window of the entry has a match.
    """

    def __init__(self, gram: int, length: int) -> None:
        self.gram, self.length = gram, length
        self.levels: list[list[tuple[bytes, bytes, int]]] = []
        self.found: dict[int, list[tuple[int, int]]] = {}

    def add(self, batch: list[tuple[bytes, bytes, int]]) -> None:
        level = sorted(batch)
        self._scan(level)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            self._merge()

    def close(self) -> None:
        while len(self.levels) > 1:
            self._merge()

    def _merge(self) -> None:
        new, old = self.levels.pop(), self.levels.pop()
        numbers = {e[2] for e in new}
        level = list(merge(old, new))
        self._scan(level, numbers)
        self.levels.append(level)

    def _scan(self, level, new: set[int] | None = None) -> None:
        for _, group in groupby(level, key=lambda e: e[0][: self.gram]):
            rows = list(group)
            if len(rows) > 1 and (new is None or 0 < sum(e[2] in new for e in rows) < len(rows)):
                self._match(rows)

    def _match(self, rows) -> None:
        """Join neighbours by falling common prefix; of the two sides, only neighbours in reversed order can add a match."""
        home = list(range(len(rows)))
        order = {i: [(rows[i][1], i)] for i in home}
        prefix = sorted(((common(rows[i][0], rows[i + 1][0]), i) for i in range(len(rows) - 1)), reverse=True)
        most = max(len(r[1]) for r in rows)

        def root(i: int) -> int:
            while home[i] != i:
                home[i] = home[home[i]]
                i = home[i]
            return i

        for right, i in prefix:
            if right + most < self.length:
                break
            a, b = root(i), root(i + 1)
            if len(order[a]) < len(order[b]):
                a, b = b, a
            large = order[a]
            for x in order[b]:
                k = bisect_left(large, x)
                for y in large[max(0, k - 1) : k + 1]:
                    left = common(x[0], y[0])
                    if left + right >= self.length:
                        for e in (x, y):
                            self.found.setdefault(rows[e[1]][2], []).append((self.length - right, left))
            order[a] = list(merge(large, order.pop(b)))
            home[b] = a


def judge(shard: list[Segment], rule: Rule):
    """Index the segments batch by batch; a window goes if it has a match, or if its whole segment occurs again."""
    index = SuffixLevels(rule.gram, rule.length)
    for at in range(0, len(shard), BATCH):
        index.add([(s.data[s.off :], s.data[: s.off][::-1], at + i) for i, s in enumerate(shard[at : at + BATCH])])
    index.close()
    for i, s in enumerate(shard):
        if s.copies > 1:
            yield s, [(0, s.n)]
            continue
        hit = np.zeros(s.n + 1, bool)
        for low, high in index.found.get(i, ()):
            hit[max(0, s.off - high) : max(0, s.off - low + 1)] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[: s.n], [False]])))
        yield s, [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                        shard_bytes: int = 16 << 20, most_segments: int = 20_000) -> DataFrame:
    """Each document without the bytes of any ``window``-byte string that starts anywhere else too.

    Texts are UTF-8 bytes; overlapping matches and matches inside one document count, matches across documents do not
    exist, and strings are judged on the input, so every copy goes. Equal texts are handled once. Segments that may repeat are dealt
    to shards by their anchor (see ``repeats``). In a shard, batches of segments get suffix arrays over their anchors; a
    new level is merge-scanned with the levels of its size, which finds every match of at least ``window`` bytes
    around an anchor from the common prefixes to the right and the reversed ones to the left. An anchor with more than
    20,000 different segments is judged by the hashes of its single windows.

    Null and empty texts have no bytes. Repeated rows are copies of each other. A null id is kept as it is. An empty table
    gives no rows; other columns are ignored. Result: id, n_bytes, n_removed, n_spans, kept (binary).
    """
    rule = Rule(window, min(GRAM, window), False, True)
    texts, gone = removed_windows(docs, id_col, text_col, rule, judge, "suffixes", shard_bytes, most_segments)

    def finish(text, runs, copies, first):
        if copies > 1 and len(text) >= window:
            return len(text), len(text), 1, b""
        if not runs:
            return len(text), 0, 0, text
        out = cover(len(text), runs, window)
        spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
        return len(text), int(out.sum()), spans, np.frombuffer(text, np.uint8)[~out].tobytes()

    return finished(docs, id_col, text_col, texts, gone, finish, "n_bytes long, n_removed long, n_spans long, kept binary")
