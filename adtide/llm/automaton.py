"""Substring deduplication with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

from pyspark.sql import DataFrame

from adtide.llm.repeats import Rule, Segment, cover, finished, removed_windows

WINDOW = 20
GRAM = 5


class SuffixAutomaton:
    """Generalised suffix automaton over words; each state knows the earliest place at which its strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.place = [-1], [0], [None]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.place.append(None)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list, place: tuple[int, int]) -> None:
        """Add a sequence whose first word stands at ``place`` (document, position)."""
        last = 0
        for i, c in enumerate(sequence):
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            end = (place[0], place[1] + i)
            if self.place[last] is None or end < self.place[last]:
                self.place[last] = end

    def close(self) -> None:
        """Hand the earliest places down the suffix links, longest strings first."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, mine = self.link[v], self.place[v]
            if up > 0 and mine is not None and (self.place[up] is None or mine < self.place[up]):
                self.place[up] = mine

    def matches(self, sequence: list, least: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """Matching statistics: (end, length of the longest match ending there, earliest end of its last ``least`` words)."""
        v, size = 0, 0
        for i, c in enumerate(sequence):
            while v and c not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if c in self.next[v]:
                v, size = self.next[v][c], size + 1
            if size >= least:
                u = v
                while self.length[self.link[u]] >= least:
                    u = self.link[u]
                yield i, size, self.place[u]


def judge(shard: list[Segment], rule: Rule):
    """Stream the segments through the automaton of their shard; a window goes if its words end earlier elsewhere."""
    automaton, number = SuffixAutomaton(), {}
    sequences = [[number.setdefault(w, len(number)) for w in s.data.split()] for s in shard]
    for s, seq in zip(shard, sequences, strict=True):
        automaton.add(seq, (s.doc, s.start))
    automaton.close()
    for s, seq in zip(shard, sequences, strict=True):
        runs: list[tuple[int, int]] = []
        for end, _, place in automaton.matches(seq, rule.length):
            if place < (s.doc, s.start + end):
                at = end - rule.length + 1
                if runs and sum(runs[-1]) == at:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((at, 1))
        yield s, runs


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                           shard_bytes: int = 4 << 20, most_segments: int = 20_000) -> DataFrame:
    """Each document without the words that an earlier window of ``window`` words already has.

    Words are maximal runs without the six ASCII blanks. A window whose sequence of words starts earlier (in a document
    with a smaller id, or before in the same one) loses all its words; windows are judged on the input. Equal texts are
    handled once. The segments that may repeat are dealt to shards of bounded size by their anchor (see ``repeats``): a shard's
    segments make up a suffix automaton whose states know their earliest place, and are streamed through it for matching
    statistics. So a shard of the reference goes to just the documents that share an anchor with it, instead of to all.
    An anchor with more than 20,000 different segments is judged by the hashes of its single windows.

    Null and empty texts have no words. Rows with equal ids and texts count as one document and agree; equal ids with
    different texts are ordered by position alone. A null id counts as the largest. An empty table gives no rows; other
    columns are ignored. Result: id, n_words, n_removed, kept (words joined by one space, UTF-8).
    """
    rule = Rule(window, min(GRAM, window), True, False)
    texts, gone = removed_windows(docs, id_col, text_col, rule, judge, "automaton", shard_bytes, most_segments)

    def finish(text, runs, copies, first):
        units = text.split()
        if not first and len(units) >= window:
            return len(units), len(units), b""
        if not runs or not first:
            return len(units), 0, b" ".join(units)
        out = cover(len(units), runs, window)
        return len(units), int(out.sum()), b" ".join(compress(units, ~out))

    return finished(docs, id_col, text_col, texts, gone, finish, "n_words long, n_removed long, kept binary")
