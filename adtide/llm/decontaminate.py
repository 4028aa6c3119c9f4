"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adtide.llm.words import Words, chunks, words

WINDOW = 72
STRIDE = 24
RANK = 96
OVERSAMPLE = 16
COMMON = 0.02  # a term in a larger share of the documents is no feature, unless an item would have under LEAST
LEAST = 6
CONTAINED = 0.5
SAME = 0.5
CLEAR = 0.6  # a common subsequence of this share of the item needs no answer
ANSWER_TERMS = 3
SPARE_RARE = 0.15  # of the item's words: how many of its rare words a clear match must still hold
BLOCK_ITEMS = 5_000
FAN_IN = 16


class Index(NamedTuple):
    item_id: list
    terms: np.ndarray  # sorted term hashes of the items: the vocabulary
    idf: np.ndarray  # 0 for terms that are no feature
    order: list[np.ndarray]  # vocabulary ids of each item, in text order
    answer: list[np.ndarray]  # vocabulary ids that stand for the item's answer
    basis: np.ndarray  # right singular vectors, terms x rank
    latent: np.ndarray  # passages of the items in the latent space
    owner: np.ndarray  # item of each of these passages, ascending
    rare: list[np.ndarray]  # vocabulary ids of each item, so many that a clear match holds at least ``need`` words of them
    need: np.ndarray


def _terms(w: Words, terms: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Vocabulary id of each word, or -1."""
    ids = np.full(len(w.hash), -1, np.int64)
    some = np.flatnonzero(sieve[(w.hash & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(terms, w.hash[some]), len(terms) - 1)
    ids[some] = np.where(terms[at] == w.hash[some], at, -1)
    return ids


def _sieve(terms: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 20, bool)
    sieve[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return sieve


def _added(parts: DataFrame, width: int, kind: str) -> np.ndarray:
    """Sum of the equally long binary vectors of all tasks, in two steps that hold one running sum each."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x, kind) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found = parts.repartition(FAN_IN).mapInArrow(add, "v binary").repartition(1).mapInArrow(add, "v binary").collect()
    return np.frombuffer(found[0][0], kind) if found else np.zeros(width, kind)


def _document_frequency(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents and, over all of them, how many hold each term."""
    size = len(terms)

    def count(batches):
        sieve, total = _sieve(terms), np.zeros(size + 1, np.int64)
        for batch in chunks(batches, "text", 1 << 20):
            w = words(batch.column(0), lower=True, plain=True)
            ids = _terms(w, terms, sieve)
            hit = ids >= 0
            total[0] += batch.num_rows
            pairs = np.unique(w.doc[hit] * size + ids[hit])
            total[1:] += np.bincount(pairs % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = _added(docs.mapInArrow(count, "v binary"), size + 1, "int64")
    return int(total[0]), total[1:]


def _features(w: Words, ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word position and vocabulary id of the words that are features."""
    at = np.flatnonzero(ids >= 0)
    at = at[idf[ids[at]] > 0]
    return at, ids[at]


def _basis(docs: DataFrame, terms: np.ndarray, idf: np.ndarray, seed: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of all passages, by a one-pass randomised sketch.

    Each task adds A'(A Omega) of its passages; the Nystrom form of the sum gives the singular vectors.
    """
    size = len(terms)
    width = min(RANK + OVERSAMPLE, size)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    scaled = omega * idf[:, None]

    def sketch(batches):
        sieve, total = _sieve(terms), np.zeros((size, width))
        for batch in chunks(batches, "text", 1 << 20):
            w = words(batch.column(0), lower=True, plain=True)
            at, ids = _features(w, _terms(w, terms, sieve), idf)
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, "right") - 1
            passage = (at - w.first[doc]) // WINDOW
            head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1])])
            starts, row = np.flatnonzero(head), np.cumsum(head) - 1
            norm = np.sqrt(np.add.reduceat(idf[ids] ** 2, starts))
            y = np.add.reduceat(scaled[ids], starts) / (norm**2)[:, None]
            by = np.argsort(ids, kind="stable")
            mine, first = np.unique(ids[by], return_index=True)
            total[mine] += np.add.reduceat(y[row[by]], first) * idf[mine][:, None]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    y = _added(docs.mapInArrow(sketch, "v binary"), size * width, "float64").reshape(size, width)
    shift = 1e-9 * (np.linalg.norm(y) or 1)
    y = y + shift * omega
    core = omega.T @ y
    low = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.trace(core) * np.eye(width))
    u, s, _ = np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)
    return u[:, s > 1e-9 * (s[0] if len(s) else 1)][:, :RANK]


def build_index(docs: DataFrame, items: list[tuple], seed: int = 0) -> Index | None:
    """Vocabulary, weights and latent space for a block of benchmark items (id, text)."""
    w = words(pa.array([t or "" for _, t in items], pa.string()), lower=True, plain=True)
    terms = np.unique(w.hash)
    if not len(terms):
        return None
    seq = [np.searchsorted(terms, w.hash[w.first[i] : w.first[i + 1]]) for i in range(len(items))]
    n, df = _document_frequency(docs, terms)
    weight = np.log((1 + n) / (1 + df)) + 1e-3
    rare = df <= COMMON * n
    answer, first, need = [], [], []
    for ids in seq:
        uniq, times = np.unique(ids, return_counts=True)
        order_ = np.argsort(df[uniq], kind="stable")
        by, held = uniq[order_], np.cumsum(times[order_])
        rare[by[:LEAST]] = True
        answer.append(by[df[by] > 0][:ANSWER_TERMS])  # a word of no document can be asked of none
        # a match of c words leaves len - c out, so of any s words of the item it holds at least s - (len - c)
        left = len(ids) - _clear(len(ids))
        to = min(len(by), int(np.searchsorted(held, left + max(1, int(SPARE_RARE * len(ids))))) + 1)
        first.append(by[:to])
        need.append(int(held[to - 1]) - left if to else 0)
    idf = np.where(rare, weight, 0.0)
    basis = _basis(docs, terms, idf, seed)
    part, begin, stop = _passages(w.first)
    vec = (basis * idf[:, None])[np.concatenate(seq)]
    latent = np.array([vec[a:b].sum(0) for a, b in zip(begin, stop, strict=True)])
    return Index([i for i, _ in items], terms, idf, seq, answer, basis, latent, part, first, np.array(need))


def _clear(n: int) -> int:
    """Words of an item of n words that need no answer beside them."""
    return int(np.ceil(CLEAR * n - 1e-9))


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of each passage; ``first`` as in ``Words``. A text without words has none."""
    count = np.diff(first)
    steps = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(count)), steps)
    begin = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps))
    return text, begin, np.minimum(begin + WINDOW, first[text + 1])


def _spare(n: int) -> int:
    """Words looked at on either side of a passage for an item of n words; the passage may hold any part of the item."""
    return n // 2 + STRIDE + max(0, n - WINDOW)


def _marks(item: np.ndarray) -> dict[int, int]:
    """The places of each word of an item, one bit a word."""
    marks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        marks[x] = marks.get(x, 0) | 1 << k
    return marks


def _common(places: list[int], size: int) -> int:
    """Longest common subsequence of an item of ``size`` words and a text given by the marks of its words."""
    full = (1 << size) - 1
    row = full
    for m in places:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _common_length(item: np.ndarray, text: np.ndarray) -> int:
    marks = _marks(item)
    return _common([m for x in text.tolist() if (m := marks.get(x))], len(item))


def _runs(w: Words, ids: np.ndarray, sets: list[np.ndarray], need: np.ndarray, index: Index) -> np.ndarray:
    """Codes (passage * items + item) of all passages whose region can hold ``need`` words of the item's set."""
    items = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.argsort(terms := np.concatenate(sets), kind="stable")
    low = np.searchsorted(terms[by], np.arange(len(index.terms) + 1))
    at = np.flatnonzero(ids >= 0)
    times = (low[1:] - low[:-1])[ids[at]]
    pos, start = np.repeat(at, times), np.repeat(low[ids[at]] - (np.cumsum(times) - times), times)
    item = items[by][start + np.arange(len(start))]
    turn = np.argsort(item, kind="stable")
    pos, item = pos[turn], item[turn]
    doc = np.searchsorted(w.first, pos, "right") - 1
    spare = np.array([_spare(len(x)) for x in index.order], np.int64)[item]
    end = np.arange(len(pos)) + need[item] - 1
    ok = np.flatnonzero(end < len(pos))
    end = end[ok]
    ok, end = (x[(item[end] == item[ok]) & (doc[end] == doc[ok]) & (pos[end] - pos[ok] < WINDOW + 2 * spare[ok])] for x in (ok, end))
    count = np.diff(w.first)
    steps = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    a, b, d = pos[ok] - w.first[doc[ok]], pos[end] - w.first[doc[end]], doc[ok]
    lo = np.maximum(0, -(-(b - spare[ok] - WINDOW + 1) // STRIDE))
    hi = np.minimum(steps[d] - 1, (a + spare[ok]) // STRIDE)
    span = np.maximum(hi - lo + 1, 0)
    row = np.repeat((np.cumsum(steps) - steps)[d] + lo - (np.cumsum(span) - span), span) + np.arange(span.sum())
    return np.unique(row * len(index.order) + np.repeat(item[ok], span))


def _hits(w: Words, index: Index, sieve: np.ndarray, scaled: np.ndarray, unit: np.ndarray, norm: np.ndarray) -> list[tuple]:
    """(document, item, word position, cosine, common words) of the best accepted passage of each pair."""
    ids = _terms(w, index.terms, sieve)
    at, feat = _features(w, ids, index.idf)
    if not (ids >= 0).any():
        return []
    doc, begin, stop = _passages(w.first)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, stop)
    answers = np.array([-(-2 * len(x) // 3) for x in index.answer])
    more = np.union1d(_runs(w, ids, index.answer, answers, index), _runs(w, ids, index.rare, index.need, index))
    size_ = len(index.order)
    some = np.union1d(np.flatnonzero(hi > lo), more // size_)
    sums = np.concatenate([np.zeros((1, scaled.shape[1])), np.cumsum(scaled[feat], 0)])
    heads = np.flatnonzero(np.diff(index.owner, prepend=-1))
    place = np.zeros(size_, np.int64)
    place[index.owner[heads]] = np.arange(len(heads))
    best: dict[tuple[int, int], tuple] = {}
    marks: dict[int, dict[int, int]] = {}
    for part in np.array_split(some, len(some) // 4096 + 1):
        vec = sums[hi[part]] - sums[lo[part]]
        dot = vec @ unit.T
        size = np.linalg.norm(vec, axis=1)
        # cosine >= CONTAINED * |item passage| / |passage|: the passage holds that share of the item's passage
        near = np.logical_or.reduceat((dot >= CONTAINED * norm[None, :]) & (norm[None, :] > 0), heads, 1)
        dot = np.maximum.reduceat(dot, heads, 1)
        extra = more[np.searchsorted(more, part[0] * size_) : np.searchsorted(more, (part[-1] + 1) * size_)] if len(part) else more[:0]
        near[np.searchsorted(part, extra // size_), place[extra % size_]] = True
        for r, k in zip(*np.nonzero(near), strict=True):
            i = index.owner[heads[k]]
            p, item = part[r], index.order[i]
            d = int(doc[p])
            spare = _spare(len(item))
            if i not in marks:
                marks[i] = _marks(item)
            mine = marks[i]
            text = ids[max(w.first[d], begin[p] - spare) : min(w.first[d + 1], stop[p] + spare)].tolist()
            places = [m for x in text if (m := mine.get(x))]
            cover = reduce(or_, places, 0)
            answered = sum((mine[x] & cover) > 0 for x in index.answer[i].tolist()) >= answers[i]
            least = SAME * len(item) if answered else _clear(len(item))
            if min(len(places), cover.bit_count()) < least:
                continue
            common = _common(places, len(item))
            if common >= least:
                found = (-common, int(begin[p] - w.first[d]), float(round(dot[r, k] / max(size[r], 1e-12), 6)))
                best[d, int(i)] = min(best.get((d, int(i)), found), found)
    return [(d, i, b, cos, -c) for (d, i), (c, b, cos) in sorted(best.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str):
    """Indexes over blocks of items; only one block at a time is on the driver."""
    items = benchmark.select(F.col(id_col), F.col(text_col)).where(F.length(F.trim(text_col)) > 0)
    part = F.pmod(F.xxhash64(text_col), F.lit(max(1, -(-items.count() // BLOCK_ITEMS))))
    blocks = sorted(r[0] for r in items.select(part).distinct().collect())
    for k in blocks:
        index = build_index(docs.select("text"), [tuple(r) for r in items.where(part == k).orderBy(id_col, text_col).collect()])
        if index is not None:
            yield index


def _searcher(index: Index):
    scaled = index.basis * index.idf[:, None]
    norm = np.linalg.norm(index.latent, axis=1)
    return _sieve(index.terms), scaled, index.latent / np.where(norm == 0, 1, norm)[:, None], norm


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it repeats, verbatim or in paraphrase.

    Documents and items are cut into passages of 72 words, 24 apart, so items of any length are found. Features are the
    items' words that at most 2 % of all documents hold (and the six rarest of an item in any case), weighted by inverse
    document frequency over the whole corpus. A randomised SVD of all passages gives a latent space; a passage is a candidate
    for an item if its cosine to one of the item's passages is at least 0.5 |item passage| / |passage| there. The latent
    space loses paraphrases, so every passage that can meet the rule by its words is a candidate too: with two of the three
    answer words around it, or with as many of the item's rare words as no common subsequence of 60 % can leave out. A
    candidate counts if the longest common subsequence around it has half of the whole item's words and two of the item's
    three rarest words that the corpus holds, which stand for its answer, or 60 % of the item's words without them. No
    passage that meets this rule is lost. Items are handled in blocks of about 5,000, so the driver never holds more.

    Null and empty texts and items match nothing. Equal items each give their pairs; repeated documents give equal pairs.
    Empty tables give no rows; other columns are ignored. Result: id, item id, position (word of the passage's start), cosine, common
    (words), item_words.
    """
    ids, item_ids = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"{id_col} {ids}, {item_col} {item_ids}, position long, cosine double, common long, item_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(texts, benchmark, item_col, item_text):

        def search(batches, index=index):
            parts = _searcher(index)
            for batch in chunks(batches, "text", 1 << 20):
                found = _hits(words(batch.column(1), lower=True, plain=True), index, *parts)
                docs_, items_, pos, cos, common = zip(*found, strict=True) if found else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(docs_, pa.int64())),
                    pa.array([index.item_id[i] for i in items_], item_type), pa.array(pos, pa.int64()), pa.array(cos, pa.float64()),
                    pa.array(common, pa.int64()), pa.array([len(index.order[i]) for i in items_], pa.int64())],
                    [id_col, item_col, "position", "cosine", "common", "item_words"])

        item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_ids]
        out = out.unionByName(texts.mapInArrow(search, schema))
    return out


def clean_of(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that repeat no benchmark item (see ``contaminated``)."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for index in _blocks(texts, benchmark, item_col, item_text):

        def keep(batches, index=index):
            parts = _searcher(index)
            for batch in chunks(batches, text_col, 1 << 20):
                w = words(batch.column(batch.schema.get_field_index(text_col)), lower=True, plain=True)
                good = np.ones(batch.num_rows, bool)
                good[[d for d, *_ in _hits(w, index, *parts)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
