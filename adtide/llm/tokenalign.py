"""Cross-tokenizer alignment: groups of tokens of two tokenizers by pointer jumping, and how often their ids are linked."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adtide.llm.store import materialise
from adtide.llm.words import chunks

TEXT_BYTES = 1 << 19  # of texts tokenised at a time
COMMON = 1 << 15  # id pairs that go to every task: those with over a 2^-15 of all pair rows, so there are no more of them
PAIRS = 1 << 20  # pairs expanded at a time
KNOWN = 1 << 18  # parts of texts whose ids a task remembers, of at most LONG characters each
LONG = 100
RUN = 20_000  # characters of a run without or of blanks from which on a text is encoded by merges
# Splits a text for byte-level tokenizers that use the usual pattern. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder(NamedTuple):
    """Ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    pieces: list[bytes]
    ranked: bool = False


def arrays(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[np.ndarray]]:
    return lambda texts: [np.asarray(ids, np.int32) for ids in encode(texts)]


def by_parts(encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], cut: str, outer: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes the different parts of the texts once. ``cut`` splits where no token can reach across.

    New parts but those that ``outer`` finds may stand between two cuts, so they are encoded as one text, whose ids are
    dealt by the parts' bytes.
    """
    split, alone, sizes = re.compile(cut).split, re.compile(outer).search, np.array([len(p) for p in pieces], np.int64)
    known: dict[str, bytes] = {}

    def learn(new: set[str]) -> None:
        inside = [p for p in new if not alone(p)]
        ids = np.asarray(encode(["".join(inside)])[0] if inside else [], np.int32)
        ends = np.cumsum(sizes[ids])
        want = np.fromiter(map(len, map(str.encode, inside)), np.int64, len(inside)).cumsum()
        at = np.minimum(np.searchsorted(ends, want), max(len(ends) - 1, 0))
        if inside and ends[-1] == want[-1] and (ends[at] == want).all():
            flat, stop = ids.tobytes(), ((at + 1) * 4).tolist()
            known.update(zip(inside, map(flat.__getitem__, map(slice, [0, *stop[:-1]], stop)), strict=True))
        rest = [p for p in new if p not in known]
        known.update(zip(rest, (x.tobytes() for x in arrays(encode)(rest)), strict=True))

    def run(texts: list[str]) -> list[np.ndarray]:
        if len(known) > KNOWN:
            known.clear()
        parts = list(map(split, texts))
        new = set().union(*parts).difference(known)
        learn(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]
        for p in [p for p in new if len(p) > LONG]:
            del known[p]
        return out

    return run


def byte_level(data: bytes, ranked: bool | None = None) -> Encoder:
    """A byte-level tokenizer from its JSON; strings of special tokens are plain text.

    ``ranked`` says whether its ranks give the ids of its merges; if it is not given, that is tried out here.

    Where its pattern splits words off first (``use_regex``), no match holds a blank behind a character that is none, and none
    looks back, so texts may be cut there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]  # bytes without a visible character stand from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pieces = [b""] * t.get_vocab_size()
    for piece, k in t.get_vocab().items():
        pieces[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    shape = json.loads(data)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    words = shape.get("normalizer") is None and plain.items() <= (shape.get("pre_tokenizer") or {}).items()
    encode = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if not words:
        return Encoder(arrays(encode), pieces)
    whole = by_parts(encode, pieces, r"(?<=\S)(?=[ \n])", r"^[^ \n]|\s\Z|\A\Z")
    fast = None if ranked is False else by_ranks(shape, pieces, None if ranked else encode)
    return Encoder(whole if fast is None else shared(fast, whole), pieces, fast is not None)


def by_ranks(shape: dict, pieces: list[bytes], merged: Callable[[list[str]], list[list[int]]] | None) -> Callable[[list[str]], list[np.ndarray]] | None:
    """The same ids from ranks instead of merges, or nothing where the JSON's merges do not make its ids so.

    Ids must rise with the merges, each of which makes a piece, and every piece that is a text must encode as by ``merged``.
    """
    import tiktoken

    model, special = shape["model"], {x["content"] for x in shape["added_tokens"]}
    ids = {p: k for p, k in model["vocab"].items() if p not in special}
    made = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    plain = not any(model.get(f) for f in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or len(made) + 256 != len(ids) or made != sorted(set(made)) or min(made, default=0) < 256:
        return None
    own = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={pieces[k]: k for k in ids.values()}, special_tokens={})
    texts = [] if merged is None else [p for p in (pieces[k].decode(errors="replace") for k in ids.values()) if "\ufffd" not in p]
    if merged is not None and list(map(own.encode_ordinary, texts)) != merged(texts):
        return None
    return arrays(lambda texts: list(map(own.encode_ordinary, texts)))


def shared(fast: Callable[[list[str]], list[np.ndarray]], slow: Callable[[list[str]], list[np.ndarray]]) -> Callable[[list[str]], list[np.ndarray]]:
    """``fast`` but for texts with a run of over ``RUN`` characters that are all blank or all not: its pattern backtracks there."""
    runs = re.compile(rf"(?<!\S)\S{{{RUN}}}|(?<!\s)\s{{{RUN}}}").search

    def run(texts: list[str]) -> list[np.ndarray]:
        heavy = [k for k, x in enumerate(texts) if len(x) >= RUN and runs(x)]
        out = dict(zip(heavy, slow([texts[k] for k in heavy]), strict=True)) if heavy else {}
        light = [k for k in range(len(texts)) if k not in out]
        out.update(zip(light, fast([texts[k] for k in light]), strict=True))
        return [out[k] for k in range(len(texts))]

    return run


def sentence_piece(data: bytes) -> Encoder:
    """A sentence-piece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace("▁", " ").encode() for k in range(m.get_piece_size())]
    return Encoder(arrays(lambda texts: m.encode(texts, num_threads=1)), pieces)


def labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the A token that ends its group; ends ascend, and both cover the same bytes.

    A token points to the farthest-right token that overlaps it: the one of the other side over its last byte, or itself
    if that one ends no later. Following pointers ends at the A token where both sides end together; doubling the
    pointers finds it in as many rounds as the logarithm of the longest chain.
    """
    n = len(end_a)
    over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)  # the other side's token over the last byte
    succ = np.concatenate([np.where(end_b[over_a] == end_a, np.arange(n), n + over_a), over_b])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ[:n], succ[n:]
        succ = further


class Alignment(NamedTuple):
    """Tokens of a run of texts: ids, text and group of each; groups count on over the texts."""

    ids: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # texts x (tokens of A, tokens of B, groups)


def align(texts: list[str | None], a: Encoder, b: Encoder, lengths: tuple[np.ndarray, np.ndarray]) -> Alignment:
    """Groups of every text. A reads a space and the text, B the text; texts whose bytes either changes have no tokens."""
    here = [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([" " + texts[k] for k in here]), b.encode([texts[k] for k in here])
    kept = []
    for k, x, y in zip(here, ids_a, ids_b, strict=True):
        whole = b" " + texts[k].encode()
        if b"".join(map(a.pieces.__getitem__, x.tolist())) == whole == b"".join(map(b.pieces.__getitem__, y.tolist())):
            kept.append((k, x, y))
    counts = np.zeros((len(texts), 3), np.int64)
    sides = []
    for s in (1, 2):
        rows = [r[s] for r in kept]
        ids = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        doc = np.repeat(np.asarray([r[0] for r in kept], np.int64), [len(r) for r in rows])
        sides.append((ids, doc, np.cumsum(lengths[s - 1][ids])))  # texts follow each other: each ends where both sides end
        counts[:, s - 1] = np.bincount(doc, minlength=len(texts))
    (x, doc_a, end_a), (y, doc_b, end_b) = sides
    if len(x) == 0:
        return Alignment((x, y), (doc_a, doc_b), (x, y), counts)
    to_a, to_b = labels(end_a, end_b)
    last = np.append(to_a[1:] != to_a[:-1], True)
    final, group_a = to_a[last], np.cumsum(last) - last
    counts[:, 2] = np.bincount(doc_a[final], minlength=len(texts))
    return Alignment((x, y), (doc_a, doc_b), (group_a, group_a[to_b]), counts)


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, with how often each occurs."""
    key, n = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def linked(found: Alignment, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) for each distinct id pair of a text: ``id of A * size of B + id of B``, and occurrence pairs in a group.

    Equal ids of a group are counted before they are paired, and pairs are summed in runs of groups, so that a long run
    of one character makes few of them.
    """
    (ga, ia, na), (gb, ib, nb) = (_counted(found.group[s], found.ids[s]) for s in (0, 1))
    doc = np.zeros(int(ga[-1]) + 1 if len(ga) else 0, np.int64)
    doc[found.group[0]] = found.doc[0]
    low, high = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    width = high - low
    edges, parts = [0], []
    total = np.cumsum(width)
    while edges[-1] < len(ga):
        done = total[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(total, done + PAIRS, "right"))))
    whole = sizes[0] * sizes[1]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        left = np.repeat(np.arange(s, e), width[s:e])
        right = np.arange(len(left)) - np.repeat(np.cumsum(width[s:e]) - width[s:e], width[s:e]) + low[left]
        parts.append(_summed(doc[ga[left]] * whole + ia[left] * sizes[1] + ib[right], na[left] * nb[right]))
    if len(parts) > 1:
        parts = [_summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
    key, n = parts[0] if parts else (doc, doc)
    return key // whole, key % whole, n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n, at)


def group_texts(found: Alignment, marked: list[str]) -> list[str]:
    """Groups of each text as ``a1,a2|b1;a3|b2,b3``: ids of A, then of B, in order. ``marked`` has each id with , | and ;"""
    side = np.repeat([0, 1], [len(found.group[0]), len(found.group[1])])
    group = np.concatenate(found.group)
    order = np.argsort(group * 2 + side, kind="stable")
    ids, doc = np.concatenate(found.ids)[order], np.concatenate(found.doc)[order]
    group, side = group[order], side[order]
    mark = np.full(len(ids), 2)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
    ends = np.searchsorted(doc, np.arange(len(found.counts) + 1)).tolist()
    parts = list(map(marked.__getitem__, (ids * 3 + mark).tolist()))
    return ["".join(parts[s:e])[:-1] for s, e in zip(ends[:-1], ends[1:], strict=True)]


ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"


def _aligner(a_data, b_data, ranked: bool, digests: bool):
    made: list = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            if not made:
                made.extend((byte_level(a_data.value, ranked), sentence_piece(b_data.value)))
                lengths = tuple(np.array([len(p) for p in x.pieces], np.int64) for x in made)
                sizes = tuple(map(len, lengths))
                marked = [f"{i}{m}" for i in range(max(sizes)) for m in ",|;"]
            found = align(batch.column("text").to_pylist(), *made, lengths)
            doc, pair, n = linked(found, sizes)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            total = np.bincount(doc, n, batch.num_rows).astype(np.int64)
            groups = group_texts(found, marked)
            if digests:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            counts = [pa.array(c, pa.int64()) for c in (*found.counts.T, total)]
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int64())) for v in (pair, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts, pa.array(groups, pa.string()), *lists],
                                             ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    return run


def token_groups(docs: DataFrame, a_data: bytes, b_data: bytes, digests: bool = False) -> DataFrame:
    """Alignment of each text: (row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links).

    ``a_data`` is a byte-level tokenizer's JSON, ``b_data`` a sentence-piece model; both are a few MB and are broadcast. ``groups``
    is ``a1,a2|b1;a3|b2``, or its SHA-256 with ``digests``; ``pairs`` holds the distinct linked id pairs as ``a * |B| + b``,
    ``links`` how often each is linked. Texts that are null, empty, or changed by a tokenizer have zeros and empty groups.
    """
    context = docs.sparkSession.sparkContext
    run = _aligner(context.broadcast(a_data), context.broadcast(b_data), byte_level(a_data).ranked, digests)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ROWS)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): texts that hold each pair linked, and whether no pair of the same id of A has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return materialise(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def _known(common):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the pairs that are common; the others go on."""
        key, count, best = common.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            pair, n = pairs.flatten().to_numpy(), links.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
            hit = key[at] == pair if len(key) else np.zeros(len(pair), bool)
            at, size = at[hit], batch.num_rows
            sums = [np.bincount(row[hit], w, size).astype(np.int64) for w in (n[hit] * best[at], n[hit] * count[at])] if len(key) else [np.zeros(size, np.int64)] * 2
            cut = pa.array(np.searchsorted(row[~hit], np.arange(size + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(cut, pa.array(v[~hit], pa.int64())) for v in (pair, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(v) for v in sums), *rest], [*batch.schema.names[:-2], "best", "total", "pairs", "links"])

    return run


def aligned_counts(docs: DataFrame, a_data: bytes, b_data: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    An id pair's count is the number of rows that hold it linked; ``n_best`` are the links whose count is the highest of
    their id of A, ties included, and ``count_sum`` sums the counts over the links. Repeated rows count each. Pairs that
    make up more than one of ``COMMON`` of all pair rows, of which there are at most as many, go to every task as a table;
    the rest, none of them frequent, is joined by pair. Null and empty texts and those that a tokenizer changes have
    zeros and an empty digest; a null id stays null; an empty table gives no rows.
    """
    size_b = len(sentence_piece(b_data).pieces)
    aligned = materialise(token_groups(docs, a_data, b_data, True), "aligned")
    counts = pair_counts(aligned, size_b)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * COMMON > rows).orderBy("pair").toArrow()
    table = [common.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")]
    kept = [f for f in ROWS.split(", ") if not f.endswith("array<long>")]
    shape = ", ".join([*kept, "best long, total long, pairs array<long>, links array<long>"])
    known = materialise(aligned.mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(table)), shape), "aligned-known")
    rest = known.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    rest = rest.join(counts.where(F.col("n") * COMMON <= rows), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more"))
    out = known.drop("pairs", "links").join(rest, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias({"best": "n_best", "total": "count_sum"}[c])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("best", "more_best"), more("total", "more"), F.col("groups").alias("groups_sha256"))
