"""Language ID with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from adtide.llm.words import chunks, mix

DIM = 1024
UND = "und"
MAX_LANGS = 10_000
CHUNK = 1 << 20
GROUP = 256  # documents whose dense count rows stand side by side
_DENSE = 1 << 22  # direct-address table up to this many possible n-grams, sorting beyond
_U = np.uint64


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """A row of +1/-1 for each code point (0 stands for a word boundary), a pure function of the code point."""
    words = -(-dim // 64)
    bits = mix(letters.astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=_U)[None, :] * _U(0xD1B54A32D192ED03))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :dim].astype(np.int8) * 2 - 1


class _Letters:
    """Code point to folded letter, 0 for what is no letter; filled as characters are met."""

    def __init__(self) -> None:
        self.known = np.full(0x110000, -1, np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        got = self.known[codes]
        if (got < 0).any():
            for c in np.unique(codes[got < 0]).tolist():
                self.known[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
            got = self.known[codes]
        return got


def _trigrams(texts: list[str], letters: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index and dense n-gram id of each letter trigram, and the three letters of each n-gram."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    seq = letters.of(codes)
    breaks = np.concatenate([[0], np.cumsum(lens + 1)])
    edge = np.zeros(len(seq), bool)
    edge[breaks] = True
    keep = (seq > 0) | edge
    keep[1:] |= seq[:-1] > 0
    doc = np.repeat(np.arange(len(texts) + 1), np.concatenate([[1], lens + 1]))[keep]
    seq, edge = seq[keep], edge[keep]
    used = np.flatnonzero(np.bincount(seq, minlength=1))
    used = used if len(used) and used[0] == 0 else np.concatenate([[0], used])
    small = np.zeros(used[-1] + 1, np.int32)
    small[used] = np.arange(len(used))
    s, n = small[seq].astype(np.int64), len(used)
    a, b, c = s[:-2], s[1:-1], s[2:]
    ok = ~edge[1:-1] & ~((a == 0) & (b == 0)) & ~((b == 0) & (c == 0))
    key, doc = ((a * n + b) * n + c)[ok], doc[1:-1][ok] - 1
    if n**3 <= _DENSE:
        hit = np.zeros(n**3, bool)
        hit[key] = True
        grams = np.flatnonzero(hit)
        at = np.zeros(n**3, np.int32)
        at[grams] = np.arange(len(grams))
        ids = at[key]
    else:
        grams, ids = np.unique(key, return_inverse=True)
    return doc, ids, np.stack([used[grams // (n * n)], used[grams // n % n], used[grams % n]])


def profiles(texts: list[str], dim: int, letters: _Letters) -> np.ndarray:
    """The hypervector of each text: the sum over its letter trigrams of rolled letter vectors multiplied together."""
    out = np.zeros((len(texts), dim), np.float32)
    doc, ids, grams = _trigrams(texts, letters)
    n = grams.shape[1]
    if not n:
        return out
    pool, where = np.unique(grams, return_inverse=True)
    vec, where = letter_vectors(pool, dim), where.reshape(grams.shape)
    items = (np.roll(vec, 2, 1)[where[0]] * np.roll(vec, 1, 1)[where[1]] * vec[where[2]]).astype(np.float32)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for at in range(0, len(texts), GROUP):
        to = min(at + GROUP, len(texts))
        part = slice(first[at], first[to])
        if part.stop > part.start:
            grid = np.bincount((doc[part] - at) * n + ids[part], minlength=(to - at) * n).reshape(to - at, n)
            out[at:to] = grid.astype(np.float32) @ items
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fit_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Language prototypes: the sum of the unit hypervectors of all texts of a language.

    Each task adds up its own documents, in whole numbers so that the order of addition is without effect; a language
    then takes ``dim`` sums, which are all that reaches the driver (at most 10,000 languages, or an error). Null languages
    and texts without letters teach nothing.
    """

    def add(batches):
        letters, sums = _Letters(), {}
        for batch in chunks(batches, "text", CHUNK):
            unit = np.rint(_unit(profiles(_texts(batch, "text"), dim, letters)) * (1 << 20)).astype(np.int64)
            langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + unit[langs == lang].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "v": pa.array([total], pa.list_(pa.int64()))})

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = (rows.mapInArrow(add, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
             .groupBy("lang", "i").agg(F.sum("x").alias("x")).limit(MAX_LANGS * dim + 1).collect())
    if len(found) > MAX_LANGS * dim:
        raise ValueError(f"more than {MAX_LANGS} languages")
    out: dict[str, np.ndarray] = {}
    for lang, i, x in found:
        out.setdefault(lang, np.zeros(dim))[i] = x
    return {k: _unit(out[k]) for k in sorted(out) if out[k].any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """The rows of ``docs`` with lang_pred and lang_score.

    The prediction is the language whose prototype has the largest cosine with the text's hypervector, ties to the
    smaller name; the score is (1 + cosine) / 2. A null or empty text, one without a letter, and any text where no
    language was learned give ``und`` and 0. Each row is judged by itself, so repeated rows agree; other columns pass through
    (existing columns lang_pred and lang_score are replaced).
    """
    names = list(prototypes)
    table = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), dim).T
    docs = docs.drop("lang_pred", "lang_score")

    def predict(batches):
        letters = _Letters()
        for batch in chunks(batches, text_col, CHUNK):
            vec = profiles(_texts(batch, text_col), dim, letters)
            some = vec.any(1) & bool(names)
            pred, score = np.full(len(vec), UND, object), np.zeros(len(vec))
            if some.any():
                cos = np.round(_unit(vec[some].astype(np.float64)) @ table, 9)
                best = cos.argmax(1)
                pred[some] = np.array(names, object)[best]
                score[some] = np.clip((1 + cos[np.arange(len(cos)), best]) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of at least ``least``; see ``identify``."""
    kept = identify(docs, prototypes, text_col)
    return kept.where((F.col("lang_pred") != UND) & (F.col("lang_score") >= least)).select(docs.columns)
