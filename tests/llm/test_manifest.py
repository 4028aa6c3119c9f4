"""The manifest against trees built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from adtide.llm import manifest, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def way(levels, k):
    """(sibling, on the left) of each level; None for a lone node."""
    out = []
    for level in levels[:-1]:
        j = k ^ 1
        out.append((level[j], j < k) if j < len(level) else (None, False))
        k >>= 1
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    trees = {g: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    names = sorted(trees, key=lambda g: g.encode())
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for g, v in groups.items():
        for k, (_, _, good, r) in enumerate(sorted(v, key=lambda x: x[:3])):
            path = way(trees[g], k) + way(top, names.index(g))
            struck = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1) if struck else good
            for s, left in path:
                node = h(node) if s is None else h(s, node) if left else h(node, s)
            out.append((r[0], good, trees[g][-1][0], top[-1][0], h(*[s for s, _ in path if s]), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    sizes = {"en": 700, "de": 257, "fr": 256, None: 65, "é": 3, "": 2, "zz": 1, "Ab": 1}
    out, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            text = rng.choice(["", None, "same", f"text {k}", "é" * 50])
            out.append((k * 3 - 900, text, lang, rng.choice(["a", None, "ü", "-"]), rng.choice([None, len(text or ""), -5])))
    out += [out[0]] * 40 + [(None, "no id", "en", "a", 5), (None, None, "en", None, None), (7, "x", "de", "s", 1), (7, "y", "de", "s", 1)]
    out.append((10**9, "long " * 300_000, "en", "a", 9))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bits", [manifest.BITS, 2])
def test_proofs(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(manifest, "BITS", bits)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"hash": F.lit(1), "grp": F.lit("x"), "row": F.lit(0), "pos": F.lit(0)}).repartition(7)
    got = manifest.tampered_proofs(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("bits", [manifest.BITS, 2])
def test_log_is_in_order_of_completion(spark, bits, monkeypatch):
    """Every node once, at the place where a builder that takes the leaves one by one completes it."""
    monkeypatch.setattr(manifest, "BITS", bits)
    sizes = (1, 2, 3, 4, 5, 16, 17, 31, 100)
    rows = [(k, f"t{k}", str(n), None, None) for n in sizes for k in range(n)]
    book = manifest.Manifest(spark.createDataFrame(rows, DOCS), manifest.record_digest({c: F.col(c) for c in manifest.FIELDS}))
    got = {}
    for r in book.log().collect():
        got.setdefault(r.grp, {})[r.position] = r.hash
    for n in sizes:
        levels = tree([leaf(*r) for r in rows if r[2] == str(n)])
        want, made = [], [0] * len(levels)
        for k in range(n):
            for lv, nodes in enumerate(levels):
                if lv and not ((k + 1) % (1 << lv) == 0 or k == n - 1):
                    break
                want.append(nodes[made[lv]])
                made[lv] += 1
        assert got[f"={n}"] == dict(enumerate(want))


def test_positions():
    for n in range(1, 70):
        places = sorted(manifest.position(lv, k, n) for lv in range(manifest.height(n) + 1) for k in range(-(-n >> lv)))
        assert places == list(range(len(places)))


def test_empty_and_one(spark):
    none = spark.createDataFrame([], DOCS)
    assert manifest.tampered_proofs(none).count() == 0
    one = [(7, None, None, None, None)]
    got = list(map(tuple, manifest.tampered_proofs(spark.createDataFrame(one, DOCS)).collect()))
    assert got == plain(one) and got[0][4] == h()


def test_query(spark, tmp_path):
    rows = [(k, f"text {k}", ("en", None)[k % 2], "s", k) for k in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str) == plain(rows)
