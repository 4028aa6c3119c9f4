"""Token alignment against plain loops over byte offsets."""

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtide.llm import registry, tokenalign

FOLDER = "/opt/tokenizers"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tokenizer files not present")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def data():
    return [open(f"{FOLDER}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def tokens(text, a, b):
    """(id, start, end) of both sides by the libraries' own calls, or nothing where the bytes differ."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    sides = []
    for ids, piece in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: unbyte(a.id_to_token(k))), (b.encode(text), lambda k: unpiece(b.id_to_piece(k)))):
        at, side, joined = 0, [], b""
        for k in ids:
            p = piece(k)
            side.append((k, at, at + len(p)))
            at += len(p)
            joined += p
        if joined != whole:
            return [], []
        sides.append(side)
    return sides


def unbyte(s):
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, n = {}, 0
    for k in range(256):
        if k in keep:
            table[chr(k)] = k
        else:
            table[chr(256 + n)] = k
            n += 1
    return bytes(table[c] for c in s)


def unpiece(s):
    return bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") and s.endswith(">") else s.replace("▁", " ").encode()


def plain(rows, data):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(data[0].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=data[1])
    held, found = Counter(), []
    for doc_id, text in rows:
        sa, sb = tokens(text, a, b)
        ends = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, x, y = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while x < len(sa) and sa[x][2] <= end:
                ga.append(sa[x][0])
                x += 1
            while y < len(sb) and sb[y][2] <= end:
                gb.append(sb[y][0])
                y += 1
            groups.append((ga, gb))
        links = Counter()
        for ga, gb in groups:
            na, nb = Counter(ga), Counter(gb)
            for i in na:
                for j in nb:
                    links[i, j] += na[i] * nb[j]
        held.update(links.keys())
        found.append((doc_id, sa, sb, groups, links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, sa, sb, groups, links in found:
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, len(sa), len(sb), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(line.encode()).hexdigest() if sa else ""))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    parts = ["the", " ", "  ", "\n", "\t", "ing", "é", "漢字", "한", "😀", "👩‍👩‍👧", "Ünï", "=", "==", "----", "12", "3.14", "'s", "don't", "a", "A", " ", " ", "\x00", "\x7f", "ﬁ", "é",
             "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "http://x.y/z?q=1", "ſ", "\r\n", "العربية", "नमस्ते", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " ", "▁", "a▁b", "plain words here", "plain words here", " plain words here", "=" * 5000, "é" * 700, "ab" * 3000, " " * 999 + "x",
              "word " * 4000, "<|endoftext|><|endoftext|>", "﻿x"]
    return [(k if k % 31 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("common", [tokenalign.COMMON, 64, 1])
def test_counts(spark, rows, common, monkeypatch):
    """All pairs common, some of them, nearly none: the same result."""
    monkeypatch.setattr(tokenalign, "COMMON", common)
    files = data()
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).withColumns({"row": F.lit(5), "pairs": F.lit("p"), "best": F.lit(0)}).repartition(5)
    out = tokenalign.aligned_counts(docs, *files)
    assert tuple(out.columns) == NAMES
    got = sorted(map(tuple, out.collect()), key=str)
    want = plain(rows, files)
    assert got == want
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[1] > 0 for r in want) > 100
    assert tokenalign.aligned_counts(docs.where("false"), *files).count() == 0


def test_groups_of_texts(spark):
    """Without digests the groups themselves, which cover all tokens in order."""
    files = data()
    docs = spark.createDataFrame([(1, "hello wörld, tokenizers", None, None, None), (2, None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in tokenalign.token_groups(docs, *files).collect()}
    a, b = tokenalign.byte_level(files[0]), tokenalign.sentence_piece(files[1])
    sides = [[[int(k) for k in s.split(",")] for s in g.split("|")] for g in got[1].groups.split(";")]
    for x, y in sides:
        assert b"".join(a.pieces[k] for k in x) == b"".join(b.pieces[k] for k in y)
    assert b"".join(a.pieces[k] for x, _ in sides for k in x).decode() == " hello wörld, tokenizers"
    assert got[2].groups == "" and got[2].pairs == [] and got[1].n_groups == len(sides)


def test_labels_by_pointer_jumping():
    """Chains of any length end at the A token where both sides end."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2)]
        both = np.intersect1d(*cuts)
        got = tokenalign.labels(*cuts)
        for ends, label in zip(cuts, got, strict=True):
            want = both[np.searchsorted(both, ends)]
            assert (cuts[0][label] == want).all()
    a, b = np.arange(2, 20002, 2), np.append(np.arange(1, 20000, 2), 20000)  # one chain through all tokens
    assert set(tokenalign.labels(a, b)[0]) == {9999}


def test_pairs_in_runs(monkeypatch):
    """The expansion of pairs in small runs gives the same sums as at once."""
    a, b = (f(x) for f, x in zip((tokenalign.byte_level, tokenalign.sentence_piece), data(), strict=True))
    lengths = tuple(np.array([len(p) for p in x.pieces]) for x in (a, b))
    found = tokenalign.align(["漢字 x漢字" * 40, None, "=" * 400 + " word"], a, b, lengths)
    whole = [v.tolist() for v in tokenalign.linked(found, (50257, 32000))]
    monkeypatch.setattr(tokenalign, "PAIRS", 3)
    assert [v.tolist() for v in tokenalign.linked(found, (50257, 32000))] == whole


def test_query(spark, tmp_path):
    rows = [(k, f"text {k % 7} of words") for k in range(30)] + [(99, None)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, data())


@pytest.mark.parametrize("ranked", [None, False])
def test_parts_as_whole_texts(ranked):
    """Encoding by ranks, or the parts of texts by merges, gives the ids of the whole texts, whatever blanks stand between them."""
    from tokenizers import Tokenizer

    rng = random.Random(1)
    signs = [chr(c) for c in [*range(256), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2581, 0x301, 0x200D, 0x1F600, 0x4E00, 0x94D]]
    signs += [" "] * 60 + ["\n"] * 15 + ["'s", "the", "ing", " <|endoftext|>"] * 5
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(6000)]
    t = Tokenizer.from_str(data()[0].decode())
    t.encode_special_tokens = True
    made = tokenalign.byte_level(data()[0], ranked)
    assert made.ranked is (ranked is None)
    encode = made.encode
    for part in (texts[:3000], texts[3000:], texts[2000:4000]):
        assert [x.tolist() for x in encode([" " + x for x in part])] == [e.ids for e in t.encode_batch([" " + x for x in part], add_special_tokens=False)]


def test_ranks_over_characters_and_long_runs(monkeypatch):
    """Ranks give the merges' ids for characters of all planes; texts with long runs go by merges; other merges refuse ranks."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data()[0].decode())
    t.encode_special_tokens = True
    made = tokenalign.byte_level(data()[0])
    chars = [chr(c) for c in [*range(0x3400), *range(0x3400, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1{c} \n{c} x" for c in chars[k : k + 256]) for k in range(0, len(chars), 256)]
    assert [x.tolist() for x in made.encode(texts)] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokenalign, "RUN", 50)
    made = tokenalign.byte_level(data()[0])
    runs = ["", "b" * 49, "b" * 50 + " c", " " * 80 + "d", "x " * 60]
    assert [x.tolist() for x in made.encode(runs)] == [t.encode(x, add_special_tokens=False).ids for x in runs]
    shape = json.loads(data()[0])
    shape["model"]["merges"].reverse()
    assert not tokenalign.byte_level(json.dumps(shape).encode()).ranked
