"""Each operator against a plain version on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adtide.llm import decontaminate, fixity, jaccard, kdtree, language, mixing, redaction, sharding
from adtide.llm.automaton import SuffixAutomaton, drop_repeated_passages
from adtide.llm.components import components
from adtide.llm.suffixes import SuffixLevels, drop_repeated_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: unique ones, copies, near copies, shared passages, blanks, empties, nulls."""
    rng = random.Random(3)
    shared, long = sentence(rng, 60), sentence(rng, 3000, 5000)
    out = [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    out += [sentence(rng, 30) + " " + shared + " " + sentence(rng, k) for k in (0, 5, 40)]
    out += [long, long + " end", long, "", None, "   ", "one", "one", "One", "a b c", BLANKS.join(["x", "y", "z"]), "é " * 30]
    base = sentence(rng, 150).split()
    for k in range(12):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = f"edit{k}"
        out.append(" ".join(copy))
    out.append(" ".join(["again"] * 70))
    out.append(shared + "\n" + shared)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("row", F.lit("x")).withColumn("size", F.lit(0)).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# --- n-gram Jaccard join ---------------------------------------------------------------------------
def classes(texts):
    sets = {}
    for i, t in texts:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    home = {i: i for i in sets}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 300])
def test_jaccard_classes(docs, texts, block):
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_classes(docs, block=block).collect()}
    assert got == classes(texts)


def test_jaccard_salted_postings(spark, docs, texts, monkeypatch):
    real = jaccard._postings
    monkeypatch.setattr(jaccard, "_postings", lambda reps, sketch, often: real(reps, sketch, 1.0))
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == classes(texts)


def test_jaccard_rows_of_a_block(spark):
    """Short near copies: few shingles, so only the row limit bounds the overlap matrix of two blocks."""
    base = sentence(random.Random(9), 30).split()
    rows = [(i, " ".join([*base[: 30 - i % 4], f"end{i}"]), None, None, None) for i in range(6000)]
    rows.append((9000, sentence(random.Random(10), 30), None, None, None))
    df = spark.createDataFrame(rows, DOCS)
    reps = df.select(F.col("doc_id").alias("id"), "text").mapInArrow(jaccard._packed, "id long, key binary, n long, packed binary").persist()
    near = reps.where("id < 9000").select("id", F.lit(0).cast("long").alias("cluster"))
    pairs = jaccard._block_pairs(reps, near, jaccard.BLOCK_SHINGLES).select("id", "own", F.explode("pairs").alias("p"))
    pairs = pairs.select("id", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j")).collect()
    size = {}
    for r in pairs:
        size[r.i, r.j] = size.get((r.i, r.j), 0) + 1
    assert max(size.values()) ** 2 <= 1.2 * jaccard.PAIR_LIMIT
    held = {r.id: set() for r in pairs}
    for r in pairs:
        held[r.id].add((r.i, r.j))
    assert len(held) == 6000 and all(held[0] & held[k] for k in held)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(df).collect()}
    assert got == {**dict.fromkeys(range(6000), 0), 9000: 9000}


@pytest.mark.parametrize("tile", [5, jaccard.TILE_ROWS])
def test_jaccard_block_links(tile):
    """Chains by exact counts and tiles lose no link, and boilerplate that all rows share does not hold a block together."""
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, rng.integers(4, 60)).astype(np.uint64)
        for _ in range(rng.integers(1, 30)):
            s = base.copy()
            k = rng.integers(0, len(s) // 5 + 1)
            s[rng.permutation(len(s))[:k]] = rng.integers(0, 300, k).astype(np.uint64)
            sets.append(np.unique(s))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    label = lambda found: jaccard._merged(np.arange(len(sets)), *np.array(found).T).tolist()
    assert len(set(label(links))) > 10 and label(jaccard._block_links(sets, tile)) == label(links)
    common = np.arange(20, dtype=np.uint64)
    apart = [np.concatenate([common, rng.integers(1 << 40, 2**63, 80).astype(np.uint64)]) for _ in range(100)]
    assert jaccard._chained(apart, np.array([100] * 100)) == []


def test_jaccard_candidates_meet_the_bound_of_positions(spark):
    """A shared rare shingle that stands too far up in one set links nothing; of sets that link, none is lost."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(1 << 40)}"
    common = [word() for _ in range(9)]
    rows = [(i, " ".join([*[word() for _ in range(60)], *common, *[word() for _ in range(60)]])) for i in range(3)]
    for k in range(40):
        base = [word() for _ in range(60)]
        rows += [(100 + 10 * k + j, " ".join(base[: 60 - rng.integers(0, 9)] + [word() for _ in range(rng.integers(0, 5))])) for j in range(2 + k % 6)]
    df = spark.createDataFrame(rows, "id long, text string")
    reps = df.mapInArrow(jaccard._packed, "id long, key binary, n long, packed binary").persist()
    found = jaccard._candidate_links(jaccard._postings(reps, jaccard._frequency(reps), 64.0)).distinct().collect()
    assert not [r for r in found if max(r) < 100]
    want = classes(rows)
    near = {r.id: r.component for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert sum(c != i for i, (_, c) in want.items()) > 20
    assert all(near[i] == near[c] for i, (_, c) in want.items() if c != i)
    late, soon = 16 * 7 + 10, 16 * 9  # steps of 1/56 in the last bits
    post = [(late, -1, 0, 1, 100), (late, -1, 0, 2, 100), (soon + 10, -1, 0, 3, 100), (soon + 2, -1, 0, 4, 80)]
    post += [(16 * 5 + 9, -1, 0, k, 100) for k in range(10, 18)]
    post = spark.createDataFrame(post, "token long, cls short, salt short, id long, n long")
    assert [tuple(r) for r in jaccard._candidate_links(post).collect()] == [(3, 4)]


def test_jaccard_bitmaps_lose_no_link():
    """Sets differ in at least as many shingles as their bitmaps in bits, also bitmaps of unlike length."""
    rng = np.random.default_rng(2)
    for n in (1, 3, 60, 63, 64, 65, 130, 900, 9000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for m in {n, n - n // 7, n - n // 4}:
            b, c = a[n - m :], rng.integers(0, 2**63, m).astype(np.uint64)
            rows = [(1, 2, n, m, jaccard._parity(a), jaccard._parity(b)), (1, 3, n, m, jaccard._parity(a), jaccard._parity(c)), (1, 4, n, m, None, b"\1")]
            got = [x for batch in jaccard._differ_little([pa.RecordBatch.from_pylist([dict(zip("abnmxy", r)) for r in rows])]) for x in batch.column(1).to_pylist()]
            assert 2 in got and 4 in got and (3 not in got or n < 60)


def test_jaccard_pairs_by_chance_make_no_cluster(spark, monkeypatch):
    """Texts that share a phrase two by two, far up in the order, are no chain; near copies, ids of several texts and long lists stay."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{rng.integers(1 << 40)}" for _ in range(200))
    near = text()
    rows = [(i, text()) for i in range(50)] + [(60, near), (61, near + " end"), (70, text()), (70, text()), (71, text())]
    reps = spark.createDataFrame(rows, "id long, text string").mapInArrow(jaccard._sets, "id long, key binary, n long, bits binary, packed binary").persist()
    pairs = [(i, i + 1) for i in range(49)] + [(60, 61), (70, 71)]
    post = [(16 * (100 + k), -1, 0, i, 196) for k, pair in enumerate(pairs) for i in pair] + [(16 * 9, -1, 0, i, 196) for i in range(100, 101 + jaccard.FEW)]
    monkeypatch.setattr(jaccard, "_postings", lambda *_: spark.createDataFrame(post, "token long, cls short, salt short, id long, n long"))
    got = {r.id: r.cluster for r in jaccard._clusters(reps, jaccard.BLOCK_SHINGLES).collect()}
    assert got == {60: 60, 61: 60, 70: 70, 71: 70, **dict.fromkeys(range(100, 101 + jaccard.FEW), 100)}


def test_pipeline_near_duplicates_with_a_full_sketch(spark, docs, texts, monkeypatch):
    """As on a far larger table, the sketch tells no shingle apart: no class changes, and texts without a copy are not dealt to blocks."""
    import corpus_pipeline

    dealt, real = [], jaccard._block_pairs
    monkeypatch.setattr(jaccard, "CELLS", 1024)
    monkeypatch.setattr(jaccard, "_block_pairs", lambda reps, near, block: dealt.append(near) or real(reps, near, block))
    rows = [(9000 + i, f"{sentence(random.Random(500 + i), 40)} said it {i // 2} times in all {sentence(random.Random(900 + i), 40)}", "en", "x", 9) for i in range(60)]
    both = docs.unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    kept = corpus_pipeline.near_duplicates(spark, both, "")
    want = classes([*texts, *[r[:2] for r in rows]])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    linked = {c for i, (_, c) in want.items() if c != i}
    assert not {r.id for r in dealt[0].collect() if r.id >= 9000} - {i for i, (_, c) in want.items() if c in linked}


def test_jaccard_texts_outside_clusters_are_not_shuffled(spark):
    ids = spark.range(0, 3000, 100)
    kept = jaccard._marked(spark.range(3000).select("id", F.lit(b"x").alias("packed")), ids)
    got = {r.id for r in kept.collect()}
    assert kept.columns == ["id", "packed"] and set(range(0, 3000, 100)) <= got and len(got) < 40


def test_components_of_links_spread_over_tasks(spark, monkeypatch):
    """Ids that meet in many tasks keep few links each after the second replacement."""
    from adtide.llm import components as module

    edges, real = [], module._written
    monkeypatch.setattr(module, "_written", lambda links, name: edges.append(real(links, name)) or edges[-1])
    rng = random.Random(3)
    links = [(g * 50 + rng.randrange(50), g * 50 + rng.randrange(50)) for g in range(40) for _ in range(2000)]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(40)).collect()
    assert {(r.id, r.component) for r in got} == {(i, i // 50 * 50) for i in range(2000)}
    assert edges[0][1][0] > module.MANY and edges[1][1][0] <= module.SPREAD * 2000


def test_jaccard_edges(spark, docs, empty, texts):
    assert jaccard.jaccard_classes(empty).count() == 0
    odd = spark.createDataFrame([(None, "one two three", None, None, None), (5, "one two three", None, None, None), (5, "one two three", None, None, None)], DOCS)
    assert sorted(map(str, map(tuple, jaccard.jaccard_classes(odd).collect()))) == ["(5, 1, 5)", "(5, 1, 5)", "(None, 1, None)"]
    kept = jaccard.one_of_each(docs)
    want = {i for i, (_, c) in classes(texts).items() if c == i}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components_of_a_path_in_few_rounds(spark, monkeypatch):
    """A path in one task is a star before the first round, so the rounds do not follow its length."""
    from adtide.llm import components as module

    written, real = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(name) or real(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").coalesce(1)
    assert {r[1] for r in components(links).collect()} == {0} and len(written) <= 3


def test_jaccard_sketch_is_packed(spark, texts):
    """The driver holds the sketch of all shingles only as it is sent to the tasks."""
    df = spark.createDataFrame([(t,) for _, t in texts if t], "text string").select(F.lit(1).alias("id"), "text")
    packed = df.mapInArrow(jaccard._packed, "id int, key binary, n long, packed binary")
    sketch = jaccard._frequency(packed)
    assert len(sketch) < jaccard.CELLS and int(jaccard._cells(sketch).sum()) == packed.agg(F.sum("n")).first()[0]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (7, None)] + [(k, k + 1) for k in range(100, 160)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 100 for k in range(100, 161)}}


# --- substring deduplication -----------------------------------------------------------------------
def passages(texts, size):
    seen, out = set(), {}
    for i, t in sorted(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            if k in seen:
                gone[s : s + size] = [True] * size
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("most", "shard"), [(20_000, 4 << 20), (2, 100)])
def test_passages(docs, texts, most, shard):
    got = {r[0]: (r[1], r[2], bytes(r[3])) for r in drop_repeated_passages(docs, shard_bytes=shard, most_segments=most).collect()}
    assert got == passages(texts, 20)


def repeated_bytes(texts, size):
    count, out = {}, {}
    for _, t in texts:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            count[b[s : s + size]] = count.get(b[s : s + size], 0) + 1
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = True
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), int(gone.sum()), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("most", "shard"), [(20_000, 16 << 20), (2, 100)])
def test_bytes(docs, texts, most, shard):
    got = {r[0]: (*r[1:4], bytes(r[4])) for r in drop_repeated_bytes(docs, shard_bytes=shard, most_segments=most).collect()}
    assert got == repeated_bytes(texts, 400)


def test_dedup_edges(spark, empty):
    assert drop_repeated_passages(empty).count() == 0 and drop_repeated_bytes(empty).count() == 0
    text = " ".join(f"k{i}" for i in range(200))
    odd = spark.createDataFrame([(None, text, None, None, None), (3, text, None, None, None), (3, text, None, None, None)], DOCS)
    assert sorted((str(r[0]), r[2]) for r in drop_repeated_passages(odd).collect()) == [("3", 0), ("3", 0), ("None", 200)]
    assert {r[2] for r in drop_repeated_bytes(odd).collect()} == {len(text)}


def test_automaton_places():
    rng = random.Random(1)
    for _ in range(30):
        parts = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(6)]
        a = SuffixAutomaton()
        for d, p in enumerate(parts):
            a.add(p, (d, 0))
        a.close()
        for p in parts:
            for end, size, place in a.matches(p, 2):
                assert size == end + 1
                assert place == min((d, k + 1) for d, q in enumerate(parts) for k in range(len(q) - 1) if q[k : k + 2] == p[end - 1 : end + 1])


def test_levels_find_every_match():
    rng = random.Random(2)
    for _ in range(20):
        rows = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(25)]
        rows = [r[:12] + b"XYZ" + r[15:] for r in rows]
        index = SuffixLevels(3, 10)
        for at in range(0, len(rows), 4):
            index.add([(r[12:], r[:12][::-1], at + i) for i, r in enumerate(rows[at : at + 4])])
        index.close()
        for i, r in enumerate(rows):
            got = {o for low, high in index.found.get(i, ()) for o in range(max(0, low), high + 1)}
            want = {o for o in range(13) if 12 - o + 10 <= 30 and 10 - o >= 3 and any(j != i and q[12 - o : 22 - o] == r[12 - o : 22 - o] for j, q in enumerate(rows))}
            assert want == {o for o in got if o <= 7}


# --- language --------------------------------------------------------------------------------------
def plain_profile(text, dim):
    seq, last = [0], 0
    for c in text or "":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or last:
            seq.append(x)
        last = x
    if last:
        seq.append(0)
    v = np.zeros(dim)
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        if (a or b) and (b or c):
            la, lb, lc = language.letter_vectors(np.array([a, b, c]), dim).astype(int)
            v += np.roll(la, 2) * np.roll(lb, 1) * lc
    return v


def test_profiles():
    texts = ["Hello world", "", "a", "..", "Straße, café!", "x y", None, "日本語 テキスト", "İx", "aa  bb\ncc"]
    got = language.profiles([t or "" for t in texts], 128, language._Letters())
    assert np.array_equal(got, np.array([plain_profile(t, 128) for t in texts]))


def test_language(spark, empty):
    en, de = "the cat and the dog went with them to that house", "der hund und die katze gingen nicht durch das haus"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", None, None) for i in range(20)]
    rows += [(100, None, "en", None, None), (101, "12 34", "en", None, None), (102, "that dog", None, None, None), (102, "that dog", None, None, None), (None, "die katze und", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("?"))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(df, language.fit_prototypes(df)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en" and got[None][0] == "de"
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0.9 < got[i][1] <= 1 for i in range(20))
    assert {r.lang_pred for r in language.identify(df, language.fit_prototypes(empty)).collect()} == {"und"}
    assert language.identify(empty, {}).count() == 0
    kept = language.recognised(df.drop("lang_pred"), language.fit_prototypes(df), 0.52)
    assert kept.columns == df.drop("lang_pred").columns and kept.count() == len(rows) - 2


# --- top-k -----------------------------------------------------------------------------------------
@pytest.mark.parametrize(("rows", "block"), [(kdtree.SHARD_ROWS, kdtree.QUERY_BLOCK), (40, 3)])
def test_top_k(spark, rows, block):
    rng = np.random.default_rng(0)
    vec = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vec += [(1000 + i, vec[0][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0])]
    vec += [(7, vec[7][1]), (None, vec[3][1])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = {}
    for q, r, i, s in kdtree.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=rows, query_block=block).collect():
        got.setdefault(q, {})[r] = (s, i)
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vec if i is not None and i < 2000}
    want = {}
    for q in good:
        if q % 10 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
            want[q] = {k + 1: (-s, i) for k, (s, i) in enumerate(best)}
    assert got == want
    assert kdtree.top_k(df.where("false"), F.lit(True)).count() == 0
    assert kdtree.top_k(df.where("vec_id = 5"), F.lit(True)).count() == 0


def test_top_k_writes_no_row_for_each_query_and_shard(spark, monkeypatch):
    """Tight groups of vectors: a query visits its own shard and few others, and that is all that is written."""
    rng, rows = np.random.default_rng(1), []
    for g in range(32):
        centre = rng.normal(size=8)
        rows += [(g * 64 + i, [float(x) for x in 5 * centre / np.linalg.norm(centre) + rng.normal(size=8) / 100]) for i in range(64)]
    df, written, real = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {}, kdtree.materialise

    def counted(table, name):
        out = real(table, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(kdtree, "materialise", counted)
    got = kdtree.top_k(df, F.col("vec_id") % 2 == 0, shard_rows=16, query_block=100)
    assert got.count() == 5 * 1024 and max(written.values()) < 1024 * (2048 // 16) / 2, written


# --- mixing ----------------------------------------------------------------------------------------
def test_targets():
    got = mixing.targets({"b": 100, "a": 100, None: 10, "c": 0}, (1, 2, 3), 3)
    assert got["c"] == 0 and got[None] == 30
    assert abs(sum(got.values()) - 210) < 1e-6 and all(got[s] <= 3 * n for s, n in {"a": 100, "b": 100, None: 10, "c": 0}.items())


def test_route_is_cheapest():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 15, "b": 15}, 3)
    assert sum(f for (_, s), f in flow.items() if s == "a") == 15 and sum(f for (_, s), f in flow.items() if s == "b") == 15
    used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in {p for p, _ in flow}}
    cost = lambda n, f: sum(e * min(n, max(0, f - (e - 1) * n)) for e in (1, 2, 3))
    assert sum(cost({("a",): 10, ("a", "b"): 10, ("b",): 4}[p], f) for p, f in used.items()) == 24 + 2 * 6


def test_mix(spark, empty):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(0, 30)), None, ("a", "b", None, "c")[min(3, rng.randrange(5))], None) for i in range(400)]
    rows += [(400, None, None, "a", None), (3, rows[3][1], None, rows[3][3], None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("pattern", F.lit(0)).withColumn("size", F.lit(0)).repartition(4)
    out, sources = mixing.mix_sources(df)
    taken = {}
    for r in out.collect():
        assert r["size"] * r.repeats == r.taken and 0 <= r.taken <= 3 * r["size"]
        taken[r.pattern] = taken.get(r.pattern, 0) + r.taken
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = mixing.targets(size, (1, 2, 3), 3)
    for r in sources.collect():
        assert r["size"] == size[r.source] and r.target == want[r.source]
        assert abs(taken['["' + r.source + '"]' if r.source else "[null]"] - r.target) <= 60
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(7))[0].collect()}
    assert again == {(r.doc_id, r.taken) for r in out.collect()}
    assert mixing.mix_sources(empty)[0].count() == 0
    assert mixing.mixed(df).count() == sum(r.repeats for r in out.collect())
    many = df.withColumn("sources", F.array("source", F.lit("all")))
    assert mixing.mix_sources(many, sources=F.col("sources"))[0].count() == len(rows)


# --- personal data ---------------------------------------------------------------------------------
PII = [
    "mail a.b+c@x-y.example.com, x@y.z..q a@b.c_d@e.f .@a..b a@.b a@b", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0004 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112 4111  1111 1111 1111 79927398713", "tel +1 (377) 555-0271 +44 20 7946 0958. +1 23 +12345678901234567",
    "ü@a.b é+49 (0)30 1234567é 4111111111111111é", "x" * 2000, "1 2" * 3000, "a.b." * 2000 + "@c.d", "9" * 5000, "+" * 500 + "1", None, "", "@", "x@" * 300 + "a.b",
    "a@b" + ".c" * 3000, "1 " * 4000, "call (377) 555-0271 now", "a@b.c a@b.c",
]


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return ",".join(f"{redaction.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_personal_spans(spark, empty):
    rng = random.Random(9)
    noise = ["".join(rng.choice("0123456789 .-+()@ab") for _ in range(60)) for _ in range(300)]
    rows = [(i, t, None, None, None) for i, t in enumerate(PII + noise)] + [(0, PII[0], None, None, None), (None, PII[1], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("base", F.lit(0)).withColumn("email", F.lit(0)).withColumn("id", F.lit(0))
    got = redaction.personal_spans(df).select("doc_id", redaction.span_digest(F.col("base")), redaction.span_digest(F.concat("base", "added")), "added").collect()
    assert len(got) == len(rows)
    for i, base, every, added in got:
        assert base == base_spans((PII[1] if i is None else (PII + noise)[i]) or "")
        assert set(filter(None, base.split(","))) <= set(every.split(","))
        for s in added:
            assert all(s.end <= int(x.split(":")[1]) or s.start >= int(x.split(":")[2]) for x in filter(None, base.split(",")))
    assert redaction.personal_spans(empty).count() == 0


def test_threshold():
    assert redaction._threshold([(0.9, 1), (0.8, 1), (0.5, 0), (0.5, 1), (0.1, 0)], 0.75) == 0.5
    assert redaction._threshold([(0.9, 0)], 0.9) is None and redaction._threshold([], 0.9) is None


def test_least_score(spark):
    """The threshold of a table is that of its rows; no row is left out."""
    rng = random.Random(11)
    for share in (0.5, 0.9, 1.0):
        rows = [(round(rng.random(), 3), int(rng.random() < share)) for _ in range(3000)] + [(1.0, 1), (0.0, 0)]
        got = redaction._least_score(spark.createDataFrame(rows, "score double, label int"), 0.9)
        assert got == redaction._threshold(rows, 0.9)
    assert redaction._least_score(spark.createDataFrame([(0.9, 0)], "score double, label int"), 0.9) is None


# --- decontamination -------------------------------------------------------------------------------
def test_contaminated(spark, empty):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(15, 60), 3000)) for i in range(12)] + [(90, None), (91, ""), (92, "Short item.")]
    items.append((93, items[0][1]))
    rows = [(i, sentence(rng, rng.randrange(20, 300), 3000), None, None, None) for i in range(200)]
    lead, tail = sentence(rng, 40, 3000), sentence(rng, 90, 3000)
    rows[5] = (5, f"{lead} {items[3][1].upper()}. {tail}", None, None, None)
    para = items[4][1].split()
    para[3] = "other"
    rows[6] = (6, f"{lead} {' '.join(para)}, {tail}", None, None, None)
    rows[7] = (7, items[0][1], None, None, None)
    rows += [(300, None, None, None, None), (301, "", None, None, None), (7, items[0][1], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(0)).withColumn("position", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(5, 3), (6, 4), (7, 0), (7, 0), (7, 93), (7, 93)]
    clean = decontaminate.clean_of(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in (5, 6, 7))
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.clean_of(df, bench.where("false")).count() == len(rows)


def test_contaminated_long_items(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, n, 6000)) for i, n in enumerate((40, 72, 150, 200, 300, 300, 700))]
    noise = [(100 + i, sentence(rng, 200, 6000), None, None, None) for i in range(300)]
    rows = [(i, f"{sentence(rng, 50, 6000)} {t} {sentence(rng, 50, 6000)}", None, None, None) for i, t in items] + noise
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.common == r.item_words) for r in got) == [(i, i, True) for i, _ in items]


def test_contaminated_paraphrases(spark):
    """Items with words dropped at random, against the subsequence rule on every document and item."""
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randrange(15, 60), 4000)) for i in range(60)]
    rows = [(500 + i, sentence(rng, 250, 4000), None, None, None) for i in range(120)]
    for keep in (0.8, 0.7, 0.6):
        for i, t in items:
            part = " ".join(x for x in t.split() if rng.random() < keep)
            rows.append((len(rows) + 1000, f"{sentence(rng, 60, 4000)} {part} {sentence(rng, 60, 4000)}", None, None, None))
    rows.append((9000, items[0][1].replace(" ", " unseen ", 3), None, None, None))
    bench = spark.createDataFrame(items + [(90, " ".join(f"new{k} {x}" for k, x in enumerate(items[5][1].split()[:9])))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    split = {i: np.array([int(x[1:]) for x in t.split()]) for i, t in items}
    for d, t, *_ in rows:
        text = np.array([int(x[1:]) for x in t.split() if x != "unseen"])
        for i, x in split.items():
            if decontaminate._common_length(x, text) >= 0.6 * len(x):
                assert (d, i) in got
    planted = {(1000 + 120 + k, i) for k in range(180) for i in [k % 60]} | {(9000, 0)}
    assert {p for p in got if p[1] < 90} <= planted


def test_common_length():
    a, b = np.array([1, 2, 3, 4, 2]), np.array([2, 9, 3, 2, 4])
    assert decontaminate._common_length(a, b) == 3 and decontaminate._common_length(a, np.array([], int)) == 0


# --- fixity ----------------------------------------------------------------------------------------
def test_audit(spark):
    rows = [(i * 3, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(200)] + [(None, "n", "x"), (9, "dup", "y"), (9, "dup", "y")]
    schema = "page_id long, url string, html string"
    a = spark.createDataFrame(rows, schema).withColumn("key", F.lit(0)).withColumn("hash", F.lit(0))
    assert fixity.audit(a, a.repartition(3)).count() == 0
    other = [r for r in rows if r[0] != 30] + [(31, "new", None)]
    other = [(i, u, "bad" if i == 60 else h) for i, u, h in other][:-2] + [(31, "new", None)]
    got = {(r.page_id, r.status): r for r in fixity.audit(a, spark.createDataFrame(other, schema)).collect()}
    assert set(got) == {(30, "missing"), (60, "altered"), (31, "extra"), (9, "altered")}
    record = lambda i, u, h: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{'' if i is None else i}>\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n"
    at = sum(len(record(*r)) for r in rows if r[0] is None or r[0] < 60)
    mine = next(r for r in rows if r[0] == 60)
    assert got[60, "altered"].start_byte == at and got[60, "altered"].bytes == len(record(*mine))
    assert got[60, "altered"].expected == hashlib.sha256(record(*mine).encode()).hexdigest()
    assert fixity.audit(a.where("false"), a.where("false")).count() == 0


# --- sharding --------------------------------------------------------------------------------------
def smallest_capacity(sizes, shards):
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 700])
def test_shards(spark, hot):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randrange(0, 40)), None, None, None) for i in range(600)]
    rows += [(1000 + i, "copy of one text", None, None, None) for i in range(hot)] + [(5000, None, None, None, None), (5001, None, None, None, None), (None, "q", None, None, None), (3, rows[3][1], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(0)).withColumn("gid", F.lit(0)).repartition(6)
    got = sharding.minimax_shards(df, 8).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append(t)
    slots, total, home = {}, {}, {}
    for r in got:
        t = by_id[r.doc_id][0]
        assert r["size"] == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] = total.get(r.shard, 0) + r["size"]
        assert home.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    groups = {}
    for _, t, *_ in rows:
        g = hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
        groups[g] = groups.get(g, 0) + len((t or "").encode()) + 16
    order = sorted(groups, key=lambda g: (int(g[:12] or "0", 16) % sharding.BLOCKS, g))
    big = max(groups.values())
    own = big if big * 8 > sum(groups.values()) else None
    rest = [groups[g] for g in order if groups[g] != own]
    assert max(v for s, v in total.items() if own is None or s) == smallest_capacity(rest, 8 - (own is not None))


def test_shards_empty(empty):
    assert sharding.minimax_shards(empty).count() == 0
