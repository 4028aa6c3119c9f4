"""N-gram Jaccard join: blocked product of the document by n-gram incidence, with bounds from set sizes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.components import components, merged as _merged
from adtide.llm.packing import pack, unpacked
from adtide.llm.store import free_names, materialise
from adtide.llm.words import chunks, mix, prefix, window_hash, words

SHINGLE = 5
PERCENT = 75
CELLS = 1 << 22  # of the frequency sketch; rare shingles stand out only where cells hold few
FAN_IN = 16
OFTEN = 1e-3  # a shingle in a larger share of the documents has its postings salted
SALTS = 64
BLOCK_SHINGLES = 2_000_000  # of one block of rows of the incidence matrix
DENSE_COLUMNS = 4096
PAIR_LIMIT = 1 << 30  # row pairs of two blocks
BLOCK_ROWS = int(PAIR_LIMIT**0.5) // 2
STEP_BITS = 4
STEPS = 56  # of a set; its prefix, a quarter, has as many as the bits tell apart
FEW = 32  # rows of a token; fewer or as many are paired one by one
LEAST_BITS, MOST_BITS = 64, 8192  # of the parity bitmap of a set
MARKS = 1 << 23  # cells of the bitmap of ids in clusters
BITMAP_BITS = 1 << 15  # of one row of Spark's bitmap functions
TILE_ROWS = 1000  # rows of a block that are multiplied with as many others at a time
PLAIN_ROWS = 64  # so few rows are multiplied without a look at their shingles


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence where it has fewer words."""
    w = words(column, lower=True)
    sums, out = prefix(w.hash), []
    first = w.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b == a:
            out.append(np.zeros(0, np.uint64))
            continue
        start = np.arange(a, max(a + 1, b - SHINGLE + 1))
        out.append(np.unique(window_hash(sums, start, np.minimum(start + SHINGLE, b))))
    return out


def _keyed(batches):
    """Add the key of the shingle set (null if empty) and its size."""
    for batch in chunks(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column(1))
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), batch.column(1)], ["id", "key", "n", "text"])


def _parity(s: np.ndarray) -> bytes:
    """A bit for each cell of hashes, about as many as shingles: whether an odd number of them falls there. Two bitmaps differ
    in no more bits than the sets in shingles, and a bitmap of half the cells is the exclusive or of its halves."""
    cells = min(max(1 << int(len(s) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    return np.packbits(np.bincount((mix(s) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def _sets(batches):
    """``_keyed`` with the bitmap of each set, and the text packed."""

    def marked():
        for batch in chunks(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column(1))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bits = [_parity(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(bits, pa.binary()), batch.column(1)],
                ["id", "key", "n", "bits", "text"])

    yield from pack(marked())


def _light(batches):
    for batch in _keyed(batches):
        yield batch.select([0, 1, 2])


def _packed(batches):
    yield from pack(_keyed(batches))


def _frequency(reps: DataFrame) -> bytes:
    """Sketch of how many sets hold a shingle: counts of all shingles by cell, of fixed size, compressed."""

    def count(batches):
        total = np.zeros(CELLS, np.int32)
        for batch in unpacked(batches, 1 << 20):
            np.add.at(total, (np.concatenate(shingle_sets(batch.column(0))) % np.uint64(CELLS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["v"])

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                more, total = _cells(x.as_py()), np.zeros(CELLS, np.int32) if total is None else total
                total += np.minimum(more, (1 << 31) - 1 - total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["v"])

    parts = reps.select("packed").mapInArrow(count, "v binary").repartition(FAN_IN).mapInArrow(add, "v binary")
    found = parts.repartition(1).mapInArrow(add, "v binary").collect()
    return bytes(found[0][0]) if found else zstandard.compress(bytes(4 * CELLS))


def _cells(sketch: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(sketch), np.int32)


def _postings(reps: DataFrame, packed: bytes, often: float) -> DataFrame:
    """(token, cls, salt, id, n): the prefix of each set in the order (cell count, hash), as much as any link must meet.

    The last bits of a token hold how far up the order it stands in its set, as a column of its own would double the shuffle.

    Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of either. A token of a large cell is split
    by size class and salt; its rows stand in the class of the size and in the next, so sizes within the ratio meet.
    """

    def emit(batches):
        sketch = _cells(packed)
        for batch in unpacked(batches, 1 << 20):
            token, size, which, step = [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column(1))):
                k = _prefix(len(s))
                cells = sketch[(s % np.uint64(CELLS)).astype(np.int64)]
                token.append(s[np.lexsort((s, cells))[:k]])
                size.append(np.full(k, len(s)))
                which.append(np.full(k, i))
                step.append((np.arange(k) * STEPS // max(1, len(s))).astype(np.uint64))
            token, size, which, step = (np.concatenate(x) for x in (token, size, which, step))
            large = sketch[(token % np.uint64(CELLS)).astype(np.int64)] > often
            cls = np.floor(np.log(np.maximum(size, 1)) / np.log(4 / 3)).astype(np.int64)
            take = np.concatenate([np.arange(len(token)), np.flatnonzero(large)])
            cls = np.concatenate([np.where(large, cls, -1), cls[large] + 1])
            salt = np.where(large[take], (mix(which[take].astype(np.uint64) + token[take]) % np.uint64(SALTS)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([
                pa.array((token - token % np.uint64(1 << STEP_BITS) + step)[take].view(np.int64)), pa.array(cls.astype(np.int16)),
                pa.array(salt.astype(np.int16)), batch.column(0).take(pa.array(which[take])), pa.array(size[take])],
                ["token", "cls", "salt", "id", "n"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "packed").mapInArrow(emit, f"token long, cls short, salt short, id {kind}, n long")


def _prefix(n):
    """So many shingles of a set of n, in any order common to all sets, must hold one that a linked set has too."""
    return n - (PERCENT * n + 99) // 100 + 1


def _candidates(post: DataFrame) -> DataFrame:
    """(a, b, alone): whoever links ends in one cluster, through the first token of their common order that both hold.

    What stands before that token is in one set only, so the sizes less the positions bound the overlap. The few rows of
    a rare token are tested pair by pair, so each such pair stands ``alone``: it may be dropped if the two do not link.
    Others are chained by size: the smaller set of a link holds the token in its
    first seventh, so each row is tied to the last such row before it. A salted token's rows are chained whatever they hold.
    """
    name = F.shiftright("token", STEP_BITS)
    before = F.col("n") * F.col("token").bitwiseAND((1 << STEP_BITS) - 1) / STEPS
    post = post.repartition(name, "cls", "salt").select(name.alias("token"), "cls", "salt", "id", "n", F.floor(before).alias("pos"))
    line = Window.partitionBy("token", "cls", "salt").orderBy("n", "id")
    row = F.struct("id", "n", "pos")
    least = lambda n, i, m, j: (100 + PERCENT) * F.least(n - i, m - j) >= PERCENT * (n + m)
    n, i = F.col("n"), F.col("pos")
    shared = post.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("token", "cls", "salt"))).where("rows > 1")
    few = (F.col("rows") <= FEW) & (F.col("cls") < 0)
    early = F.last(F.when(~few & (least(n, i, n, i) | (F.col("cls") >= 0)), row), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.collect_list(F.when(few, row)).over(line.rowsBetween(1 - FEW, -1))
    seen = shared.select("cls", "id", "n", "pos", few.alias("few"), early.alias("early"), earlier.alias("earlier"))
    tied = F.col("early").isNotNull() & ((F.col("cls") >= 0) | (100 * F.col("early.n") >= PERCENT * n))
    near = F.transform(F.filter("earlier", lambda r: least(n, i, r["n"], r["pos"])), lambda r: r["id"])
    to = F.when(F.col("few"), near).otherwise(F.array_compact(F.array(F.when(tied, F.col("early.id")))))
    chain = seen.select(F.col("id").alias("a"), F.explode(to).alias("b"), F.col("few").alias("alone"))
    heads = post.where("cls >= 0").groupBy("token", "cls", "salt").agg(F.min("id").alias("id"))
    across = heads.select("id", F.lag("id").over(Window.partitionBy("token", "cls").orderBy("salt")).alias("b"))
    return chain.union(across.where("b is not null").select(F.col("id").alias("a"), "b", F.lit(False)))


def _candidate_links(post: DataFrame) -> DataFrame:
    return _candidates(post).select("a", "b")


def _differ_little(batches):
    """The pairs (a, b) whose bitmaps leave room for a link: linked sets of n and m differ in (n + m) / 7 shingles at most.
    An id of several sets has no bitmap and passes."""
    for batch in batches:
        n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
        keep = np.ones(batch.num_rows, bool)
        for k in range(batch.num_rows):
            if x[k] is None or y[k] is None:
                continue
            size, bits = [len(x[k]) * 8, len(y[k]) * 8], [int.from_bytes(v, "little") for v in (x[k], y[k])]
            for side in (0, 1):
                while size[side] > size[1 - side]:
                    size[side] //= 2
                    bits[side] = (bits[side] >> size[side]) ^ (bits[side] & ((1 << size[side]) - 1))
            keep[k] = (100 + PERCENT) * (bits[0] ^ bits[1]).bit_count() <= (100 - PERCENT) * (n[k] + m[k])
        yield batch.select([0, 1]).filter(pa.array(keep))


def _links(rows: DataFrame, post: DataFrame) -> DataFrame:
    """Candidate links; of the pairs that stand alone those that the bitmaps of their sets let pass.

    Common phrases make such pairs by chance, more for each document the more there are, and would tie all to one cluster.
    """
    found = materialise(_candidates(post).distinct(), "jaccard-candidates")
    of = rows.groupBy("id").agg(F.count(F.lit(1)).alias("sets"), F.first("n"), F.first("bits")).where("sets = 1").drop("sets")
    pairs = found.where("alone and a <> b").join(of.toDF("a", "n", "x"), "a", "left").join(of.toDF("b", "m", "y"), "b", "left").select("a", "b", "n", "m", "x", "y")
    kind = rows.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(_differ_little, f"a {kind}, b {kind}").union(found.where("not alone").select("a", "b"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block: the incidence matrix times its transpose, summed over column blocks."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    width = int((count > 1).sum())
    total = np.zeros((m, m), np.float32)
    for at in range(0, width, DENSE_COLUMNS):
        here = (col >= at) & (col < at + DENSE_COLUMNS) if width > DENSE_COLUMNS else slice(None)
        dense = np.zeros((m, min(DENSE_COLUMNS, width - at)), np.float32)
        dense[row[here], col[here] - at] = 1
        used = np.flatnonzero(dense.any(1))
        if len(used) * 2 < m:
            total[np.ix_(used, used)] += dense[used] @ dense[used].T
        else:
            total += dense @ dense.T
    return total


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """A link from the first member to each other one, for each component of the link matrix."""
    left, out = np.ones(len(link), bool), []
    for i in range(len(link)):
        if not left[i]:
            continue
        left[i], edge = False, np.array([i])
        while len(edge):
            new = np.flatnonzero(link[edge].any(0) & left)
            left[new] = False
            out.extend((i, int(k)) for k in new)
            edge = new
    return out


def _chained(sets: list[np.ndarray], size: np.ndarray) -> list[np.ndarray]:
    """The rows of a block in parts that no link crosses: chains through shared shingles of the prefixes, as above, here in
    the order of the exact counts in the block."""
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    col, many = col.astype(np.int32), count[col].astype(np.int32)
    order = np.lexsort((col, many, row))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    keep = order[(rank < np.repeat(_prefix(size), size)) & (many[order] > 1)]
    keep = keep[np.lexsort((size[row[keep]], col[keep]))]
    r, c = row[keep], col[keep]
    near = (c[1:] == c[:-1]) & (100 * size[r[:-1]] >= PERCENT * size[r[1:]])
    label = _merged(np.arange(len(sets)), r[:-1][near], r[1:][near])
    order = np.argsort(label, kind="stable")
    return [p for p in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(p) > 1]


def _block_links(sets: list[np.ndarray], tile: int = TILE_ROWS) -> list[tuple[int, int]]:
    """Spanning links of a block. A part is multiplied in tiles of rows of near sizes; tiles whose rows are all in one
    component already need no product."""
    size, out = np.array([len(s) for s in sets]), []
    label = np.arange(len(sets))
    for rows in _chained(sets, size) if len(sets) > PLAIN_ROWS else [label]:
        rows = rows[np.argsort(size[rows], kind="stable")]
        tiles = [rows[at : at + tile] for at in range(0, len(rows), tile)]
        for i, j in ((i, i + d) for d in range(len(tiles)) for i in range(len(tiles) - d)):
            both = tiles[i] if i == j else np.concatenate([tiles[i], tiles[j]])
            if PERCENT * size[tiles[j][0]] > 100 * size[tiles[i][-1]] or (label[both] == label[both[0]]).all():
                continue
            n = size[both].astype(np.float32)
            common = _overlaps([sets[r] for r in both])
            near = PERCENT * np.maximum(n[:, None], n[None, :]) <= 100 * np.minimum(n[:, None], n[None, :])
            found = _spanning(near & (100 * common >= PERCENT * (n[:, None] + n[None, :] - common)))
            if found:
                a, b = both[np.array(found).T]
                label = _merged(label, a, b)
                out.extend(zip(a.tolist(), b.tolist(), strict=True))
    return out


def _verify(batches):
    """Links inside each block (cluster, i, j); rows arrive in the order of the blocks."""
    ids, sets, key, kind = [], [], None, None

    def links():
        found = [(ids[a], ids[b]) for a, b in _block_links(sets)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], ["a", "b"])

    for batch in unpacked(batches, 1 << 20):
        kind = batch.schema.field(3).type
        new = shingle_sets(batch.column(4))
        for cluster, i, j, rid, s in zip(*(c.to_pylist() for c in batch.columns[:4]), new, strict=True):
            if (cluster, i, j) != key:
                if len(sets) > 1:
                    yield links()
                ids, sets, key = [], [], (cluster, i, j)
            ids.append(rid)
            sets.append(s)
    if len(sets) > 1:
        yield links()


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids``, by a bitmap of hashed ids of fixed size, before a join shuffles their texts."""
    cell = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    bits = ids.select((cell + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in bits.collect():
        marks[(r.bucket - 1) * BITMAP_BITS // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    packed = zstandard.compress(marks.tobytes(), 1)

    def keep(batches):
        held = np.frombuffer(zstandard.decompress(packed), np.uint8)
        for batch in batches:
            c = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((held[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)))

    marked = rows.withColumn("cell", cell)
    return marked.mapInArrow(keep, marked.schema).drop("cell")


def _block_pairs(reps: DataFrame, near: DataFrame, block: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(cluster, own, pairs, id, packed): the block of each row of a cluster, and the blocks that it is multiplied with.

    A cluster within both limits is one block. Others are dealt to blocks inside size classes of ratio 4/3; rows that can
    link are of one class or of neighbouring ones. Rows are placed without their texts, which then meet their places.
    """
    light = reps.select("id", "key", "n").join(near, "id").withColumn("cls", _size_class())
    need = F.greatest(F.ceil(F.col("s") / block), F.ceil(F.col("m") / rows))
    sums = [F.sum("n").alias("s"), F.count(F.lit(1)).alias("m")]
    classes = light.groupBy("cluster", "cls").agg(*sums).withColumn("k", need)
    clusters = classes.groupBy("cluster").agg(
        F.sum("s").alias("s"), F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("cls", "k"))).alias("slots")).where("m > 1")
    clusters = clusters.select("cluster", (need > 1).alias("many"), "slots")
    placed = light.join(clusters, "cluster")
    slot = F.pmod(F.xxhash64("id", "key"), F.element_at("slots", F.col("cls")))
    placed = placed.withColumn("own", F.when(F.col("many"), F.col("cls") * (1 << 32) + slot).otherwise(F.lit(0)))
    other = F.expr("""flatten(transform(array(cls - 1, cls, cls + 1), c -> coalesce(
        transform(sequence(0L, try_element_at(slots, c) - 1L), j -> c * 4294967296L + j), cast(array() as array<bigint>))))""")
    other = F.when(F.col("many"), F.filter(other, lambda b: b != F.col("own")))
    pairs = F.when(F.size(other) > 0, other).otherwise(F.array("own"))
    placed = materialise(placed.select("cluster", "own", pairs.alias("pairs"), "id", "key"), "jaccard-placed")
    texts = _marked(reps.select("id", "key", "packed"), placed)
    return texts.join(placed, ["id", "key"]).select("cluster", "own", "pairs", "id", "packed")


def _clusters(reps: DataFrame, block: int) -> DataFrame:
    """(id, cluster): a superset of the classes. The rows of clusters beyond one block are clustered once more among themselves,
    where the cells of the sketch hold fewer shingles, so that chains by chance break."""

    def near(rows):
        often = max(64.0, OFTEN * rows.count())
        return components(_links(rows, _postings(rows, _frequency(rows), often)), "jaccard-clusters").withColumnRenamed("component", "cluster")

    first = materialise(near(reps), "jaccard-first")
    size = reps.select("id", "n").join(first, "id").groupBy("cluster").agg(F.sum("n").alias("s"))
    large = materialise(first.join(size.where(F.col("s") > block), "cluster", "left_semi").select("id"), "jaccard-large")
    if large.isEmpty():
        return first
    again = near(materialise(reps.join(large, "id", "left_semi"), "jaccard-again"))
    return first.join(large, "id", "left_anti").unionByName(again)


def _size_class():
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(4 / 3)) + 1e-9)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """The near-duplicate class of every document: columns id, n_shingles, component_id.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more; a class is what
    links reach, named by its smallest id. Equal sets are one row of the incidence matrix from the start. Rows that can
    link share a shingle in a prefix whose length follows from their size, in one global order with common shingles last;
    pairs and chains through these shingles cut the matrix into clusters, a superset of the classes, after pairs fell whose bitmaps
    differ in more bits than linked sets in shingles; those beyond one block are cut once
    more by counts among their own rows. A cluster's rows are dealt to
    blocks of bounded shingles and rows, and each pair of blocks whose sizes can link goes to one task, as compressed texts. There,
    chains by the exact counts cut the rows again, and what is left is multiplied in tiles: overlap counts add up over column blocks,
    pairs are discarded by the bound 0.75 max <= min of the sizes and by the count itself, and only spanning links leave
    the task. So a group of copies is never expanded into its pairs. The order and the clusters only steer the work; no link
    is lost. Shingles are compared by 64-bit hashes.

    Null and empty texts have no shingles and stay alone. A null id links nothing and has no component. Rows with equal
    ids and different texts share one node. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.mapInArrow(_sets, f"id {kind}, key binary, n long, bits binary, packed binary")
    reps = materialise(keyed.where("key is not null and id is not null").groupBy("key").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bits", "packed")]), "jaccard-sets")
    other = _block_pairs(reps, _clusters(reps, block), block).select("cluster", "own", F.explode("pairs").alias("p"), "id", "packed")
    blocks = other.select("cluster", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"), "id", "packed")
    links = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_verify, f"a {kind}, b {kind}")
    classes = components(links, "jaccard-links")
    of_key = reps.select("key", F.col("id").alias("rep")).join(classes.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("class"))
    light = rows.mapInArrow(_light, f"id {kind}, key binary, n long")
    return light.join(of_key, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id names their class; of rows with equal ids one stays.

    Rows without an id stay. See ``jaccard_classes``.
    """
    keep = jaccard_classes(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).desc_nulls_last()))
    (own,) = free_names(docs, "turn")
    kept = docs.join(keep, id_col, "left_semi").withColumn(own, turn).where(F.col(own) == 1).drop(own)
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
