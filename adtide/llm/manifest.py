"""Merkle dataset manifest: an append log of nodes in the order of their completion, and proofs by closed-form positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from adtide.llm.store import materialise

BITS = 8  # a builder's block has 2^BITS nodes of the level it stands on
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 over each field as ``-`` if null, else its length in bytes, a colon and its value."""
    value = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*[F.coalesce(value(c.cast("string")), F.lit("-")) for c in fields.values()]), 256)


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of a node of a tree of ``leaves``: it follows its last leaf, which ``2 e - popcount(e)`` nodes precede.

    So a left part of ``e`` leaves makes as many nodes; a node of the right edge has fewer leaves but the same form.
    """
    last = min((index + 1) << level, leaves) - 1
    return 2 * last - last.bit_count() + level


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append_log(hashes: list[str], levels: int) -> list[str]:
    """The nodes over the hashes in the order of completion; a lone last node gets a parent of its own up to ``levels``."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]
    for k, leaf in enumerate(hashes):
        node, level, last = leaf, 0, k == len(hashes) - 1
        while True:
            log.append(node)
            waiting[level].append(node)
            if level == levels or not (last or len(waiting[level]) == 2):
                break
            node = digest(*waiting[level])
            waiting[level].clear()
            level += 1
    return log


def siblings(log: list[str], leaf: int, leaves: int, levels: int) -> list[str]:
    """From the leaf up: ``<`` and the sibling on its left, ``>`` and that on its right, or nothing for a lone node."""
    out = []
    for level in range(levels):
        index = leaf >> level
        if index & 1:
            out.append("<" + log[position(level, index - 1, leaves)])
        elif (index + 1) << level < leaves:
            out.append(">" + log[position(level, index + 1, leaves)])
        else:
            out.append("")
    return out


def fold(leaf: str, path: Iterable[str]) -> str:
    for s in path:
        leaf = digest(s[1:], leaf) if s[:1] == "<" else digest(leaf, s[1:])
    return leaf


def placed(nodes: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``nodes`` with ``pos``, the place within ``grp`` by ``order``, and ``n``, the group's size; and the largest size.

    Rows are sorted by ranges of group and order, so a large group takes many partitions; equal rows may be split too. A
    row's place is its number within the partition behind the group's rows in earlier partitions.
    """
    row = F.monotonically_increasing_id()
    keys = ["grp", *order, "tie"]
    ranged = materialise(nodes, name).withColumn("tie", row).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    sorted_ = materialise(ranged.withColumn("row", row), f"{name}-sorted").withColumn("part", F.shiftright("row", 33))
    parts = sorted_.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("low"))
    inside = Window.partitionBy("grp")
    before = F.coalesce(F.sum("k").over(inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(parts.select("grp", "part", (before - F.col("low")).alias("shift"), F.sum("k").over(inside).alias("n")), f"{name}-starts")
    out = sorted_.join(starts, ["grp", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "shift", "part")
    return out, starts.agg(F.max("n")).first()[0] or 0


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], list(columns))


BLOCK = "grp string, block long, n long, total long, nodes array<struct<pos:long,hash:string,id:long,bad:string>>, log array<string>, root string"


def _levels(n: int) -> int:
    return min(BITS, height(n))


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log of every block: up to its one node on level BITS, or to the root where a block is the whole tree."""
    for batch in batches:
        logs = [append_log([x["hash"] for x in r["nodes"]], _levels(r["n"])) for r in _rows([batch])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.list_(pa.string())), pa.array([x[-1] for x in logs], pa.string())],
                                         [*batch.schema.names, "log", "root"])


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """One row for each aligned block of nodes (grp, pos, n, total, hash, id, bad), with its part of the log."""
    by = ["grp", F.shiftright("pos", BITS).alias("block")]
    rows = nodes.groupBy(*by).agg(F.max("n").alias("n"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "hash", "id", "bad"))).alias("nodes"))
    return materialise(rows.mapInArrow(_build, BLOCK), name)


def storeys(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Blocks over the nodes, blocks over those blocks' roots, and so on until every group is one block."""
    out = [_blocks(nodes.withColumn("total", F.col("n")), f"{name}-0")]
    while largest > 1 << BITS:
        largest = -(-largest >> BITS)
        n = F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n")
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("bad")]
        out.append(_blocks(out[-1].select("grp", F.col("block").alias("pos"), n, "total", F.col("root").alias("hash"), *none), f"{name}-{len(out)}"))
    return out


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, block, up): for every node of a block its siblings up to the top, as the path of the block below it."""
    for r in _rows(batches):
        up = [siblings(r["log"], k, len(r["nodes"]), _levels(r["n"])) + (r["up"] or []) for k in range(len(r["nodes"]))]
        yield _batch({"grp": (pa.string(), [r["grp"]] * len(up)), "block": (pa.int64(), [x["pos"] for x in r["nodes"]]), "up": (pa.list_(pa.string()), up)})


def _prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and folded root of each leaf of a block."""
    for r in _rows(batches):
        nodes, above = r["nodes"], r["up"] or []
        proofs = [siblings(r["log"], k, len(nodes), _levels(r["n"])) + above for k in range(len(nodes))]
        folded = [fold(x["bad"] or x["hash"], p) for x, p in zip(nodes, proofs, strict=True)]
        text = pa.string()
        yield _batch({"doc_id": (pa.int64(), [x["id"] for x in nodes]), "leaf": (text, [x["hash"] for x in nodes]), "subroot": (text, [r["subroot"]] * len(nodes)),
                      "root": (text, [r["top"]] * len(nodes)), "proof": (pa.list_(text), proofs), "folded_root": (text, folded)})


def _entries(storey: int):
    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's nodes with their places in the whole log; the lowest level of an upper storey is known already."""
        for r in _rows(batches):
            size, base, out = len(r["nodes"]), storey * BITS, []
            for level in range(1 if storey else 0, _levels(r["n"]) + 1):
                for k in range(-(-size >> level)):
                    index = (r["block"] << BITS >> level) + k
                    out.append((position(base + level, index, r["total"]), base + level, r["log"][position(level, k, size)]))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield _batch({"grp": (pa.string(), [r["grp"]] * len(out)), "position": (pa.int64(), list(columns[0])), "level": (pa.int32(), list(columns[1])),
                          "hash": (pa.string(), list(columns[2]))})

    return entries


def _down(levels: list[DataFrame], top: DataFrame | None, name: str) -> DataFrame:
    """Lowest blocks with ``up``, the siblings above each: ``top`` (grp, up) for whole trees, handed down storey by storey."""
    here = levels[-1].withColumn("up", F.lit(None).cast("array<string>")) if top is None else levels[-1].join(top, "grp")
    for k in range(len(levels) - 1, 0, -1):
        up = materialise(here.mapInArrow(_paths, "grp string, block long, up array<string>"), f"{name}-up-{k}")
        here = levels[k - 1].join(up, ["grp", "block"])
    return here


class Manifest:
    """Trees over the records of each value of ``by``, and one tree over their roots.

    Records of a tree ascend by ``id_col`` (null first; equal ids by leaf digest), trees by the value, null first. A node over
    a last lone child hashes that one. ``leaf`` gives the digest of a record; ``changed`` that of a tampered one, null for
    records left alone. Trees are built in aligned blocks, each by one task, and written as they complete: storeys of
    blocks, every one a 256th of the one below. The driver reads the sizes of the largest trees, nothing else.
    """

    def __init__(self, docs: DataFrame, leaf: Column, changed: Column | None = None, id_col: str = "doc_id", by: str = "lang"):
        group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("grp")
        bad = F.lit(None).cast("string") if changed is None else changed
        leaves, largest = placed(docs.select(group, F.col(id_col).cast("long").alias("id"), leaf.alias("hash"), bad.alias("bad")), ["id", "hash"], "manifest")
        self.records = storeys(leaves, largest, "manifest-trees")
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("bad")]
        roots, largest = placed(self.records[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("hash"), *none), ["key"], "manifest-roots")
        self.keys = materialise(roots, "manifest-keys")
        self.trees = storeys(self.keys, largest, "manifest-top")

    def root(self) -> DataFrame:
        return self.trees[-1].select(F.col("root"))

    def log(self) -> DataFrame:
        """The append log of every tree of records: grp (``=`` and the value, empty for null), position, level, hash."""
        parts = [blocks.mapInArrow(_entries(k), "grp string, position long, level int, hash string") for k, blocks in enumerate(self.records)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof (``<`` or ``>`` and the sibling, empty for a lone node), folded_root."""
        above = _down(self.trees, None, "manifest-top").mapInArrow(_paths, "grp string, block long, up array<string>")
        keys = self.keys.select("pos", F.col("key").alias("grp"), F.col("hash").alias("subroot"))
        top = materialise(keys.join(above.select(F.col("block").alias("pos"), "up"), "pos").select("grp", "up", "subroot"), "manifest-above")
        blocks = _down(self.records, top.select("grp", "up"), "manifest-trees").join(top.select("grp", "subroot"), "grp").withColumn("top", self.root().scalar())
        shape = "doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string"
        return blocks.select("nodes", "log", "n", "up", "subroot", "top").mapInArrow(_prove, shape)


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all records where one in seven, by the CRC-32 of its id, had ``n_chars`` raised by one after the build.

    Columns besides ``FIELDS`` are ignored. Null fields have a digest of their own, so a null ``n_chars`` cannot be raised
    and verifies. Records of a null id share the place before all others and are left alone; repeated records are leaves
    each. An empty table gives no rows. Proofs travel as digests and texts are read once.
    """
    fields = {c: F.col(c) for c in FIELDS}
    leaf = record_digest(fields)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    bad = F.when(struck, record_digest({**fields, "n_chars": F.col("n_chars") + 1}))
    out = Manifest(docs, leaf, bad).proofs()
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
