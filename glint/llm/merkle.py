"""Merkle manifest of a dataset: ternary hash trees by source below one root, stored in blocks in van Emde Boas order.

Tree. A row's leaf is the SHA-256 of its five fields, each framed by its length. Within a source leaves ascend by doc_id
(null first; equal ones by leaf); every ARITY consecutive nodes have the hash of their digests as a parent, the last run having fewer, until one is
left, the source's subroot. Subroots, ordered by source (null first, by bytes), are the leaves of the tree whose root names
the dataset.

Layout. A tree is cut into aligned subtrees of HEIGHT levels above their leaves; the roots of these blocks are the leaves of
the next tier, until a tier has one block. A block is one row (tree, tier, block, n, height, nodes): its digests as they
stand in van Emde Boas order, the subtree of the upper half of the levels first, then those below it from left to right, each laid out in the same way.
``address`` finds a node's place by arithmetic alone, so building and reading a path need no pointers, and
a path touches few stretches of memory whatever the size of a cache line. The last block of a tier has fewer leaves; the
places of nodes that don't exist are zero.

Work. Leaves are hashed in the JVM; only doc_id and digests are shuffled: once by ranges of (source, doc_id), which gives each row
its index without sorting a source in one task, and once by block (2187 leaves at most). What stands above a block (siblings up to the
root) is worked out once for each block, tier by tier from the top.

Defined cases: a null field is hashed as ``-``; null, empty and long texts are hashed whole; rows that repeat a doc_id are leaves
each, in the order of their digests; an empty table has no blocks, no root and no proofs; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm import scratch

ARITY = 3
HEIGHT = 7
LEAVES = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = "tree string, tier int, block long, n long, height int, nodes binary, root binary"


# ---- layout ------------------------------------------------------------------------------------------------------


def size(height: int) -> int:
    """Nodes of a full tree with ``height`` levels above its leaves."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, index):
    """Place in van Emde Boas order of the node(s) ``index`` (from the left) at ``depth`` (the root's is 0)."""
    base = index * 0
    while height:
        upper = (height + 1) // 2  # levels of the upper half
        if depth < upper:
            height = upper - 1
            continue
        below = ARITY ** (depth - upper)
        base = base + size(upper - 1) + index // below * size(height - upper)
        index, depth, height = index % below, depth - upper, height - upper
    return base


def height_of(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


def _parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


def build(leaves: list[bytes], height: int) -> np.ndarray:
    """The digests of a block, a row of 32 bytes for each place."""
    nodes = np.zeros((size(height), 32), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[address(height, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        if depth:
            level = [_parent(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int) -> list[list[tuple[bytes, bytes]]]:
    """For each level from the leaves to below the root, and each node there: the hex digests of its run before and after it."""
    out = []
    for depth in range(height, 0, -1):
        count = -(-n // ARITY ** (height - depth))
        hexes = [x.tobytes().hex().encode() for x in nodes[address(height, depth, np.arange(count))]]
        out.append([(b"".join(hexes[i - i % ARITY : i]), b"".join(hexes[i + 1 : i - i % ARITY + ARITY])) for i in range(count)])
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings, level by level, lead to."""
    for before, after in path:
        digest = hashlib.sha256(before + digest.hex().encode() + after).digest()
    return digest


# ---- leaves ------------------------------------------------------------------------------------------------------


def _leaf(fields: list[Column]) -> Column:
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree, digest, and ``seen``: the digest with the text in ``tampered`` (none: as it is)."""
    own = [F.col(c).cast("string") for c in FIELDS]
    changed = F.lit(False) if tampered is None else ~tampered.eqNullSafe(own[-1])
    leaf = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), _leaf(own).alias("digest"), F.when(changed, _leaf([*own[:-1], own[-1] if tampered is None else tampered])).alias("seen"))
    return leaf.withColumn("seen", F.coalesce("seen", "digest"))


def _indexed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``index`` (from 0, in order within their tree) and ``n``, the rows of the tree.

    Rows are dealt by ranges of (tree, order); a task numbers its own rows, and the counts of the tasks before are added.
    """
    names = ["part", "seq", *rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("tree"))
            numbers = np.empty(batch.num_rows, np.int64)
            for i, tree in enumerate(own.to_pylist()):
                seq = seq + 1 if tree == last else 0
                last, numbers[i] = tree, seq
            columns = [pa.array(numbers) if c == "seq" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    found = scratch.cut(dealt.mapInArrow(run, ", ".join(["part int", "seq long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]])), "indexed")
    counts = found.groupBy("tree", "part").agg(F.count("*").alias("c"))  # a row for each tree and task
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "part", F.sum("c").over(tree).alias("n"), (F.sum("c").over(tree.orderBy("part")) - F.col("c")).alias("before"))
    return found.join(counts, ["tree", "part"]).withColumn("index", F.col("before") + F.col("seq")).drop("part", "seq", "before")


# ---- the manifest --------------------------------------------------------------------------------------------------


def _tier(rows: DataFrame, tier: int) -> DataFrame:
    """The blocks above ``rows`` (tree, index, digest, n)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        n, total, block = group.num_rows, group.column("n")[0].as_py(), group.column("block")[0].as_py()
        height = HEIGHT if total > LEAVES else height_of(n)
        nodes = build(group.column("digest").to_pylist(), height)
        row = [group.column("tree")[0].as_py(), tier, block, n, height, nodes.tobytes(), nodes[0].tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    own = rows.select("tree", F.expr(f"index div {LEAVES}").alias("block"), "index", "digest", "n")
    return own.groupBy("tree", "block").applyInArrow(run, BLOCK)


def manifest(rows: DataFrame) -> list[DataFrame]:
    """The tiers of blocks above ``rows`` (tree, index, digest, n), the lowest first."""
    tiers: list[DataFrame] = []
    while True:
        blocks = scratch.cut(_tier(rows, len(tiers)), "merkle")
        tiers.append(blocks)
        rows = blocks.select("tree", F.col("block").alias("index"), F.col("root").alias("digest"), F.count("*").over(Window.partitionBy("tree")).alias("n")).where("n > 1")
        if rows.isEmpty():
            return tiers


def _passed_down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """tree, index (of the leaf), before and after (lists of hex digests, from the leaf's level up) for each leaf of blocks whose ``above`` is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                levels = siblings(np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32), b["height"], b["n"])
                paths = [[level[i // ARITY**k] for k, level in enumerate(levels)] for i in range(b["n"])]
                before = [[x for x, _ in p] + b["before"] for p in paths]
                after = [[x for _, x in p] + b["after"] for p in paths]
                first = b["block"] * LEAVES
                yield pa.RecordBatch.from_arrays([pa.array([b["tree"]] * b["n"], pa.string()), pa.array(range(first, first + b["n"]), pa.int64()), pa.array(before, pa.list_(pa.binary())), pa.array(after, pa.list_(pa.binary()))], ["tree", "index", "before", "after"])

    return blocks.join(above, ["tree", "block"]).select("tree", "block", "n", "height", "nodes", "before", "after").mapInArrow(run, "tree string, index long, before array<binary>, after array<binary>")


def _above(tiers: list[DataFrame], top: DataFrame | None) -> DataFrame:
    """tree, block, before and after of the lowest blocks; ``top`` (tree, before, after) is what stands above the trees' roots."""
    none = F.array().cast("array<binary>")
    known = None
    for tier in reversed(tiers):
        alone = tier.select("tree", "block", F.count("*").over(Window.partitionBy("tree")).alias("c")).where("c = 1").select("tree", "block")
        ends = alone.join(top, "tree") if top is not None else alone.withColumn("before", none).withColumn("after", none)
        if known is not None:
            ends = ends.union(_passed_down(*known).select("tree", F.col("index").alias("block"), "before", "after"))
        known = tier, scratch.cut(ends.select("tree", "block", "before", "after"), "above")
    return known[1]


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """For each row: doc_id, leaf, subroot, root, proof_sha256 (hash of its siblings up to the root), folded_root and verified.

    Subroots, root and siblings are those of the manifest of ``docs``; folded_root is what they make of the row with the
    text in ``tampered``, and verified whether that is the root.
    """
    bare = scratch.cut(leaves(docs, tampered), "leaves")  # the ranges are sampled from these, so texts are hashed once
    rows = _indexed(bare, "doc_id", "digest")
    scratch.drop(bare)
    tiers = manifest(rows)
    ends = [t.withColumn("c", F.count("*").over(Window.partitionBy("tree"))).where("c = 1").select("tree", F.col("root").alias("digest")) for t in tiers]  # a tree's last tier is the one with one block
    subroots = ends[0]
    for t in ends[1:]:
        subroots = subroots.union(t)
    subroots = scratch.cut(subroots, "subroots")
    numbered = scratch.cut(_indexed(subroots.select(F.col("tree").alias("source"), F.lit("").alias("tree"), "digest"), "source"), "trees")
    crown = manifest(numbered)
    over = _passed_down(crown[0], _above(crown, None)).select("index", "before", "after")
    top = scratch.cut(numbered.select(F.col("source").alias("tree"), "index").join(over, "index").drop("index"), "top")
    root = crown[-1].select(F.col("root").alias("_root"))  # one row
    blocks = tiers[0].join(_above(tiers, top), ["tree", "block"]).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").join(F.broadcast(root))

    def run(key: tuple, own: pa.Table, block: pa.Table) -> pa.Table:
        b = block.to_pylist()[0]
        levels = siblings(np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32), b["height"], b["n"])
        above = list(zip(b["before"], b["after"], strict=True))
        high = b"".join(x + y for x, y in above)
        first, proofs, folded = b["block"] * LEAVES, [], []
        for index, seen in zip(own.column("index").to_pylist(), own.column("seen").to_pylist(), strict=True):
            path = [level[(index - first) // ARITY**k] for k, level in enumerate(levels)]
            proofs.append(hashlib.sha256(b"".join(x + y for x, y in path) + high).hexdigest())
            folded.append(fold(seen, path + above).hex())
        n, root = own.num_rows, b["_root"].hex()
        leaf = [x.hex() for x in own.column("digest").to_pylist()]
        return pa.table([own.column("doc_id"), pa.array(leaf), pa.array([b["subroot"].hex()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])], names=_OUT)

    dealt = rows.withColumn("block", F.expr(f"index div {LEAVES}")).select("tree", "block", "index", "doc_id", "digest", "seen")
    held = blocks.select("tree", "block", "n", "height", "nodes", "before", "after", "subroot", "_root")
    return dealt.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def without_newlines() -> Column:
    """The text without its \\n where 2 divides the CRC-32 of the decimal doc_id."""
    text = F.col("text").cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
