"""Merkle manifest of a dataset: block trees in van Emde Boas order, sibling retrieval, folding of claimed rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.llm.common import arrow_map, written

# Levels below a block's root: a block has up to 2 ** HEIGHT leaves, its tree some 64 KB.
HEIGHT = 10
DIGEST = 32
# A step of a path: 0 for no sibling, 1 for one on the right, 2 for one on the left; then the sibling's digest.
STEP = 1 + DIGEST
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def place(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slots of the nodes ``index`` (from the left) at ``depth`` of a full tree with so many levels.

    The tree is cut at half its height: the upper subtree comes first, then the lower subtrees from left to right, each
    laid out in the same way. A walk from a leaf to the root so meets few memory blocks, whatever their size.
    """
    if levels == 1:
        return np.zeros(len(index), dtype=np.int64)
    upper = levels // 2
    lower, below = levels - upper, depth - upper
    if below < 0:
        return place(upper, depth, index)
    return (1 << upper) - 1 + (index >> below) * ((1 << lower) - 1) + place(lower, below, index & ((1 << below) - 1))


@cache
def slots(height: int) -> list[np.ndarray]:
    """The slots of all nodes, by depth, of a full tree with ``height`` levels below the root."""
    return [place(height + 1, depth, np.arange(1 << depth)) for depth in range(height + 1)]


def tree_height(size: int, height: int = HEIGHT) -> int:
    """Levels below the root of a block in a run of ``size`` nodes: full where the run has several blocks."""
    return min(height, max(size - 1, 0).bit_length())


def grow(digests: bytes, height: int) -> tuple[bytes, bytes]:
    """The tree over the leaves' digests and its root; slots without a node are zero."""
    at, count = slots(height), len(digests) // DIGEST
    tree = np.zeros(((2 << height) - 1, DIGEST), dtype=np.uint8)
    tree[at[height][:count]] = np.frombuffer(digests, dtype=np.uint8).reshape(-1, DIGEST)
    for depth in range(height, 0, -1):
        nodes = tree[at[depth][:count]].tobytes().hex()
        made = b"".join(hashlib.sha256(nodes[k:k + 4 * DIGEST].encode()).digest() for k in range(0, len(nodes), 4 * DIGEST))
        count = (count + 1) // 2
        tree[at[depth - 1][:count]] = np.frombuffer(made, dtype=np.uint8).reshape(-1, DIGEST)
    return tree.tobytes(), tree[0].tobytes()


def leaf_paths(tree: bytes, count: int, height: int) -> np.ndarray:
    """The steps from each of the ``count`` leaves to the root, as rows of ``height * STEP`` bytes."""
    nodes, at = np.frombuffer(tree, dtype=np.uint8).reshape(-1, DIGEST), slots(height)
    out = np.zeros((count, height, STEP), dtype=np.uint8)
    index, alive = np.arange(count), count
    for step, depth in enumerate(range(height, 0, -1)):
        has = np.flatnonzero((index ^ 1) < alive)
        out[has, step, 0] = 1 + (index[has] & 1)
        out[has, step, 1:] = nodes[at[depth][index[has] ^ 1]]
        index, alive = index >> 1, (alive + 1) // 2
    return out.reshape(count, height * STEP)


def fold(digest: bytes, path: bytes) -> tuple[str, str]:
    """The root that a leaf and its siblings give, and the digest of all siblings from the leaf upwards."""
    node, siblings, steps = digest.hex(), [], path.hex()
    for k in range(0, len(steps), 2 * STEP):
        other = steps[k + 2:k + 2 * STEP]
        side = steps[k + 1]
        if side != "0":
            siblings.append(other)
        node = hashlib.sha256((node if side == "0" else node + other if side == "1" else other + node).encode()).hexdigest()
    return node, hashlib.sha256("".join(siblings).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: every value with its length in bytes before it, null as a dash."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows(grp, ...)`` with ``rank`` from 0 in the group, in the given order, and the group's ``size``.

    Rows are dealt by ranges of group and order, so that a group of any size is spread; what the groups have in earlier
    ranges is summed over one row per range and group.
    """
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    held = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("grp")
    counts = held.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first"))
    counts = counts.withColumn("size", F.sum("_n").over(own)).select("grp", "_part", "_start", "size")
    return held.join(counts, ["grp", "_part"]).withColumn("rank", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def block_of(rank: str, height: int) -> Column:
    return F.shiftright(rank, height)


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of block trees over ``leaves(grp, rank, size, digest)``, from the leaves' level up to one block a group.

    Each has ``(grp, block, size, n, tree, root)``: ``size`` nodes of the group at that level, ``n`` of them in this block. The
    roots of a level's blocks are the leaves of the next. A task holds one block at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for grp, block, size, nodes in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "size", "nodes"))):
                digests = b"".join(node["digest"] for node in nodes)
                tree, root = grow(digests, tree_height(size, height))
                yield {"grp": [grp], "block": [block], "size": [size], "n": [len(nodes)], "tree": [tree], "root": [root]}

    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("tree", pa.binary()), ("root", pa.binary())])
    levels, nodes = [], leaves
    while True:
        held = nodes.groupBy("grp", block_of("rank", height).alias("block"), "size").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        levels.append(written(arrow_map(held, run, schema, "grp string, block long, size long, n long, tree binary, root binary"), "trees"))
        above = levels[-1].where(F.col("size") > 1 << height)
        if above.isEmpty():
            return levels
        nodes = above.select("grp", F.col("block").alias("rank"), F.ceil(F.col("size") / (1 << height)).alias("size"), F.col("root").alias("digest"))


def roots(levels: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``(grp, root)`` of every group, from the level where it has one block."""
    tops = [level.where(F.col("size") <= 1 << height).select("grp", "root") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def descend(levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest level's blocks with ``path``, the steps from the block's root upwards; ``above(grp, path)`` continues the groups' roots.

    Further columns of ``above``, all binary, stay with their group's blocks.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                inner = leaf_paths(row["tree"], n, tree_height(row["size"], height))
                yield {"grp": [row["grp"]] * n, "block": (row["block"] << height) + np.arange(n), "path": [steps.tobytes() + row["path"] for steps in inner], **{c: [row[c]] * n for c in carried}}

    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.binary()), *((c, pa.binary()) for c in carried)])
    sql = "grp string, block long, path binary" + "".join(f", {c} binary" for c in carried)
    inner = None
    for k, level in reversed(list(enumerate(levels))):
        placed = level.where(F.col("size") <= 1 << height).join(above, "grp")
        if inner is not None:
            placed = placed.unionByName(level.where(F.col("size") > 1 << height).join(inner, ["grp", "block"]))
        if k:
            inner = written(arrow_map(placed, run, schema, sql), "paths")
    return placed


@dataclass(frozen=True)
class Manifest:
    """Numbered leaves ``(grp, rank, size, doc_id, digest, ...)``, the groups' block trees, and those over the groups' roots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    height: int


def group_key(value: Column) -> Column:
    """A key that is never null and keeps the order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def make_manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """A manifest over ``leaves(grp, doc_id, digest, ...)``; further columns stay with the leaves.

    In a group leaves stand by doc_id (null first), those of equal doc_id by digest; repeated rows are leaves of their own.
    A lone last node of a run is hashed alone; a group with one leaf has that leaf as its root. No leaves give no rows.
    """
    placed = written(numbered(written(leaves, "leaves"), ["doc_id", "digest"]), "numbered")
    levels = build(placed, height)
    subroots = roots(levels, height).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"))
    ordered = written(numbered(subroots, ["name"]), "subroots")
    return Manifest(placed, levels, ordered, build(ordered, height), height)


def verify(manifest: Manifest, claim: str = "digest") -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf, digests as hex text.

    The leaf's ``claim`` column is folded with the siblings that the stored trees give. Siblings are read from the block of the
    leaf and carried down from the blocks above it, so no row moves more than its digests.
    """
    height = manifest.height
    top = descend(manifest.tops, manifest.subroots.select("grp", F.lit(b"").alias("path")).distinct(), height)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for size, block, n, tree, path in zip(*(batch.column(c).to_pylist() for c in ("size", "block", "n", "tree", "path"))):
                inner = leaf_paths(tree, n, tree_height(size, height))
                yield {"rank": (block << height) + np.arange(n), "path": [steps.tobytes() + path for steps in inner]}

    paths = arrow_map(top, spread, pa.schema([("rank", pa.int64()), ("path", pa.binary())]), "rank long, path binary")
    over = roots(manifest.tops, height).withColumnRenamed("root", "top_root")
    # One row for each group.
    above = manifest.subroots.join(over, "grp").join(paths, "rank").select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "top_root", "path")
    above = written(above, "above")
    blocks = descend(manifest.levels, above, height)
    claims = manifest.leaves.groupBy("grp", block_of("rank", height).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "digest", F.col(claim).alias("claim")))).alias("claims"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for size, n, tree, path, subroot, root, rows in zip(*(batch.column(c).to_pylist() for c in ("size", "n", "tree", "path", "subroot", "top_root", "claims"))):
                inner = leaf_paths(tree, n, tree_height(size, height))
                folded = [fold(row["claim"], steps.tobytes() + path) for row, steps in zip(rows, inner)]
                yield {
                    "doc_id": [row["doc_id"] for row in rows], "leaf": [row["digest"].hex() for row in rows], "subroot": [subroot.hex()] * n, "root": [root.hex()] * n,
                    "proof_sha256": [proof for _, proof in folded], "folded_root": [made for made, _ in folded], "verified": [made == root.hex() for made, _ in folded],
                }

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    id_type = manifest.leaves.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())])
    sql = f"doc_id {id_type}, " + ", ".join(f"{c} string" for c in names) + ", verified boolean"
    return arrow_map(blocks.join(claims, ["grp", "block"]), run, schema, sql)


def document_leaves(docs: DataFrame, changed: Column | None = None, columns: Sequence[str] = COLUMNS, group: str = "lang") -> DataFrame:
    """``(grp, doc_id, digest, present)`` of every row: ``present`` is the digest with n_chars one more where ``changed`` holds.

    Nulls in any column have a leaf as well; a null n_chars stays null. Other columns of ``docs`` take no part.
    """
    digest = leaf_digest([F.col(c) for c in columns])
    present = digest
    if changed is not None:
        present = F.when(F.coalesce(changed, F.lit(False)), leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])).otherwise(digest)
    return docs.select(group_key(F.col(group)).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), present.alias("present"))
