"""Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

The rows of a group, in the order of their ids, are the leaves of a tree in which every eight
neighbours hang below one node; the group roots, in the order of the groups, are the leaves of another such
tree. Trees are kept as aligned subtrees of four levels of edges (4,096 leaves), one table row each. A subtree
is stored in van Emde Boas order: cut at half its height, the upper part comes first and the lower parts follow,
each laid out the same way, so that a path from a leaf to the root touches few stretches of memory whatever their
length is. ``address`` gives the place of a node by arithmetic alone; it serves both
construction and the retrieval of siblings. The roots of subtrees are the leaves of the next layer.

A digest is the lower-case hexadecimal SHA-256 of its inputs one after the other, children as
hexadecimal text. No task sees more than one subtree, and the driver learns counts and the root only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import cut_lineage

# Children of a node.
FAN = 8
# Levels of edges in a stored subtree, and its leaves.
HEIGHT = 4
LEAVES = FAN**HEIGHT

PROOF = "array<struct<place:int,siblings:array<string>>>"
_LEVEL = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (0 is the root) in a tree of ``levels`` levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    below = FAN ** (depth - upper)
    inner = address(levels - upper, depth - upper, index % below)
    return tree_size(upper) + index // below * tree_size(levels - upper) + inner


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def edge_levels(n: int) -> int:
    """Levels of edges above ``n`` nodes of a tree inside one subtree: all of them if it is cut into several."""
    levels = 0
    while levels < HEIGHT and FAN**levels < n:
        levels += 1
    return levels


def build_subtree(leaves: Sequence[bytes], height: int) -> np.ndarray:
    """Digests of a subtree in van Emde Boas order; places of nodes that do not exist are empty.

    Every level is reduced ``height`` times, also where a single node is left in its run.
    """
    tree = np.zeros(tree_size(height + 1), "S64")
    count = len(leaves)
    tree[address(height + 1, height, np.arange(count))] = leaves
    for depth in range(height, 0, -1):
        nodes = tree[address(height + 1, depth, np.arange(count))].tolist()
        parents = [digest(b"".join(nodes[i : i + FAN])) for i in range(0, count, FAN)]
        count = len(parents)
        tree[address(height + 1, depth - 1, np.arange(count))] = parents
    return tree


def sibling_places(n: int, height: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For leaves ``at`` of a subtree with ``n`` leaves: place in the run, sibling addresses, and which of these exist.

    Shapes are (leaves, height) and twice (leaves, height, FAN); the lowest level comes first.
    """
    place = np.zeros((len(at), height), np.int32)
    where = np.zeros((len(at), height, FAN), np.int64)
    there = np.zeros((len(at), height, FAN), bool)
    index, count = at, n
    for level in range(height):
        run = index // FAN * FAN
        nodes = run[:, None] + np.arange(FAN)
        place[:, level] = index - run
        there[:, level] = (nodes < count) & (nodes != index[:, None])
        where[:, level] = address(height + 1, height - level, np.where(there[:, level], nodes, 0))
        index, count = index // FAN, -(-count // FAN)
    return place, where, there


def field_text(column: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row's values in the order given."""
    return F.sha2(F.concat(*map(field_text, columns)).cast("binary"), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest leads to with the siblings of a proof."""
    return F.aggregate(
        proof,
        leaf,
        lambda node, level: F.sha2(
            F.concat(
                F.array_join(F.slice(level["siblings"], F.lit(1), level["place"]), ""),
                node,
                F.array_join(F.slice(level["siblings"], level["place"] + 1, F.size(level["siblings"])), ""),
            ).cast("binary"),
            256,
        ),
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the lowest level up."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["siblings"])), "").cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """Trees of a dataset.

    ``rows`` are the rows as given, their ``columns`` numbered, with ``_g``, ``_pos`` and ``_n`` (group, place
    in it, its size); ``layers`` the subtrees of the groups from the leaves up, ``top`` those of the tree above them.
    """

    rows: DataFrame
    columns: list[str]
    layers: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    root: str


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_pos`` and ``_n``: place in the group ``_g`` by ``order``, and the size of the group.

    Ranges of ``(_g, *order)`` are sorted where they lie and counted by group; what came before a
    range is a running total over one row per range and group. No group has to fit in one task.
    """
    keys = ["_g", *order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits number the range, the lower 33 the row in it.
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_g", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy("_g")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "_g", "_range", "_first",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(group).alias("_n"),
    )
    found = placed.join(ranges, ["_g", "_range"])
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_pos"), "_n")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``(_g, _block, _n, root, tree)`` from nodes ``(_g, _pos, _n, node)``."""

    def build(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("_pos")
        n = ordered.column("_n")[0].as_py()
        tree = build_subtree(ordered.column("node").cast(pa.binary()).to_pylist(), edge_levels(n))
        return pa.table(
            {
                "_g": ordered.column("_g").slice(0, 1),
                "_block": ordered.column("_block").slice(0, 1),
                "_n": ordered.column("_n").slice(0, 1),
                "_m": pa.array([ordered.num_rows], pa.int32()),
                "root": pa.array([tree[0].decode()], pa.string()),
                "tree": pa.array([bytes.fromhex(tree.tobytes().replace(b"\0", b"0").decode())], pa.binary()),
            }
        )

    blocks = nodes.select("_g", F.expr(f"_pos div {LEAVES}").alias("_block"), "_pos", "_n", "node")
    return blocks.groupBy("_g", "_block").applyInArrow(
        build, "_g string, _block bigint, _n bigint, _m int, root string, tree binary"
    )


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of subtrees above ``nodes``, and ``(_g, root)`` of every group."""
    layers, roots = [], []
    while True:
        layer = cut_lineage(_subtrees(nodes))
        layers.append(layer)
        roots.append(layer.where(F.col("_n") <= LEAVES).select("_g", "root"))
        rest = layer.where(F.col("_n") > LEAVES)
        if rest.isEmpty():
            break
        nodes = rest.select(
            "_g", F.col("_block").alias("_pos"),
            F.expr(f"(_n + {LEAVES - 1}) div {LEAVES}").alias("_n"), F.col("root").alias("node"),
        )
    out = roots[0]
    for more in roots[1:]:
        out = out.union(more)
    return layers, out


def build_manifest(rows: DataFrame, *, id_col: str, group_col: str, leaf_col: str) -> Manifest:
    """Trees over the digests ``leaf_col`` of all rows, by group and ascending id.

    Null groups and null ids come first; groups compare by their bytes. Rows of one group with one id
    follow each other by their digests, so repeated rows are leaves like others. A null digest is an
    error. An empty table has no rows, no roots and the digest of nothing as its root.
    Shuffled are the columns of ``rows`` (select what you need), twice, and 32 bytes a node.
    """
    names = [f"_c{i}" for i in range(len(rows.columns))]
    hidden = rows.toDF(*names)
    at = {c: F.col(n) for c, n in zip(rows.columns, names)}
    # A null group sorts before all others, which start with a letter.
    group = F.coalesce(F.concat(F.lit("v"), at[group_col].cast("string")), F.lit("-"))
    leaf = F.when(at[leaf_col].isNull(), F.raise_error(F.lit("a row has no digest")).cast("string")).otherwise(at[leaf_col])
    known = hidden.withColumns({"_g": group, "_id": at[id_col], "_leaf": leaf})
    placed = cut_lineage(_positions(known, ["_id", "_leaf"]))
    layers, roots = _grow(placed.select("_g", "_pos", "_n", F.col("_leaf").alias("node")))
    roots = cut_lineage(roots)
    listed = _positions(roots.select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "root"), ["_name"])
    listed = cut_lineage(listed)
    top, whole = _grow(listed.select("_g", "_pos", "_n", F.col("root").alias("node")))
    last = whole.first()
    root = last["root"] if last else digest(b"").decode()
    return Manifest(placed.select(*names, "_g", "_pos", "_n"), rows.columns, layers, top, listed, root)


def _prove(members: DataFrame, layer: DataFrame, above: DataFrame) -> DataFrame:
    """``members`` with ``proof`` and ``subroot``.

    ``members`` have ``_g`` and ``_pos``, ``above`` has ``(_g, _block, proof, subroot)``: what lies above a subtree's root.
    """
    kept = members.columns
    schema = StructType([*members.schema.fields, *StructType.fromDDL(f"proof {PROOF}, subroot string").fields])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        n, tree = right.column("_m")[0].as_py(), right.column("tree")[0].as_py()
        upper = right.column("proof")[0].as_py() or []
        m, height = left.num_rows, edge_levels(right.column("_n")[0].as_py())
        place, where, there = sibling_places(n, height, left.column("_pos").to_numpy() % LEAVES)
        nodes = [tree[i : i + 32].hex() for i in range(0, len(tree), 32)]
        # Siblings further up are the same for all leaves of the subtree.
        counts = there.sum(axis=2, dtype=np.int64)
        for level in upper:
            first = len(nodes)
            nodes += level["siblings"]
            more = np.arange(first, len(nodes))
            wide = np.zeros((m, 1, FAN), np.int64)
            wide[:, 0, : len(more)] = more
            where = np.concatenate([where, wide], axis=1)
            there = np.concatenate([there, np.broadcast_to(np.arange(FAN) < len(more), (m, 1, FAN))], axis=1)
            counts = np.concatenate([counts, np.full((m, 1), len(more))], axis=1)
            place = np.concatenate([place, np.full((m, 1), level["place"], np.int32)], axis=1)
        levels = place.shape[1]
        siblings = pa.array(nodes, pa.string()).take(pa.array(where[there]))
        ends = np.concatenate([[0], np.cumsum(counts.ravel())]).astype(np.int32)
        structs = pa.StructArray.from_arrays(
            [pa.array(place.ravel(), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), siblings)],
            fields=list(_LEVEL),
        )
        proof = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * levels), structs)
        subroot = pa.array([right.column("subroot")[0].as_py()] * m, pa.string())
        out = left.select(kept).combine_chunks()
        return out.append_column("proof", proof).append_column("subroot", subroot)

    blocks = layer.select("_g", "_block", "_n", "_m", "tree").join(above, ["_g", "_block"])
    dealt = members.withColumn("_block", F.expr(f"_pos div {LEAVES}"))
    return dealt.groupBy("_g", "_block").cogroup(blocks.groupBy("_g", "_block")).applyInArrow(prove, schema)


def _descend(layers: list[DataFrame], tops: DataFrame, members: DataFrame) -> DataFrame:
    """Proofs of ``members`` (leaves) from ``tops``, ``(_g, proof, subroot)`` of the group roots."""
    above = None
    for k in range(len(layers) - 1, -1, -1):
        done = layers[k].where(F.col("_n") <= LEAVES).select("_g", "_block")
        here = done.join(tops, "_g").select("_g", "_block", "proof", "subroot")
        above = here if above is None else here.unionByName(above)
        if k == 0:
            return _prove(members, layers[0], above)
        nodes = layers[k - 1].where(F.col("_n") > LEAVES).select("_g", F.col("_block").alias("_pos"))
        found = _prove(nodes, layers[k], above)
        above = cut_lineage(found.select("_g", F.col("_pos").alias("_block"), "proof", "subroot"))
    raise ValueError("a tree has a layer at least")


def prove_rows(manifest: Manifest) -> DataFrame:
    """The rows of a manifest with ``proof``, ``subroot`` and ``root``.

    ``proof`` lists for each level, from the leaf to the root, the place in the run and the
    other nodes of the run, from left to right. ``fold_proof`` leads back to the root. Given columns
    with the new names are replaced.
    """
    empty = F.array().cast(PROOF)
    roots = manifest.roots
    start = roots.select("_g", "_n").distinct().select("_g", empty.alias("proof"), F.lit(None).cast("string").alias("subroot"))
    found = _descend(manifest.top, start, roots.select("_g", "_pos", "_name", F.col("root").alias("_root")))
    tops = cut_lineage(found.select(F.col("_name").alias("_g"), "proof", F.col("_root").alias("subroot")))
    proved = _descend(manifest.layers, tops, manifest.rows)
    new = ("proof", "subroot", "root")
    given = [F.col(f"_c{i}").alias(c) for i, c in enumerate(manifest.columns) if c not in new]
    return proved.select(*given, "proof", "subroot", F.lit(manifest.root).alias("root"))
