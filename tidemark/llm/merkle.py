"""Merkle manifest of a dataset, in blocks laid out by van Emde Boas."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

ARITY = 16
#: Node levels in a block: 1 + 16 + 256 + 4096 nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WIDE = 32


def subtree_size(levels: int) -> int:
    """Nodes of a full subtree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index):
    """Slot of a node of a block in van Emde Boas order.

    ``index`` counts the nodes at ``depth`` below the block's root; it may be an
    array. A subtree of ``levels`` is split at half its height: the upper part
    comes first, then the lower subtrees from left to right, each split again.
    """
    at = index * 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        step = ARITY ** (depth - upper)
        at = at + subtree_size(upper) + (index // step) * subtree_size(lower)
        index, depth, levels = index % step, depth - upper, lower
    return at


@functools.lru_cache(maxsize=None)
def _slots(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY**depth))


def _height(n: int) -> int:
    """Levels of the smallest subtree that has ``n`` leaves."""
    levels = 1
    while ARITY ** (levels - 1) < n:
        levels += 1
    return levels


def _digest(*parts: bytes) -> bytes:
    """SHA-256 over the parts as hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def _widths(levels: int, n: int) -> list[int]:
    """Nodes at each depth of a block whose first ``n`` leaves exist."""
    return [-(-n // ARITY ** (levels - 1 - depth)) for depth in range(levels)]


def build_block(levels: int, leaves: Sequence[bytes]) -> bytes:
    """All nodes of a block, 32 bytes each, in van Emde Boas order; absent ones are zero."""
    nodes = np.zeros((subtree_size(levels), _WIDE), np.uint8)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        flat = np.frombuffer(b"".join(row), np.uint8).reshape(-1, _WIDE)
        nodes[_slots(levels, depth)[: len(row)]] = flat
        row = [_digest(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
    return nodes.tobytes()


class Block:
    """A stored block whose nodes are found by address."""

    def __init__(self, levels: int, n: int, nodes: bytes):
        self.levels, self.widths, self.nodes = levels, _widths(levels, n), nodes

    def row(self, depth: int) -> list[bytes]:
        """The nodes at ``depth``, left to right."""
        slots = _slots(self.levels, depth)[: self.widths[depth]]
        return [self.nodes[_WIDE * s : _WIDE * (s + 1)] for s in slots.tolist()]

    def siblings(self, depth: int, index: int) -> tuple[bytes, bytes]:
        """What stands left and right of a node in its run of 16."""
        first = index - index % ARITY
        slots = _slots(self.levels, depth)[first : min(first + ARITY, self.widths[depth])].tolist()
        run = [self.nodes[_WIDE * s : _WIDE * (s + 1)] for s in slots]
        return b"".join(run[: index - first]), b"".join(run[index - first + 1 :])

    def above(self, index: int) -> list[tuple[bytes, bytes]]:
        """Siblings of the ancestors of the ``index``-th run of leaves, upwards, without the root."""
        steps = []
        for depth in range(self.levels - 2, 0, -1):
            steps.append(self.siblings(depth, index))
            index //= ARITY
        return steps


def pack_path(steps: Sequence[tuple[bytes, bytes]]) -> bytes:
    """Steps upwards; each is the counts of its left and right siblings, then the siblings."""
    return b"".join(
        bytes([len(left) // _WIDE, len(right) // _WIDE]) + left + right for left, right in steps
    )


def unpack_path(path: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    while at < len(path):
        a = at + 2 + _WIDE * path[at]
        b = a + _WIDE * path[at + 1]
        steps.append((path[at + 2 : a], path[a:b]))
        at = b
    return steps


def fold_path(leaf: bytes, steps: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        leaf = _digest(left, leaf, right)
    return leaf


def field(value: Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(sized)


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def document_leaves(
    docs: DataFrame, claimed: dict[str, Column] | None = None, where: Column | None = None
) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, and ``claimed``: the leaf to be verified, null for ``leaf``.

    ``claimed`` replaces columns, as a tampered copy would, in the rows of
    ``where``. Null values are hashed as ``-``; other columns do not matter.
    """
    other = F.lit(None).cast("binary")
    if claimed:
        changed = leaf_hash([claimed.get(c, F.col(c)) for c in FIELDS])
        other = F.when(where, changed) if where is not None else changed
    leaf = leaf_hash([F.col(c) for c in FIELDS])
    return docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("claimed"))


def _numbered(batches):
    """Number the sources of a sorted part, and the rows of each."""
    from pyspark import TaskContext

    part, run, pos, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in slices(batches, 8192):
        runs, places = [], []
        for source in batch.column(0).to_pylist():
            if run < 0 or source != last:
                run, pos, last = run + 1, 0, source
            runs.append(run)
            places.append(pos)
            pos += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)),
                pa.array(runs, pa.int64()),
                pa.array(places, pa.int64()),
                *batch.columns,
            ],
            ["part", "run", "pos", *batch.schema.names],
        )


def ordered_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves with ``grp`` (rank of the source), ``pos`` (rank inside it) and ``total`` (its rows).

    Rows are cut into ranges of (source, ``doc_id``), so a hot source spreads
    over many parts. Only one row per part and source is tied together: parts
    in one window of a row per part, sources in windows of a row per part.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    rows = stored(
        leaves.select("source", "doc_id", "leaf", "claimed")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _numbered,
            "part int, run bigint, pos bigint, source string, doc_id bigint, leaf binary, "
            "claimed binary",
        ),
        "numbered",
    )
    runs = rows.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"), F.first("source").alias("source")
    )
    by_part = Window.orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts_ = runs.groupBy("part").agg(
        F.count(F.lit(1)).alias("runs"),
        F.min_by("source", "run").alias("first"),
        F.max_by("source", "run").alias("last"),
    )
    goes_on = F.lag("part").over(by_part).isNotNull() & F.col("first").eqNullSafe(
        F.lag("last").over(by_part)
    )
    bases = parts_.withColumn("__on", goes_on.cast("bigint")).select(
        "part",
        (F.coalesce(F.sum(F.col("runs") - F.col("__on")).over(before), F.lit(0)) - F.col("__on"))
        .alias("base"),
    )
    inside = Window.partitionBy("grp")
    earlier = inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        runs.join(bases, "part")
        .withColumn("grp", F.col("base") + F.col("run"))
        .select(
            "part",
            "run",
            "grp",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
            F.sum("n").over(inside).alias("total"),
        )
    )
    return rows.join(places, ["part", "run"]).select(
        "grp", (F.col("start") + F.col("pos")).alias("pos"), "total", "doc_id", "leaf", "claimed"
    )


_BLOCKS = (
    "grp bigint, block bigint, total bigint, levels int, nodes binary, root binary, "
    "ids array<bigint>, claims array<binary>"
)


def _blocks(batches, levels):
    """Blocks of rows that come sorted by (grp, pos); a block is held at a time."""
    capacity = ARITY ** (levels - 1)

    def block(key, total, rows):
        own = levels if total > capacity else _height(total)
        nodes = build_block(own, [r[0] for r in rows])
        return (*key, total, own, nodes, nodes[:_WIDE], [r[1] for r in rows], [r[2] for r in rows])

    schema = pa.schema(
        [
            ("grp", pa.int64()),
            ("block", pa.int64()),
            ("total", pa.int64()),
            ("levels", pa.int32()),
            ("nodes", pa.binary()),
            ("root", pa.binary()),
            ("ids", pa.list_(pa.int64())),
            ("claims", pa.list_(pa.binary())),
        ]
    )

    def out(done):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*done), schema)], schema=schema
        )

    key, total, rows, done, held = None, 0, [], [], 0
    for batch in slices(batches, 4096):
        for grp, number, n, leaf, ident, claim in zip(*(c.to_pylist() for c in batch.columns)):
            if (grp, number) != key:
                if rows:
                    done.append(block(key, total, rows))
                    held += len(rows)
                    if held >= 16_384:
                        yield out(done)
                        done, held = [], 0
                key, total, rows = (grp, number), n, []
            rows.append((leaf, ident, claim))
    if rows:
        done.append(block(key, total, rows))
    if done:
        yield out(done)


def tree_layers(rows: DataFrame, levels: int = LEVELS, name: str = "layer") -> list[DataFrame]:
    """Stored layers of blocks over ``grp``, ``pos``, ``total``, ``leaf``, ``doc_id``, ``claimed``.

    A block is an aligned subtree of ``levels`` node levels; the roots of a
    layer's blocks are the leaves of the next, until every group has one block.
    A block has at most ``16 ** (levels - 1)`` leaves, so no group of rows is
    ever larger, however many a source has. The number of layers grows with the
    logarithm of the rows; the driver sees whether another one is needed.
    """
    capacity = ARITY ** (levels - 1)
    layers = []
    while True:
        number = F.floor(F.col("pos") / capacity).cast("bigint")
        dealt = rows.withColumn("block", number).repartition("grp", "block")
        layer = stored(
            dealt.sortWithinPartitions("grp", "pos")
            .select("grp", "block", "total", "leaf", "doc_id", "claimed")
            .mapInArrow(functools.partial(_blocks, levels=levels), _BLOCKS),
            name,
        )
        layers.append(layer)
        more = layer.where(F.col("total") > capacity)
        if more.isEmpty():
            return layers
        rows = more.select(
            "grp",
            F.col("block").alias("pos"),
            F.ceil(F.col("total") / capacity).cast("bigint").alias("total"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.col("root").alias("leaf"),
            F.lit(None).cast("binary").alias("claimed"),
        )


@dataclass
class Manifest:
    """Blocks of the sources, of the tree over them, and the root (null without rows)."""

    sources: list[DataFrame]
    top: list[DataFrame]
    levels: int
    root: bytes | None


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """Merkle trees of 16 children, one per source, and one over their roots.

    ``leaves`` are the rows of ``document_leaves``. In each source leaves ascend
    by ``doc_id`` (null first; repeated ids by their hash); sources ascend, null
    first. Every run of 16 nodes (the last may be shorter) becomes the SHA-256
    of their hex texts while more than one is left. An empty table has no root.
    """
    sources = tree_layers(ordered_leaves(stored(leaves, "leaves")), levels, "source-blocks")
    capacity = ARITY ** (levels - 1)
    roots = functools.reduce(
        DataFrame.unionByName,
        [x.where(F.col("total") <= capacity).select("grp", "root") for x in sources],
    )
    top = tree_layers(
        roots.select(
            F.lit(0).cast("bigint").alias("grp"),
            F.col("grp").alias("pos"),
            F.lit(roots.count()).cast("bigint").alias("total"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.col("root").alias("leaf"),
            F.lit(None).cast("binary").alias("claimed"),
        ),
        levels,
        "top-blocks",
    )
    last = top[-1].select("root").first()
    return Manifest(sources, top, levels, bytes(last["root"]) if last else None)


def _leaf_paths(batches):
    """The path of every leaf of a block: its siblings there, then the block's own path."""
    for batch in slices(batches, 4):
        for row in batch.to_pylist():
            found = Block(row["levels"], len(row["ids"]), row["nodes"])
            leaves = found.row(row["levels"] - 1)
            first = row["block"] * row["capacity"]
            paths = []
            for i in range(len(leaves)):
                inner = []
                if row["levels"] > 1:
                    inner = [found.siblings(row["levels"] - 1, i), *found.above(i // ARITY)]
                paths.append(pack_path(inner) + row["path"])
            n = len(leaves)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["grp"]] * n, pa.int64()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array(leaves, pa.binary()),
                    pa.array(paths, pa.binary()),
                    pa.array([row["subroot"]] * n, pa.binary()),
                ],
                ["grp", "pos", "leaf", "path", "subroot"],
            )


_PATHS = "grp bigint, pos bigint, leaf binary, path binary, subroot binary"


def _placed(layer: DataFrame, paths: DataFrame, capacity: int) -> DataFrame:
    return layer.join(paths, ["grp", "block"]).withColumn("capacity", F.lit(capacity))


def block_paths(tree: Manifest) -> DataFrame:
    """The lowest blocks of the sources with the way from their root up to the manifest's.

    Layer by layer from the top, each block's leaves get their siblings by
    address; a leaf of a layer is the root of a block of the layer below.
    """
    capacity = ARITY ** (tree.levels - 1)

    def below(layer, paths, name):
        return stored(_placed(layer, paths, capacity).mapInArrow(_leaf_paths, _PATHS), name)

    paths = tree.top[-1].select(
        "grp",
        "block",
        F.lit(b"").alias("path"),
        F.lit(None).cast("binary").alias("subroot"),
    )
    for at, layer in enumerate(reversed(tree.top)):
        if at:
            paths = paths.select("grp", F.col("pos").alias("block"), "path", "subroot")
        paths = below(layer, paths, "top-paths")
    ways = paths.select(
        F.col("pos").alias("grp"),
        F.lit(0).cast("bigint").alias("block"),
        "path",
        F.col("leaf").alias("subroot"),
    )
    found = None
    for at, layer in enumerate(reversed(tree.sources)):
        whole = layer.where(F.col("total") <= capacity).select("grp", "block")
        own = ways.join(whole, ["grp", "block"], "left_semi")
        if found is not None:
            own = own.unionByName(
                found.select("grp", F.col("pos").alias("block"), "path", "subroot")
            )
        if at + 1 < len(tree.sources):
            found = below(layer, own, "source-paths")
    return _placed(tree.sources[0], own, capacity)


_PROOFS = (
    "doc_id bigint, leaf binary, subroot binary, proof_sha256 string, folded_root binary"
)


def _prove(batches):
    for batch in slices(batches, 1):
        for row in batch.to_pylist():
            ids, claims, levels = row["ids"], row["claims"], row["levels"]
            found = Block(levels, len(ids), row["nodes"])
            leaves = found.row(levels - 1)
            path = unpack_path(row["path"])
            proofs, folded = [], []
            for first in range(0, len(leaves), ARITY):
                run = leaves[first : first + ARITY]
                steps = path if levels == 1 else found.above(first // ARITY) + path
                upper = b"".join(a + b for a, b in steps)
                known: dict[bytes, bytes] = {}
                for j, leaf in enumerate(run):
                    left, right = b"".join(run[:j]), b"".join(run[j + 1 :])
                    proofs.append(hashlib.sha256((left + right + upper).hex().encode()).hexdigest())
                    node = leaf if claims[first + j] is None else claims[first + j]
                    if levels > 1:
                        node = _digest(left, node, right)
                    if node not in known:  # most leaves of a run lead to the same node
                        known[node] = fold_path(node, steps)
                    folded.append(known[node])
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(leaves, pa.binary()),
                    pa.array([row["subroot"]] * n, pa.binary()),
                    pa.array(proofs),
                    pa.array(folded, pa.binary()),
                ],
                ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )


def verify_leaves(tree: Manifest) -> DataFrame:
    """Every leaf's inclusion proof, and the root that its claimed leaf folds to.

    One row per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root`` (hex),
    ``proof_sha256`` (SHA-256 of the siblings, level by level upwards, left to
    right), ``folded_root`` and ``verified`` (whether that is the root). A null
    ``claimed`` stands for the leaf itself.
    """
    rows = block_paths(tree).mapInArrow(_prove, _PROOFS)
    root = F.lit(tree.root.hex() if tree.root else None).cast("string")
    folded = F.lower(F.hex("folded_root"))
    return rows.select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        "proof_sha256",
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )
