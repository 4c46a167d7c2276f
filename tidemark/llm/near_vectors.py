"""Near-duplicate vectors: spherical-cap filters from structured random product codes."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocked, local_roots, stored
from tidemark.llm.components import connected_components


def block_count(dims: int, blocks: int) -> int:
    """Blocks of a product code: fewer where they would have under 8 dimensions."""
    return max(1, min(blocks, dims // 8))


@functools.cache
def product_code(dims: int, codes: int, blocks: int, seed: int) -> tuple:
    """A random rotation and, for each of ``blocks`` blocks, ``codes`` random unit directions.

    A filter direction is one code per block, so ``codes ** blocks`` directions
    are spelled by ``codes * blocks`` vectors.
    """
    random = np.random.default_rng([seed, dims])
    turn = np.linalg.qr(random.normal(size=(dims, dims)))[0]
    parts = []
    for block in np.array_split(np.arange(dims), block_count(dims, blocks)):
        code = random.normal(size=(codes, len(block)))
        parts.append((block, code / np.linalg.norm(code, axis=1, keepdims=True)))
    return turn, parts


def threshold(dims: int, codes: int, blocks: int, wanted: float) -> float:
    """Sum of block products that a random unit vector exceeds for ``wanted`` filters."""
    blocks = block_count(dims, blocks)
    share = min(0.5, wanted / codes**blocks)
    return NormalDist().inv_cdf(1 - share) * math.sqrt(blocks / dims)


def decode(products: list[np.ndarray], least: float) -> np.ndarray:
    """All filters whose block products sum to ``least`` or more; else the best one.

    The products of each block are sorted, and partial sums are extended only
    by codes with which the best of the remaining blocks can still reach it.
    """
    orders = [np.argsort(-p) for p in products]
    sorted_ = [p[o] for p, o in zip(products, orders)]
    best = np.array([p[0] for p in sorted_])
    rest = np.append(np.cumsum(best[::-1])[::-1], 0.0)[1:]
    least = min(least, best.sum())
    sums, filters = np.zeros(1), np.zeros(1, np.int64)
    for values, order, after in zip(sorted_, orders, rest):
        need = least - after - sums
        count = np.searchsorted(-values, -need + 1e-12, "right")
        ends = np.cumsum(count)
        pick = np.arange(ends[-1]) - np.repeat(ends - count, count)
        sums = np.repeat(sums, count) + values[pick]
        filters = np.repeat(filters, count) * len(values) + order[pick]
    return np.sort(filters)


def _filters(batches, codes, blocks, wanted, seed):
    for batch in batches:
        lists, out = batch.column(1), []
        for i in range(batch.num_rows):
            vector = lists[i].values.to_numpy(zero_copy_only=False).astype(float)
            turn, parts = product_code(len(vector), codes, blocks, seed)
            turned = turn @ (vector / np.linalg.norm(vector))
            least = threshold(len(vector), codes, blocks, wanted)
            products = [code @ turned[block] for block, code in parts]
            found = decode(products, least)
            while len(found) < min(wanted / 2, codes):
                least -= 0.05 * math.sqrt(1 / len(vector))
                found = decode(products, least)
            out.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["node", "filters"]
        )


def _first_shared(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Least common entry of row pairs of padded filter lists (-1 and -2 pad)."""
    same = mine[:, :, None] == theirs[:, None, :]
    return np.where(same.any(axis=2), mine, np.iinfo(np.int64).max).min(axis=1)


def _pairs_of(start: int, side: np.ndarray, alone: bool, block: int = 512):
    """Index pairs of one task, as rectangles of at most ``block`` rows a side."""
    if alone:
        left = right = np.arange(start, start + len(side))
    else:
        left, right = start + np.flatnonzero(side == 0), start + np.flatnonzero(side == 1)
    for i in range(0, len(left), block):
        for j in range(i if alone else 0, len(right), block):
            yield left[i : i + block], right[j : j + block], alone and i == j


def _bundle_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links inside the filters of one bundle: sums of copies per node, and a spanning forest.

    A pair that meets in several filters counts in the least one it shares.
    """
    pdf = pdf.sort_values(["label", "dims", "filter", "i", "j"], ignore_index=True)
    task = pdf.groupby(["label", "dims", "filter", "i", "j"], sort=False).ngroup().to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    ends = np.append(starts[1:], len(pdf))
    node, copies = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
    current, side = pdf["filter"].to_numpy(np.int64), pdf["side"].to_numpy()
    alone = (pdf["i"] == pdf["j"]).to_numpy()
    width = max(map(len, pdf["filters"]))
    lists = np.full((len(pdf), width), -1, np.int64)
    for k, row in enumerate(pdf["filters"]):
        lists[k, : len(row)] = row
    names, place = np.unique(node, return_inverse=True)
    added, roots = np.zeros(len(names), np.int64), np.arange(len(names))

    def take(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal roots
        step = max(1, (1 << 22) // width**2)
        for at in range(0, len(left), step):
            a, b = left[at : at + step], right[at : at + step]
            own = _first_shared(lists[a], np.where(lists[b] < 0, -2, lists[b])) == current[a]
            a, b = a[own], b[own]
            np.add.at(added, place[a], copies[b])
            np.add.at(added, place[b], copies[a])
            roots = local_roots(len(names), roots[place[a]], roots[place[b]])[roots]

    by_dims = pdf["dims"].to_numpy()
    for dims in np.unique(by_dims):
        mine = np.flatnonzero(by_dims == dims)
        unit = np.zeros((len(pdf), dims))
        unit[mine] = np.stack(pdf["embedding"].iloc[mine]).astype(float)
        unit[mine] /= np.linalg.norm(unit[mine], axis=1, keepdims=True)
        small = 32
        # Small filters: all rows against the row k further on, for every k.
        for k in range(1, small):
            i = np.arange(len(pdf) - k)
            i = i[(task[i] == task[i + k]) & (by_dims[i] == dims)]
            i = i[(ends - starts)[task[i]] <= small]
            i = i[alone[i] | (side[i] != side[i + k])]
            near = np.einsum("ij,ij->i", unit[i], unit[i + k]) >= least
            take(i[near], i[near] + k)
        for s, e in zip(starts, ends):
            if e - s > small and by_dims[s] == dims:
                for left, right, same in _pairs_of(s, side[s:e], alone[s]):
                    near = unit[left] @ unit[right].T >= least
                    a, b = np.nonzero(np.triu(near, 1) if same else near)
                    take(left[a], right[b])
    hung = np.flatnonzero(roots != np.arange(len(names)))
    linked = np.flatnonzero(added)
    return pd.DataFrame(
        {
            "node": np.concatenate([names[linked], names[hung]]),
            "other": np.concatenate([np.full(len(linked), -1), names[roots[hung]]]),
            "added": np.concatenate([added[linked], np.zeros(len(hung), np.int64)]),
        }
    )


def _usable(vector: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    wanted: float = 32.0,
    codes: int = 256,
    blocks: int = 2,
    seed: int = 2,
    most: int = 2048,
    bundle: int = 8192,
) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``), one row per row of ``vectors``.

    Vectors of equal ``label`` (not null) and equal length link when their cosine
    in double precision is ``least`` or more. Exact copies are one node with a
    count. Each node is listed under the filter directions whose cap it lies in
    (``wanted`` on average out of ``codes ** blocks``; a vector with less than half of
    them takes a wider cap); nodes that
    share a filter are compared, a filter of more than ``most`` nodes in blocks.
    No pair leaves a task: per task, each node's number of linked vectors and a
    spanning forest of its links go on. A pair is missed only if it shares no
    filter; links below ``least`` are never made.

    Vectors that are null, empty or zero, have null or non-finite components or no label
    link with nothing: 0 links, their own component. A null ``vec_id`` takes
    part; ``component_id`` is null only if every id in the component is. Repeated
    rows count as separate vectors and share a component. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn(
        "usable", F.col("label").isNotNull() & _usable(F.col("embedding"))
    )
    key = ["label", "copy"]
    copy = F.sha2(F.col("embedding").cast("string"), 256)
    marked = stored(
        rows.select("vec_id", "label", "embedding", F.when(F.col("usable"), copy).alias("copy")),
        "vectors",
    )
    nodes = stored(
        marked.where(F.col("copy").isNotNull())
        .groupBy(*key)
        .agg(
            F.min("vec_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.first("embedding").alias("embedding"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "vector_nodes",
    )
    filters = nodes.select("node", "embedding").mapInArrow(
        functools.partial(_filters, codes=codes, blocks=blocks, wanted=wanted, seed=seed),
        "node bigint, filters array<int>",
    )
    listed = stored(filters, "filters")
    dims = nodes.select("node", "label", F.size("embedding").alias("dims"))
    entries = listed.select("node", F.explode("filters").alias("filter")).join(dims, "node")
    place = ["label", "dims", "filter"]
    bundles = max(1, math.ceil(nodes.count() * wanted / bundle))
    # Blocks are dealt on narrow rows; vectors join them once, on the way to their bundle.
    vector = nodes.select("node", "copies", "embedding").join(listed, "node")
    found = stored(
        blocked(entries, place, "node", most)
        .withColumn("bundle", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(bundles)))
        .join(vector, "node")
        .groupBy("bundle")
        .applyInPandas(
            lambda pdf: _bundle_links(pdf, least), "node bigint, other bigint, added bigint"
        ),
        "vector_links",
    )
    links = found.where("other < 0").groupBy("node").agg(F.sum("added").alias("added"))
    roots = connected_components(
        found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    ).select("node", "root")
    rooted = (
        nodes.select("node", *key, "least", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            *key,
            "least",
            (F.coalesce("added", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_copy = rooted.join(named, "root").select(*key, "n_links", "component_id")
    linked = marked.where(F.col("copy").isNotNull()).select("vec_id", *key).join(of_copy, key)
    single = marked.where(F.col("copy").isNull()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.select("vec_id", "n_links", "component_id").unionByName(single).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
