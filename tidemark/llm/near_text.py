"""Near-duplicate texts: SimHash fingerprints, linked through BK-trees."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocked, local_roots, stored
from tidemark.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> bytes:
    """SimHash of a text over its word shingles, as 8 big-endian bytes.

    A-Z are lower-cased, words end at ASCII white space. A text with fewer
    words is one shingle; a text without words has fingerprint zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return bytes(8)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    cuts = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())
    digests = b"".join([xxhash.xxh64_digest(whole[s:e], seed) for s, e in cuts])
    votes = np.zeros(BITS, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, n, 65536):
        votes += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > n).tobytes()


def _fingerprints(batches, words, seed):
    for batch in batches:
        ids, texts = batch.columns
        bits = b"".join(fingerprint(t, words, seed) for t in texts.to_pylist())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], ["doc_id", "fp"]
        )


class BKForest:
    """BK-trees of several shards, held in arrays and built level by level.

    In each tree the first point of a shard is the root, and every node keeps
    its children by their integer Hamming distance to it. ``tree`` names the
    shard of each point.
    """

    def __init__(self, tree: np.ndarray, points: np.ndarray):
        self.points = points
        order = np.argsort(tree, kind="stable")
        group, members = tree[order], order
        _, first = np.unique(group, return_index=True)
        self.trees, self.roots = group[first], members[first]
        edges, children = [], []
        while len(members):
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            node = np.repeat(members[starts], np.diff(np.append(starts, len(members))))
            rest = np.ones(len(members), bool)
            rest[starts] = False
            members, node = members[rest], node[rest]
            away = np.bitwise_count(points[members] ^ points[node]).astype(np.int64)
            group = node * (BITS + 1) + away
            order = np.argsort(group, kind="stable")
            group, members = group[order], members[order]
            if len(group):
                lead = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                edges.append(group[lead])
                children.append(members[lead])
        edges = np.concatenate(edges) if edges else np.empty(0, np.int64)
        children = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def search(self, tree: np.ndarray, points: np.ndarray, radius: int, block: int = 4096):
        """Yield (query, point) index arrays of all points within ``radius``.

        Only edges whose distance differs from the query's by at most
        ``radius`` are followed; queries go through in blocks.
        """
        place = np.searchsorted(self.trees, tree)
        known = np.flatnonzero(
            (place < len(self.trees))
            & (self.trees[np.minimum(place, len(self.trees) - 1)] == tree)
        )
        for at in range(0, len(known), block):
            query = known[at : at + block]
            node = self.roots[place[query]]
            while len(query):
                away = np.bitwise_count(points[query] ^ self.points[node]).astype(np.int64)
                near = away <= radius
                if near.any():
                    yield query[near], node[near]
                base = node * (BITS + 1)
                low = np.searchsorted(self.edges, base + np.maximum(away - radius, 0), "left")
                high = np.searchsorted(self.edges, base + np.minimum(away + radius, BITS), "right")
                width = high - low
                ends = np.cumsum(width)
                within = np.arange(ends[-1]) - np.repeat(ends - width, width)
                node = self.children[np.repeat(low, width) + within]
                query = np.repeat(query, width)


def _shard_links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of the shards in one bundle, thinned to one spanning forest per shard."""
    tree = pdf.groupby(["shard", "i", "j"], sort=False).ngroup().to_numpy()
    fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    held = (pdf["side"] == 0).to_numpy()
    asks = ((pdf["side"] == 1) | (pdf["i"] == pdf["j"])).to_numpy()
    held, asks = np.flatnonzero(held), np.flatnonzero(asks)
    if not len(held) or not len(asks):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    forest = BKForest(tree[held], fps[held])
    root = np.arange(len(fps))
    for q, p in forest.search(tree[asks], fps[asks], radius):
        q, p = root[asks[q]], root[held[p]]
        root = local_roots(len(fps), q, p)[root]
    signed = fps.view(np.int64)
    hung = np.flatnonzero(root != np.arange(len(fps)))
    return pd.DataFrame({"a": signed[hung], "b": signed[root[hung]]})


def _bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``radius + 1`` bands: near fingerprints agree on one of them."""
    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def fingerprint_links(fps: DataFrame, radius: int, most: int = 4096, bundle: int = 16384):
    """Links (``a``, ``b``) that connect all fingerprints ``fp`` within ``radius`` bits.

    Fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
    bands, so the shards are the fingerprints that share a band, and no link is
    lost. A BK-tree is built per shard and asked by the shard's fingerprints; a
    shard of more than ``most`` is cut into blocks, and every pair of blocks is
    one tree and its queries. The trees travel with their queries instead of
    being broadcast, as their number grows with the corpus. Small shards are
    handled together in bundles of about ``bundle`` rows.
    """
    shards = F.array(
        *[
            F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
            + F.lit(k << BITS // 2)
            for k, (start, width) in enumerate(_bands(radius))
        ]
    )
    rows = blocked(fps.select("fp", F.explode(shards).alias("shard")), ["shard"], "fp", most)
    bundles = max(1, math.ceil(fps.count() * (radius + 1) / bundle))
    return (
        rows.withColumn("bundle", F.pmod(F.xxhash64("shard", "i", "j"), F.lit(bundles)))
        .groupBy("bundle")
        .applyInPandas(
            lambda pdf: _shard_links(pdf, radius), "a bigint, b bigint"
        )
    )


def simhash_near_dedup(
    docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42
) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``), one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable through links of
    fingerprints that differ in at most ``radius`` bits. Texts are read whole;
    only (id, fingerprint) is shuffled, and equal fingerprints meet once.

    Null and empty texts have fingerprint zero and link like any other. A row
    with a null ``doc_id`` takes part; ``component_id`` is null only if every id
    in the component is. Repeated rows each give a row. Other columns are
    ignored. An empty table gives an empty result.
    """
    prints = stored(
        docs.select("doc_id", "text").mapInArrow(
            functools.partial(_fingerprints, words=words, seed=seed), "doc_id bigint, fp bigint"
        ),
        "fingerprints",
    )
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stored(rooted.join(named, "root").select("fp", "component_id"), "of_print")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> Column:
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
