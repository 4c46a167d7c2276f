"""Fingerprints, manifest and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, clashing, no_docs, odd_docs, words
from tidemark.llm import merkle, queries, weighted_samples, whitening
from tidemark.llm.common import fold


# --- consistent weighted sampling


def plain_shingles(text):
    split = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in split]
    padded = [None] * 4 + low + [None] * 4
    counts = {}
    for i in range(len(padded) - 4 if low else 0):
        key = tuple(padded[i : i + 5])
        counts[key] = counts.get(key, 0) + 1
    return counts


def generalised_jaccard(a, b):
    both = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in both)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in both) / top if top else 1.0


@pytest.mark.parametrize("text", [" ".join(words(4, 200, 6)), "a", "A b\tC  d ÉE\x0b" * 40, "x" * 5000, "  ", ""])
def test_shingles_are_counted_like_a_plain_version(text):
    terms, counts = weighted_samples.weighted_shingles(text)
    assert sorted(counts.tolist()) == sorted(plain_shingles(text).values())
    assert len(set(terms.tolist())) == len(terms)


def test_pieces_do_not_change_the_hashes(monkeypatch):
    text = " ".join(words(5, 500)) + " " + "y" * 600 + " z"
    whole = weighted_samples.weighted_shingles(text)
    monkeypatch.setattr(weighted_samples, "_PIECE", 37)
    cut = weighted_samples.weighted_shingles(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


@pytest.mark.parametrize("n", [1, 3, 40, 1000])
@pytest.mark.parametrize("kind", ["counts", "reals", "ones"])
def test_collisions_are_generalised_jaccard(n, kind):
    draw, errors, spread = np.random.default_rng(n), [], []
    for _ in range(30):
        terms = draw.integers(0, 1 << 63, n).astype(np.uint64)
        pick = {
            "counts": lambda: draw.choice([1, 1, 2, 7, 300], n),
            "reals": lambda: draw.gamma(0.7, 1.0, n) + 0.01,
            "ones": lambda: np.ones(n, np.int64),
        }[kind]
        a, b = pick(), pick()
        here = draw.random(n) < 0.8
        a[0] = b[0] = 1
        b = np.where(here, a, b)
        keep = draw.random(n) < 0.9
        keep[0] = True
        b = np.where(keep, b, 0)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        x = weighted_samples.consistent_samples(terms, a, 512)
        y = weighted_samples.consistent_samples(terms[b > 0], b[b > 0], 512)
        errors.append(float(np.mean((x[0] == y[0]) & (x[1] == y[1]))) - want)
        spread.append(want * (1 - want) / 512)
    # Four standard errors of the mean, and of the width of single estimates.
    assert abs(np.mean(errors)) <= 4 * math.sqrt(np.mean(spread) / len(errors)) + 1e-9
    assert np.mean(np.square(errors)) <= 2 * np.mean(spread) + 1e-9


def plain_samples(terms, weights, samples):
    """Ioffe's form with c, r and b spelled out, for every term and sample."""
    u = [
        weighted_samples._exponential(weighted_samples._uniform(terms.astype(np.uint32), name, samples))
        for name in ("a", "more", "rest")
    ]
    c = u[0] + u[1]
    w = np.log(c / u[0])
    r = w + u[2]
    b = u[2] / r
    t = np.floor(np.log(weights)[:, None] / r + b)
    y = np.exp(r * (t - b))
    best = (c / (y * np.exp(r))).argmin(axis=0)
    return terms[best].astype(np.uint32), t[best, np.arange(samples)]


def test_samples_equal_the_published_form():
    draw = np.random.default_rng(3)
    terms = draw.integers(0, 1 << 63, 300).astype(np.uint64)
    weights = draw.choice([1, 1, 1, 2, 5, 40], 300)
    chosen, level = weighted_samples.consistent_samples(terms, weights, 256)
    want, levels = plain_samples(terms, weights.astype(float), 256)
    drawn = weighted_samples._uniform(want, "a", 256)
    assert chosen.tolist() == drawn[np.arange(256), np.arange(256)].tolist()
    assert level.tolist() == levels.astype(int).tolist()


def test_variables_have_their_laws():
    terms = np.random.default_rng(1).integers(0, 1 << 32, 4000).astype(np.uint32)
    a, more, rest = (
        weighted_samples._exponential(weighted_samples._uniform(terms, n, 64)).ravel()
        for n in ("a", "more", "rest")
    )
    c, w = a + more, np.log1p(more / a)
    r = w + rest
    b = rest / r
    for x in (c, r):  # gamma(2, 1)
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.05
    assert abs(b.mean() - 0.5) < 0.005 and abs(b.var() - 1 / 12) < 0.002
    assert max(abs(np.corrcoef([c, r, b])[np.triu_indices(3, 1)])) < 0.01


def plain_neighbours(rows):
    """(n_chars, digest of the edited text, similarity to it, to the next text) per row, in order."""
    out = []
    for (_, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        changed = (text[:-q] if q else text) + after[:q]
        s = plain_shingles(text)
        out.append(
            (
                len(text),
                hashlib.sha256(changed.encode()).hexdigest(),
                generalised_jaccard(s, plain_shingles(changed)),
                generalised_jaccard(s, plain_shingles(after)),
            )
        )
    return out


def test_document_fingerprints_against_a_plain_version(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_document_fingerprints"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = plain_neighbours([(r.doc_id, r.text) for r in docs])
    assert len(got) == len(docs)
    errors = []
    for row, (n, digest, changed, following) in zip(docs, want):
        r = got[row.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        errors += [abs(r.near_edited - changed), abs(r.near_next - following)]
        assert r.fingerprint == weighted_samples.text_fingerprint(row.text).hex()
    assert max(errors) < 0.2 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_odd_documents_and_hot_ids(spark):
    docs = odd_docs(spark)
    rows = weighted_samples.neighbour_likeness(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    marks = {r.doc_id: r for r in rows}
    for doc_id, text in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        assert len(marks[doc_id].fp) == 128
        by_text.setdefault(text or "", set()).add(bytes(marks[doc_id].fp))
    assert all(len(v) == 1 for v in by_text.values())
    assert marks[0].near_next == 1.0 and set(marks[1].fp) == {0}  # null, then empty
    assert weighted_samples.neighbour_likeness(no_docs(spark)).collect() == []
    alone = weighted_samples.neighbour_likeness(docs.where("doc_id = 100")).first()
    assert alone.near_next == 1.0
    # One id on most rows: rows follow each other by hash, each has one successor.
    hot = spark.range(300).select(
        F.when(F.col("id") < 250, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"),
        F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"),
    )
    rows = weighted_samples.neighbour_likeness(hot).collect()
    assert len(rows) == 300 and all(r.edited_sha256 for r in rows)
    assert len({bytes(r.fp) for r in rows}) == 300


# --- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return H(*(one(row[c]) for c in merkle.FIELDS))


def plain_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def plain_manifest(rows):
    """Multiset of (doc_id, leaf, subroot, root, proof, folded root)."""
    lower = str.maketrans(queries.UPPER, queries.LOWER)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, leaves = {}, {}
    for s in order:
        mine = [(plain_leaf(r), r) for r in by_source[s]]
        mine.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        leaves[s], trees[s] = mine, plain_levels([h for h, _ in mine])
    top = plain_levels([trees[s][-1][0] for s in order])
    out = []

    def climb(levels, i, node):
        steps = []
        for level in levels[:-1]:
            first = i - i % 16
            left, right = level[first:i], level[i + 1 : first + 16]
            steps += left + right
            node = H(*left, node, *right)
            i //= 16
        return steps, node

    for at, s in enumerate(order):
        for i, (leaf, r) in enumerate(leaves[s]):
            claim = leaf
            if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0:
                text = r["text"]
                claim = plain_leaf({**r, "text": text and text.translate(lower)})
            a, node = climb(trees[s], i, claim)
            b, node = climb(top, at, node)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], H(*a, *b), node))
    return out


def got_manifest(docs, levels=merkle.LEVELS):
    leaves = merkle.document_leaves(
        docs,
        {"text": F.translate("text", queries.UPPER, queries.LOWER)},
        fold(F.col("doc_id"), 5) == 0,
    )
    return merkle.verify_leaves(merkle.manifest(leaves, levels)).collect()


def same_manifest(docs, levels=merkle.LEVELS):
    got = got_manifest(docs, levels)
    want = plain_manifest([r.asDict() for r in docs.select(*merkle.FIELDS).collect()])
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    return got


def numbered_docs(spark, sizes):
    """Documents of sources of the given sizes."""
    rows, at = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((at * 7 % 100_003, f"Text {at} A", None, f"s{k:02}" if k else None, at))
            at += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 7])
def test_addresses_are_a_permutation_and_split_at_half_height(levels):
    slots = np.concatenate([merkle.address(levels, d, np.arange(16**d)) for d in range(levels)])
    assert sorted(slots.tolist()) == list(range(merkle.subtree_size(levels)))
    upper = levels // 2
    if upper:  # the upper part is a prefix, each lower subtree one stretch
        top = [merkle.address(levels, d, np.arange(16**d)) for d in range(upper)]
        assert max(map(np.max, top)) < merkle.subtree_size(upper)
        first = [merkle.address(levels, d, np.arange(16 ** (d - upper))) for d in range(upper, levels)]
        stretch = np.concatenate(first) - merkle.subtree_size(upper)
        assert sorted(stretch.tolist()) == list(range(merkle.subtree_size(levels - upper)))


def test_a_path_of_seven_levels_touches_few_stretches():
    """Slots on the way from a leaf to the root, in lines of 17 nodes, against rows by level."""
    leaf, levels = 9_123_456, 7
    way = [(d, leaf // 16 ** (levels - 1 - d)) for d in range(levels)]
    lines = {merkle.address(levels, d, i) // 17 for d, i in way}
    by_level = {(merkle.subtree_size(d) + i) // 17 for d, i in way}
    assert len(lines) < len(by_level)


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_manifest_equals_a_plain_version(spark, levels):
    same_manifest(numbered_docs(spark, [1, 16, 17, 256, 300, 2, 33]), levels)


def test_manifest_of_many_sources_and_of_one(spark):
    same_manifest(numbered_docs(spark, [1] * 40), 2)
    same_manifest(numbered_docs(spark, [1]))
    same_manifest(numbered_docs(spark, [0, 5000]), 2)


def test_manifest_of_odd_documents(spark):
    got = same_manifest(odd_docs(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source"))))
    assert {r.verified for r in got} == {True, False}
    assert got_manifest(no_docs(spark)) == []
    hot = numbered_docs(spark, [5, 60]).withColumn("doc_id", F.when(F.col("doc_id") > 50, 50).otherwise(F.col("doc_id")))
    same_manifest(clashing(hot))


def test_only_tampered_leaves_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op12_merkle_manifest"](spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    lower = str.maketrans(queries.UPPER, queries.LOWER)
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text[r.doc_id].translate(lower) != text[r.doc_id]
        assert r.verified == (not changed)
    assert 0 < sum(not r.verified for r in got) < len(got)


# --- whitening


def plain_whitening(vectors):
    """x, n * x - S and the exact covariance, in Python's integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    centred = [[n * row[j] - sums[j] for j in range(d)] for row in x]
    products = np.array(
        [[sum(r[i] * r[j] for r in centred) for j in range(d)] for i in range(d)], object
    )
    return n, centred, np.array([[float(v / n**3) for v in row] for row in products])


def check_whitening(rows, vectors, ids, components=32):
    n, centred, cov = plain_whitening(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    values = values[: min(components, int((values > values[0] * len(values) * np.finfo(float).eps).sum()))]
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    white = np.array([[got[i][k + 1].whitened for k in range(len(values))] for i in ids])
    for i, row in zip(ids, centred):
        assert len(got[i]) == len(values)
        assert {r.deviation for r in got[i].values()} == {sum(v * v for v in row)}
    one = got[ids[0]]
    for k, e in enumerate(values):
        assert one[k + 1].n == n
        assert math.isclose(one[k + 1].explained, e / np.trace(cov), rel_tol=1e-9)
    centred_white = white - white.mean(axis=0)
    error = np.abs(centred_white.T @ centred_white / n - np.eye(len(values))).max()
    assert error < 1e-8 and one[1].identity_error < 1e-8
    # Each component is the projection on an eigenvector of the covariance.
    axes = np.linalg.lstsq(np.array(centred, float) / n, white * np.sqrt(values), rcond=None)[0]
    assert np.abs(cov @ axes - axes * values).max() < 1e-6 * values[0]


def test_whitening_of_the_given_vectors(spark):
    rows = queries.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    given = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    good = [r for r in given if all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whitening(rows, [r.embedding for r in good], [r.vec_id for r in good])


@pytest.mark.parametrize("rows,top", [(1, 5), (63, 3), (64, 17), (65, 1), (700, 1000)])
def test_popcounts_give_exact_products(rows, top):
    x = np.random.default_rng(rows).integers(0, top, (rows, 5))
    x[:, 2] = 0
    bits = np.array([int(v).bit_length() for v in x.max(axis=0)])
    assert (whitening.cross_products(x, bits) == x.T @ x).all()
    wide = x * (1 << 40)
    bits = np.array([int(v).bit_length() for v in wide.max(axis=0)])
    assert (whitening.cross_products(wide, bits) == wide.astype(object).T @ wide.astype(object)).all()


def test_odd_vectors(spark):
    draw = np.random.default_rng(2)
    good = [[float(np.float32(c)) for c in v] for v in draw.normal(size=(90, 3))]
    good += good[:5]
    odd = [None, [], [1.0, None, 2.0], [math.nan] * 3, [math.inf, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 1) for i, v in enumerate(odd)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    df = df.repartition(5)
    fit = whitening.fit_whitening(df)
    assert fit.n == len(good)
    check_whitening(whitening.whiten(df, fit).collect(), good, list(range(len(good))))


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 0)], [(1, [0.5, 0.5], 0)] * 3, [(1, [], 0)]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.whiten(df, whitening.fit_whitening(df)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(20)], schema)
    rows = whitening.whiten(flat, whitening.fit_whitening(flat)).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-9


def test_long_chunks_and_tasks_agree(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i, [float(v) for v in np.random.default_rng(i).normal(size=4)], 0) for i in range(400)],
        "vec_id long, embedding array<float>, label int",
    )
    one, many = whitening.fit_whitening(df.coalesce(1)), whitening.fit_whitening(df.repartition(13))
    assert (np.abs(one.values - many.values) == 0).all()
