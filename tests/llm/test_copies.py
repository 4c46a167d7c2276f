"""Duplicate operators and the pipeline against plain versions."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from helpers import DOCS, ODD_TEXTS, SF, clashing, least_reachable, no_docs, odd_docs
from tidemark.llm import exact, near_text, near_vectors, queries
from tidemark.llm.components import connected_components


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    nodes = sorted(prints)
    links = [
        (a, b)
        for a, b in itertools.combinations(nodes, 2)
        if (prints[a] ^ prints[b]).bit_count() <= radius
    ]
    return least_reachable(nodes, links)


def test_simhash_query(spark):
    rows = queries.QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (d, f"{prints[d]:016x}", want[d]) for d in texts
    }
    assert len(rows) == len(texts) and len(set(want.values())) < len(texts)


def test_simhash_odd_rows(spark):
    docs = odd_docs(spark)
    rows = near_text.simhash_near_dedup(docs).collect()
    assert len(rows) == docs.count()
    of_id = {d: c for d, _, c in rows if d is not None}
    prints = {
        r.doc_id: plain_fingerprint(r.text) for r in docs.collect() if r.doc_id is not None
    }
    assert of_id == plain_components(prints)
    nulls = spark.createDataFrame([(None, "a b c d e")] * 3, "doc_id long, text string")
    assert [tuple(r)[::2] for r in near_text.simhash_near_dedup(nulls).collect()] == [(None, None)] * 3
    assert near_text.simhash_near_dedup(no_docs(spark)).count() == 0


@pytest.mark.parametrize("most", [5, 4096])
def test_fingerprint_links_find_all_pairs(spark, most):
    draw = random.Random(4)
    points = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(8):
            points.add(centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) % 2**64)
    signed = {p - 2**64 if p >> 63 else p: p for p in points}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = near_text.fingerprint_links(fps, 4, most=most, bundle=64).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 64 for r in links)
    near = [
        (a, b)
        for a, b in itertools.combinations(signed, 2)
        if (signed[a] ^ signed[b]).bit_count() <= 4
    ]
    assert least_reachable(signed, [(r.a, r.b) for r in links]) == least_reachable(signed, near)


def test_bk_forest_searches_exactly():
    draw = np.random.default_rng(5)
    points = draw.integers(0, 1 << 12, 300, dtype=np.uint64)
    tree = draw.integers(0, 3, 300)
    asked, asked_tree = draw.integers(0, 1 << 12, 50, dtype=np.uint64), draw.integers(0, 5, 50)
    found = set()
    for q, p in near_text.BKForest(tree, points).search(asked_tree, asked, 2, block=7):
        found |= set(zip(q.tolist(), p.tolist()))
    assert found == {
        (q, p)
        for q in range(50)
        for p in range(300)
        if tree[p] == asked_tree[q] and int(asked[q] ^ points[p]).bit_count() <= 2
    }


def test_components(spark):
    draw = random.Random(6)
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 500 + i) for i in range(1, 80)]
    mixed = [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    links = chain + star + mixed + chain[:5] + [(7, 7)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for pair in links for x in pair}
    want = least_reachable(nodes, links)
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id is not null")
    spaced = [(400, "no  id\there"), (401, "noid here"), (402, "noidhere"), (399, "no id here ")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(spaced, "doc_id long, text string"))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    want = sorted(
        (d, min(g)[1], len(g), (n, d) == min(g)) for g in groups.values() for n, d in g
    )
    assert sorted(map(tuple, exact.exact_dedup(clashing(docs)).collect())) == want
    assert sorted(map(tuple, exact.exact_dedup(docs, prefix=1).collect())) == want


def test_exact_null_ids(spark):
    rows = [(None, "a b"), (5, "ab"), (None, "zz"), (None, "zz")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(None, None, 2, True), (5, None, 2, False), (None, None, 2, True), (None, None, 2, True)])
    )
    assert exact.exact_dedup(no_docs(spark)).count() == 0


def plain_vectors(rows, least=0.93):
    usable = {}
    for vec_id, vector, label in rows:
        fine = vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        if label is not None and fine:
            unit = np.array(vector, np.float32).astype(float)
            usable[vec_id] = (label, unit / np.linalg.norm(unit))
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(usable), 2)
        if usable[a][0] == usable[b][0]
        and len(usable[a][1]) == len(usable[b][1])
        and usable[a][1] @ usable[b][1] >= least
    ]
    roots = least_reachable([r[0] for r in rows], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((i, count[i], roots[i], roots[i] == i) for i, _, _ in rows)


def test_near_vectors(spark):
    draw = np.random.default_rng(7)
    rows, k = [], 0
    for group in range(12):
        centre = draw.normal(size=16)
        for _ in range(15):
            rows.append((k, (centre + draw.normal(size=16) * 0.12).tolist(), group % 3))
            k += 1
        rows += [(k + i, centre.tolist(), group % 3) for i in range(3)]
        rows += [(k + 3, (centre * 2.5).tolist(), group % 3), (k + 4, centre.tolist(), None)]
        k += 5
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(k + i, v, 1) for i, v in enumerate(odd * 2)]
    rows += [(k + 20, [1.0, 2.0], 1), (k + 21, [1.0, 2.1], 1), (k + 22, [-1.0], 1), (k + 23, [-3.0], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    want = plain_vectors(rows)
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, near_vectors.near_vectors(clashing(df)).collect())) == want
    small = near_vectors.near_vectors(df, most=4, bundle=50)
    assert sorted(map(tuple, small.collect())) == want
    assert near_vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    nulls = near_vectors.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1)] * 2, schema))
    assert [tuple(r) for r in nulls.collect()] == [(None, 1, None, True)] * 2


def test_vector_recall_on_the_largest_table(spark):
    df = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    got = sorted(map(tuple, near_vectors.near_vectors(df, 0.35).collect()))
    want = plain_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()], 0.35)
    assert sum(r[1] for r in got) <= sum(r[1] for r in want)
    exact_ = sorted(map(tuple, near_vectors.near_vectors(df).collect()))
    assert exact_ == plain_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents").collect()
    alive = [d for d in docs if re.search(r"[^\W\d_]", d.text or "")]
    groups = defaultdict(list)
    for d in alive:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d.text)].append((-len(d.text), d.doc_id))
    alive = [d for d in alive if (-len(d.text), d.doc_id) in {min(g) for g in groups.values()}]
    roots = plain_components({d.doc_id: plain_fingerprint(d.text) for d in alive})
    want = {d.doc_id for d in alive if roots[d.doc_id] == d.doc_id}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and len(want) < len(docs)
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in got)


def test_pipeline_stages_on_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "odd")
        assert docs.columns == odd_docs(spark).columns
    texts = [r.text for r in docs.collect()]
    assert None not in texts and "" not in texts and "...!!! 123" not in texts
    assert len(ODD_TEXTS) - 6 < len(texts) < odd_docs(spark).count() - 14
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(texts)
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
