"""Language ID and language model: counts against plain versions, quality on held-out rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SF, no_docs, odd_docs
from helpers import words as some_words
from tidemark.llm import language, language_model, queries

LARGE = "/root/testdata/sf0.01"


def plain_trigrams(text):
    codes, seq = language._letter_codes(), [0]
    for char in text or "":
        code = int(codes[ord(char)])
        if code or seq[-1]:
            seq.append(code)
    if seq[-1]:
        seq.append(0)
    return Counter(tuple(seq[i : i + 3]) for i in range(len(seq) - 2) if seq[i + 1])


def test_trigrams():
    texts = ["", None, "A", "a1b", "1", "  x  ", "Ab c", "été--Été", "日本", "ab", "b"]
    owner, gram, count = language.trigram_counts(texts)
    n = language.CODES
    for i, text in enumerate(texts):
        own = owner == i
        got = {
            (int(g) // n**2, int(g) // n % n, int(g) % n): int(c)
            for g, c in zip(gram[own], count[own])
        }
        assert got == plain_trigrams(text), text


def test_bundle_is_the_sum_of_bound_vectors():
    owner, gram, count = language.trigram_counts(["the cat", "the the", ""])
    sums = language.bundle(owner, gram, count, 3, 64, 1)
    vectors = language.bind(gram, 64, 1)
    for k in range(3):
        own = owner == k
        assert np.allclose(sums[k], (vectors[own] * count[own][:, None]).sum(axis=0))
    assert set(np.unique(vectors)) == {-1.0, 1.0}


def test_language_query_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, LARGE, "documents").collect()}
    rows = queries.QUERIES["op9_language_id"](spark, LARGE).collect()
    assert {r.doc_id for r in rows} == truth.keys() and len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    profiles = language.fit_languages(docs)
    rows = language.predict_languages(docs, profiles).collect()
    assert len(rows) == docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {0, 1, 2, 3}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    assert language.keep_known(docs, profiles).count() == docs.count() - 4
    nothing = language.fit_languages(no_docs(spark))
    assert len(nothing) == 0
    assert {r.lang_pred for r in language.predict_languages(docs, nothing).collect()} == {"und"}
    assert language.keep_known(docs, nothing).count() == docs.count() - 4
    assert language.predict_languages(no_docs(spark), profiles).count() == 0
    one = language.fit_languages(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.predict_languages(docs, one).collect()} == {"und", "de"}


def test_long_texts_are_counted_a_few_at_a_time():
    draw = np.random.default_rng(3)
    letters = np.array(list("aeinrstuéß   .1"))
    texts = ["".join(draw.choice(letters, 9000)) for _ in range(900)] + ["", None, "1"]
    langs = [["de", "fr", "es"][i % 3] for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "lang": pa.array(langs)})
    few = batch.slice(0, 3)
    prototypes = np.array(next(iter(language._profiles([few], 64, 9))).column(1).to_pylist())
    names = ["de", "fr", "es"]
    tracemalloc.start()
    try:
        (sums,) = language._profiles([batch], 64, 9)
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), batch.column(0)], ["row", "text"])
        found = list(language._predict([rows], names, prototypes, 9, 10.0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6
    for lang, profile in zip(*(c.to_pylist() for c in sums.columns)):
        own = [t for t, name in zip(texts, langs) if name == lang]
        parts = [language.bundle(*language.trigram_counts([t]), 1, 64, 9)[0] for t in own]
        assert np.array_equal(profile, np.sum(parts, axis=0, dtype=float))
    got = [tuple(r.values()) for part in found for r in part.to_pylist()]
    assert [r[0] for r in got] == list(range(len(texts)))
    for k in (0, 400, 899, 900, 901, 902):
        pred, score = language.predict_texts([texts[k]], names, prototypes, 9, 10.0)
        assert got[k][1] == pred[0] and got[k][2] == pytest.approx(score[0])


def plain_base(texts, folds=10):
    """doc -> (held out, tokens, known, base score), and the number of training tokens."""

    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0

    counts = Counter()
    for doc_id, text in texts:
        if not held(doc_id):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    room = total + 0.1 * (distinct + 1)
    rows = []
    for doc_id, text in texts:
        own = tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / room) for t in own)
        rows.append((doc_id, held(doc_id), len(own), sum(counts[t] > 0 for t in own), total, score))
    return rows


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_model_query(spark):
    rows = queries.QUERIES["op4_lm_scoring"](spark, LARGE).collect()
    texts = [
        (r.doc_id, r.text) for r in queries.table(spark, LARGE, "documents").collect()
    ]
    for got, want in zip(by_key(map(tuple, rows)), by_key(plain_base(texts)), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9)
    held = [r for r in rows if r.held_out]
    per_token = [sum(r[k] for r in held) / sum(r.n_tokens for r in held) for k in ("score", "base_score")]
    assert per_token[0] > per_token[1] + 0.05


def test_model_odd_rows(spark):
    docs = odd_docs(spark)
    rows = language_model.score_texts(docs, buckets=1 << 8).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for got, want in zip(by_key(map(tuple, rows)), by_key(plain_base(texts)), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert language_model.score_texts(no_docs(spark)).count() == 0
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    untrained = language_model.score_texts(held).collect()
    assert untrained and all(math.isfinite(r.score) and r.train_tokens == 0 for r in untrained)


def test_model_is_a_distribution(spark):
    """After any history, all known words and one unknown word of each class sum to one."""
    docs = queries.table(spark, SF, "documents")
    blocks = language_model.word_blocks(docs, 10)
    lexicon = language_model.lexicon_rows(blocks)
    counts = lexicon.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    model = language_model.fit(blocks, counts, buckets=1 << 10)
    known = {bytes(r.word): r.c for r in counts.collect()}
    words = list(known)
    classes = model.classes(words)
    assert np.array_equal(
        np.bincount(classes, [known[w] for w in words], 256), model.class_counts
    )
    assert np.array_equal(np.bincount(classes, minlength=256), model.class_words)
    history = np.array([zlib.crc32(words[0]), zlib.crc32(words[1]), 0], np.uint32)
    features = language_model._features(history, np.array([True, False, False]))[:, 2:]
    every = np.arange(256)
    logs = language_model.class_log_probs(model, every, np.repeat(features, 256, axis=1))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    room = model.class_counts + 0.1 * (model.class_words + 1)
    inside = defaultdict(float)
    for word, k in zip(words, classes):
        inside[k] += (known[word] + 0.1) / room[k]
    assert all(inside[k] + 0.1 / room[k] == pytest.approx(1) for k in inside)


def block_of(monkeypatch, texts, folds=10):
    """The block of some texts and the lengths of all counts made for it."""
    made, count = [], np.bincount

    def counted(*args, **more):
        made.append(len(found := count(*args, **more)))
        return found

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(np, "bincount", counted)
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    (block,) = language_model._blocks([docs], folds, 1 << 30)
    return block, made


def test_a_block_counts_its_words_once(monkeypatch):
    """Not once for each of its documents, which took documents times distinct words."""
    texts = [None, "", *(f"w{k} w{k + 1} the THE x{k}" for k in range(1000))]
    block, made = block_of(monkeypatch, texts)
    words = language_model._unpack(block.column(5)[0].as_py()).split(language_model.SEPARATOR)
    want = Counter()
    for k, text in enumerate(texts):
        if not language_model.is_held(k, 10):
            want.update([*language_model.words_of(text), language_model.END])
    assert dict(zip(words, block.column(6)[0].as_py())) == {w: want[w] for w in words}
    assert sum(made) == len(words)


def plain_training(model, row, rate, step):
    """Adagrad as in ``_train``, with rows of classes and unbuffered sums."""
    weights, buckets, width = model.weights.copy(), model.weights.shape[1], language_model.WIDTH
    squares = np.full((2, buckets), 1e-2, np.float32)
    groups, inside = model.priors()
    classes, hashes, ids, sizes, first = language_model._block_arrays(row, model)
    mark = np.zeros(len(ids), bool)
    mark[first] = True
    use = np.repeat(~row["held"], sizes)
    features, target = language_model._features(hashes[ids], mark)[:, use], classes[ids][use]
    for at in range(0, len(target), step):
        k, f = target[at : at + step], features[:, at : at + step]
        g = k // width
        for level, group, prior, truth in ((0, None, groups, g), (1, g, inside[g], k % width)):
            rows = language_model._rows(f, buckets, group)
            share = np.exp(prior + weights[level][rows].sum(axis=0))
            share /= share.sum(axis=1, keepdims=True)
            total = np.zeros((buckets, width))
            for own in rows:
                np.add.at(total, own, np.eye(width)[truth] - share)
            squares[level] += (total**2).sum(axis=1)
            weights[level] += rate * total / np.sqrt(squares[level])[:, None]
    return weights


def test_training_takes_plain_steps_one_class_at_a_time(monkeypatch):
    texts = [" ".join(some_words(k, 40)) for k in range(60)]
    block, made = block_of(monkeypatch, texts)
    block = block.select(["held", "sizes", "ids", "words", "n"])
    (row,) = language_model._block_rows(block)
    count = dict(zip(row["words"], block.column(4)[0].as_py()))
    singles = {w: k for k, w in enumerate(sorted(count, key=count.get)[-language_model.SINGLES :])}
    model = language_model.Model(singles, np.zeros(256), np.zeros(256), np.zeros((2, 64, 16), np.float32))
    for k, w in zip(model.classes(row["words"]), row["words"]):
        model.class_counts[k] += count[w]
        model.class_words[k] += count[w] > 0
    model.weights += np.random.default_rng(1).normal(0, 0.1, model.weights.shape).astype(np.float32)
    before = model.weights.copy()
    made.clear()
    (change,) = language_model._train([block], model, 0.3, 512)
    got = np.concatenate([np.frombuffer(c, "<f2") for c in change.column(3).to_pylist()])
    want = (plain_training(model, row, 0.3, 512) - before).ravel()
    assert np.allclose(got, want, rtol=2e-3, atol=1e-4) and np.abs(want).max() > 0.1
    assert np.array_equal(model.weights, before)
    assert max(made) == 64
