"""Hashed maximum-entropy language model with a class-factored soft-max."""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Classes are 16 groups of 16: the most frequent words are a class each in the
#: first 12 groups, all other words share the classes of the last 4 by their ending.
WIDTH = 16
SINGLES = 12 * WIDTH
SHARED = WIDTH * WIDTH - SINGLES
#: The end of a text, which no word can be, and what stands before a text.
END, BEGIN = b" ", 0x5BD1E995
BLOCKS = (
    "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, ids binary, "
    "words binary, n array<bigint>"
)
#: Between the words of a packed lexicon; no word holds it.
SEPARATOR = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held(doc_id, folds: int) -> bool:
    """Whether a document is held out of training; a null id counts as empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(batches, folds, block_bytes):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    lexicon: defaultdict = defaultdict()
    lexicon.default_factory = lexicon.__len__
    docs, size = [], 0

    def flush():
        nonlocal docs, size, number
        sizes = [len(i) for _, _, i in docs]
        ids = np.concatenate([i for _, _, i in docs])
        learn = np.repeat([not h for _, h, _ in docs], sizes)
        counts = np.bincount(ids[learn], minlength=len(lexicon))
        row = [
            [number],
            [[d for d, _, _ in docs]],
            [[h for _, h, _ in docs]],
            [sizes],
            [_pack(ids.astype("<i4").tobytes())],
            [_pack(SEPARATOR.join(lexicon))],
            [counts],
        ]
        number, docs, size = number + 1, [], 0
        lexicon.clear()
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()),
                 pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["block", "doc_ids", "held", "sizes", "ids", "words", "n"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)

    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            words.append(END)
            ids = np.fromiter(map(lexicon.__getitem__, words), np.int32, len(words))
            docs.append((doc_id, is_held(doc_id, folds), ids))
            size += len(text or "") + 1
            if size >= block_bytes:
                yield flush()
    if docs:
        yield flush()


def word_blocks(docs: DataFrame, folds: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """Texts as word numbers, in blocks of about ``block_bytes`` with a lexicon each.

    Per block: ids, held-out marks and sizes of its documents, their word
    numbers one after the other (each with an end), the words, and how often
    each occurs in training documents. Numbers and words are compressed. Written
    to the shared folder once; all later passes read it instead of the texts.
    """
    return stored(
        docs.select("doc_id", "text").mapInArrow(
            functools.partial(_blocks, folds=folds, block_bytes=block_bytes), BLOCKS
        ),
        "word_blocks",
    )


def _lexicon(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            words = _unpack(batch.column(1)[i].as_py()).split(SEPARATOR)
            counts = batch.column(2)[i].values
            block = batch.column(0)[i].as_py()
            for at in range(0, len(words), 65536):
                part = words[at : at + 65536]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), block)),
                        pa.array(np.arange(at, at + len(part), dtype=np.int32)),
                        pa.array(part, pa.binary()),
                        counts.slice(at, len(part)),
                    ],
                    ["block", "place", "word", "n"],
                )


def lexicon_rows(blocks: DataFrame) -> DataFrame:
    """(``block``, ``place``, ``word``, ``n``): the words of each block and their training counts."""
    return blocks.select("block", "words", "n").mapInArrow(
        _lexicon, "block bigint, place int, word binary, n bigint"
    )


def _ending(word: bytes) -> int:
    return SINGLES + zlib.crc32(word[-3:]) % SHARED


def _ending_class(word: Column) -> Column:
    return (F.crc32(F.substring(word, -3, 3)) % SHARED + SINGLES).cast("int")


@dataclass
class Model:
    """Weights and statistics; its size is fixed by the parameters, not by the data."""

    singles: dict[bytes, int]
    class_counts: np.ndarray  # training tokens of each class
    class_words: np.ndarray  # distinct training tokens of each class
    weights: np.ndarray  # (2, buckets, WIDTH): group, and class within the group

    @property
    def tokens(self) -> float:
        return float(self.class_counts.sum())

    @property
    def distinct(self) -> float:
        return float(self.class_words.sum())

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Log share of each group, and of each class within its group."""
        mass = (self.class_counts + 0.1).reshape(WIDTH, WIDTH)
        groups = mass.sum(axis=1)
        return (
            np.log(groups / groups.sum()).astype(np.float32),
            np.log(mass / groups[:, None]).astype(np.float32),
        )

    def classes(self, words: list[bytes]) -> np.ndarray:
        single = self.singles.get
        found = [single(w) for w in words]
        return np.array([_ending(w) if k is None else k for w, k in zip(words, found)], np.int64)


def _features(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature hashes (3, n) of each token: word before, word before that (a skip), both.

    ``first`` marks the first token of each text.
    """
    begin = np.uint32(BEGIN)
    one = np.concatenate(([begin], hashes[:-1])).astype(np.uint32)
    one[first] = begin
    two = np.concatenate(([begin], one[:-1])).astype(np.uint32)
    two[first] = begin
    skip = two * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
    both = (one * np.uint32(0xC2B2AE35)) ^ (two * np.uint32(0x9E3779B1)) ^ np.uint32(0x165667B1)
    return np.stack([one, skip, both])


def _rows(features: np.ndarray, buckets: int, group: np.ndarray | None = None) -> np.ndarray:
    """Weight rows of the features; with ``group``, of the features in that group."""
    mixed = features if group is None else features ^ (group.astype(np.uint32) + 1) * np.uint32(
        0x632BE5AB
    )
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int64)


def _logits(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logits (``WIDTH``, n) of weights that lie class by class, with the largest of a token at zero."""
    logits = weights.take(rows[0], axis=1)
    for row in rows[1:]:
        logits += weights.take(row, axis=1)
    logits += prior
    logits -= logits.max(axis=0)
    return logits


def _log_total(logits: np.ndarray) -> np.ndarray:
    """Log of the sum over the classes of each token, by halves."""
    total = np.exp(logits)
    total = total[: WIDTH // 2] + total[WIDTH // 2 :]
    while len(total) > 1:
        total = total[::2] + total[1::2]
    return np.log(total[0])


def _bucket_sums(rows: np.ndarray, slope: np.ndarray, buckets: int) -> np.ndarray:
    """Sums (``WIDTH``, buckets) of the slopes (``WIDTH``, n) over the tokens of each weight row.

    Class by class: the sums of one class stay in the processor's cache.
    """
    flat = rows.ravel()
    repeated = np.empty((len(slope), *rows.shape))
    repeated[:] = slope[:, None]
    total = np.empty((len(slope), buckets))
    for out, weights in zip(total, repeated):
        out[:] = np.bincount(flat, weights.ravel(), buckets)
    return total


def _block_arrays(row: dict, model: Model):
    """Word classes, word hashes, token word numbers and first-token marks of a block."""
    words = row["words"]
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    ids, sizes = row["ids"], row["sizes"]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    return model.classes(words), hashes, ids, sizes, first


def _class_major(arrays) -> tuple[np.ndarray, np.ndarray]:
    """Copies of the group's and the inner class's numbers, in one row per class."""
    return tuple(np.array(np.atleast_2d(a).T, order="C") for a in arrays)


def class_log_probs(model: Model, classes: np.ndarray, features: np.ndarray, step: int = 32768):
    """Natural log probability of each token's class after its history."""
    groups, inside = _class_major(model.priors())
    weights = _class_major(model.weights)
    buckets, out = model.weights.shape[1], np.empty(len(classes))
    for at in range(0, len(classes), step):
        k, f = classes[at : at + step], features[:, at : at + step]
        g = k // WIDTH
        n = np.arange(len(k))
        upper = _logits(weights[0], _rows(f, buckets), groups)
        lower = _logits(weights[1], _rows(f, buckets, g), inside.take(g, axis=1))
        upper, lower = upper[g, n] - _log_total(upper), lower[k % WIDTH, n] - _log_total(lower)
        out[at : at + step] = upper + lower
    return out


def _train(batches, model, rate, step):
    """One pass of Adagrad over the blocks of a task; gives the change of the weights."""
    from pyspark import TaskContext

    groups, inside = _class_major(model.priors())
    weights = _class_major(model.weights)
    buckets = model.weights.shape[1]
    squares = np.full((2, buckets), 1e-2, np.float32)
    seen = 0

    def descend(level: int, rows: np.ndarray, slope: np.ndarray) -> None:
        total = _bucket_sums(rows, slope, buckets)
        squares[level] += np.einsum("ij,ij->j", total, total)
        total *= rate
        total /= np.sqrt(squares[level])
        np.add(weights[level], total, out=weights[level], casting="same_kind")

    for batch in batches:
        for row in _block_rows(batch):
            classes, hashes, ids, sizes, first = _block_arrays(row, model)
            use = np.repeat(~row["held"], sizes)
            mark = np.zeros(len(ids), bool)
            mark[first] = True
            features = _features(hashes[ids], mark)[:, use]
            target = classes[ids][use]
            seen += len(target)
            for at in range(0, len(target), step):
                k, f = target[at : at + step], features[:, at : at + step]
                g, n = k // WIDTH, np.arange(len(k))
                for level, rows, prior, truth in (
                    (0, _rows(f, buckets), groups, g),
                    (1, _rows(f, buckets, g), inside.take(g, axis=1), k % WIDTH),
                ):
                    slope = _logits(weights[level], rows, prior)
                    slope -= _log_total(slope)
                    np.negative(np.exp(slope, out=slope), out=slope)
                    slope[truth, n] += 1
                    descend(level, rows, slope)
    change = (np.stack([w.T for w in weights]) - model.weights).reshape(WIDTH, -1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(WIDTH, TaskContext.get().partitionId()), pa.int64()),
            pa.array(np.arange(WIDTH), pa.int32()),
            pa.array(np.full(WIDTH, seen), pa.int64()),
            pa.array([c.astype("<f2").tobytes() for c in change], pa.binary()),
        ],
        ["task", "part", "seen", "change"],
    )


def _add_changes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean of the changes of some tasks, weighted by the tokens they saw."""
    total = np.zeros(len(pdf["change"].iloc[0]) // 2, np.float64)
    for change, seen in zip(pdf["change"], pdf["seen"]):
        total += np.frombuffer(change, "<f2").astype(np.float64) * seen
    seen = pdf["seen"].sum()
    return pd.DataFrame(
        {
            "task": [pdf["up"].iloc[0]],
            "part": [pdf["part"].iloc[0]],
            "seen": [seen],
            "change": [(total / max(1, seen)).astype("<f2").tobytes()],
        }
    )


CHANGES = "task bigint, part int, seen bigint, change binary"


def _block_rows(batch):
    """Rows of an Arrow batch of blocks, with arrays as numpy."""
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        row = {
            name: columns[name][i].values.to_numpy(zero_copy_only=False)
            for name in ("held", "sizes")
        }
        row["ids"] = np.frombuffer(_unpack(columns["ids"][i].as_py()), "<i4")
        row["words"] = _unpack(columns["words"][i].as_py()).split(SEPARATOR)
        if "doc_ids" in columns:
            row["doc_ids"] = columns["doc_ids"][i].as_py()
        if "found" in columns:
            found = columns["found"][i].values
            row["found"] = tuple(found.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield row


def fit(
    blocks: DataFrame,
    counts: DataFrame,
    buckets: int = 1 << 15,
    rounds: int = 1,
    rate: float = 0.3,
    step: int = 16384,
    fan_in: int = 32,
) -> Model:
    """Train on all training documents of the blocks.

    ``counts`` holds the training count ``c`` of every ``word``. Each round, every
    task takes gradient steps of ``step`` tokens over its own blocks from the
    round's weights; the changes, weighted by the tokens seen, are averaged by a
    tree of group-bys with ``fan_in`` tasks each. What reaches the driver is the
    model: ``2 * buckets * 16`` weights, the 192 most frequent words, and two
    numbers for each of 256 classes.
    """
    top = (
        counts.where("c > 0").orderBy(F.desc("c"), "word").limit(SINGLES).select("word").collect()
    )
    singles = {bytes(row["word"]): k for k, row in enumerate(top)}
    totals = (
        counts.where("c > 0")
        .groupBy(_ending_class(F.col("word")).alias("k"))
        .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
        .collect()
    )
    class_counts, class_words = np.zeros(WIDTH * WIDTH), np.zeros(WIDTH * WIDTH)
    for row in totals:
        class_counts[row["k"]], class_words[row["k"]] = row["c"], row["v"]
    own = counts.where(F.col("word").isin([F.lit(w) for w in singles])) if singles else None
    for row in own.collect() if own else []:
        word = bytes(row["word"])
        class_counts[_ending(word)] -= row["c"]
        class_words[_ending(word)] -= 1
        class_counts[singles[word]], class_words[singles[word]] = row["c"], 1
    model = Model(
        singles, class_counts, class_words, np.zeros((2, buckets, WIDTH), np.float32)
    )
    read = blocks.select("held", "sizes", "ids", "words")
    for _ in range(rounds):
        changes = read.mapInArrow(
            functools.partial(_train, model=model, rate=rate, step=step), CHANGES
        )
        tasks = read.rdd.getNumPartitions()
        while tasks > 1:
            tasks = math.ceil(tasks / fan_in)
            changes = (
                changes.withColumn("up", F.floor(F.col("task") / fan_in).cast("bigint"))
                .groupBy("up", "part")
                .applyInPandas(_add_changes, CHANGES)
            )
        rows = sorted(changes.collect(), key=lambda r: r["part"])
        if not rows or not rows[0]["seen"]:
            break
        change = np.concatenate([np.frombuffer(r["change"], "<f2") for r in rows])
        model.weights = model.weights + change.astype(np.float32).reshape(model.weights.shape)
    return model


def _score(batches, model):
    log10 = math.log(10)
    total = model.tokens + 0.1 * (model.distinct + 1)
    for batch in batches:
        for row in _block_rows(batch):
            classes, hashes, ids, sizes, first = _block_arrays(row, model)
            known = np.zeros(len(classes))
            place, found = row["found"]
            known[place] = found
            mark = np.zeros(len(ids), bool)
            mark[first] = True
            k, c = classes[ids], known[ids]
            base = np.log10((c + 0.1) / total)
            room = model.class_counts[k] + 0.1 * (model.class_words[k] + 1)
            within = np.where(k < SINGLES, 0.0, np.log((c + 0.1) / room))
            score = (class_log_probs(model, k, _features(hashes[ids], mark)) + within) / log10
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["held"].astype(bool), pa.bool_()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                    pa.array(np.full(n, int(model.tokens)), pa.int64()),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(score, first)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score_texts(
    docs: DataFrame, folds: int = 10, buckets: int = 1 << 15, rounds: int = 1, rate: float = 0.3
) -> DataFrame:
    """Log10 probability of every whole text under the model, and under word counts alone.

    Learns from documents whose ``crc32(doc_id as text) mod folds`` is not 0 and
    scores all. Tokens are words (A-Z lower-cased, split at ASCII white space) and
    one end per text. ``base_score`` smooths counts by 0.1; ``score`` is the
    model's: P(group | history) P(class | group, history) P(word | class), where
    the history is seen through hashed features (word before, word before that,
    both). An unknown word gets the share of one unseen word of its class.

    Counts cover all training documents: a lexicon row per block and word is
    joined to the word's total and returned to its block, so neither texts nor
    tokens are exploded. Documents never leave their block.

    A null text counts as empty: its one token is the end. Null ids are held
    out. Repeated rows count as often as they occur. Other columns are ignored.
    Without training documents, counts are zero and the score is finite.
    """
    blocks = word_blocks(docs, folds)
    lexicon = lexicon_rows(blocks)
    counts = stored(lexicon.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    model = fit(blocks, counts, buckets, rounds, rate)
    found = (
        lexicon.select("block", "place", "word")
        .join(counts, "word")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "c")).alias("found"))
    )
    empty = F.array().cast("array<struct<place:int,c:bigint>>")
    return (
        blocks.join(found, "block", "left")
        .select("doc_ids", "held", "sizes", "ids", "words", F.coalesce("found", empty).alias("found"))
        .mapInArrow(
            functools.partial(_score, model=model),
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
            "train_tokens bigint, base_score double, score double",
        )
    )
