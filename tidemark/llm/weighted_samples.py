"""Document fingerprints by consistent weighted sampling of word shingles."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

WIDTH = 5
SAMPLES = 128
#: The bytes that separate words.
GAP = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 22
_LONG = 256
_BLOCK = 512
_SCALE = 1.0 / (1 << 32)
ROWS = (
    "part int, pos bigint, doc_id bigint, n_chars bigint, fp binary, edited_sha256 string, "
    "edited_fp binary, near_edited double, near_next double, text string"
)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=None)
def _constants(name: str, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers drawn under ``name``."""
    start = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _scrambled(steps + np.uint64(start)) | np.uint64(1)


_PAD = _constants("pad", 1)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    factor, more = _constants("word", 2)
    found = []
    at = 0
    while at < len(data):  # in pieces that end at white space; an endless word makes one longer
        cut = GAP.search(data, at + _PIECE)
        end = cut.start() if cut else len(data)
        padded = b" " + data[at:end] + bytes([32] * 8)
        at = end
        raw = np.frombuffer(padded, np.uint8)
        gap = (raw == 32) | ((raw - np.uint8(9)) < 5)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        eights = np.ndarray(len(raw) - 7, "<u8", padded, strides=(1,))
        h = (eights[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * more
        long = np.flatnonzero(sizes > 8)
        step = 8
        while len(long) and step < _LONG:
            part = eights[starts[long] + step] & _MASKS[np.minimum(sizes[long] - step, 8)]
            h[long] = _scrambled(h[long] * factor) + part
            step += 8
            long = long[sizes[long] > step]
        for i in long.tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]]))
        found.append(_scrambled(h * factor))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def weighted_shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words as 64-bit hashes, and how often each occurs.

    A-Z are lower-cased; words are what white space (space, tab to carriage
    return) separates. Both ends are padded with ``width - 1`` blanks, so that
    texts of fewer words have shingles too, and the ends count. A text without
    words has none.
    """
    words = _word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words, np.empty(0, np.int64)
    pad = np.repeat(_PAD, width - 1)
    padded = np.concatenate((pad, words, pad))
    n = len(padded) - width + 1
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(_constants("shingle", width)):
        total += padded[j : j + n] * factor
    return np.unique(_scrambled(total), return_counts=True)


@functools.lru_cache(maxsize=None)
def _factors(name: str, samples: int) -> np.ndarray:
    return (_constants(name, samples) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _uniform(terms: np.ndarray, name: str, samples: int) -> np.ndarray:
    """Uniform 32-bit numbers, a row per term and a column per sample."""
    y = terms[:, None] * _factors(name, samples)[None, :]
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    y ^= y >> np.uint32(13)
    y *= np.uint32(0x297A2D39)
    return y


def _exponential(u: np.ndarray) -> np.ndarray:
    return -np.log1p(-(u + 0.5) * _SCALE)


def consistent_samples(
    terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES
) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the hash of the chosen term and its level (improved consistent weighted sampling).

    Per term and sample, r and c are gamma(2) and b is uniform, all drawn from
    hashes of the two; level ``t = floor(log(weight) / r + b)`` and the term
    with the smallest ``c * exp(-r * (t - b + 1))`` is chosen. Two weighted sets
    choose the same (term, level) with the probability of their generalised
    Jaccard similarity.

    The three variables come from independent exponentials a, a' and w' as
    ``c = a + a'``, ``r = w + w'`` with ``w = log(c / a)``, and ``b = w' / r``,
    which have just these laws. Then the value to be minimised is
    ``a * exp(-r * t)``. For a weight of one t is 0 and the value is a, which
    grows with the hash it is drawn from: such terms (most shingles) are
    compared by that hash alone, and r and c are drawn for all others.
    """
    terms = terms.astype(np.uint32)
    one = weights == 1
    singles, others, heavy = terms[one], terms[~one], weights[~one].astype(np.float64)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(singles), _BLOCK):
        np.minimum(least, _uniform(singles[at : at + _BLOCK], "a", samples).min(axis=0), out=least)
    chosen, level = least, np.zeros(samples, np.int64)
    if not len(others):
        return chosen, level
    with np.errstate(divide="ignore"):
        value = np.log(_exponential(least)) if len(singles) else np.full(samples, np.inf)
    columns = np.arange(samples)
    for at in range(0, len(others), _BLOCK):
        part = others[at : at + _BLOCK]
        hashed = _uniform(part, "a", samples)
        a, more, rest = (
            _exponential(u)
            for u in (hashed, _uniform(part, "more", samples), _uniform(part, "rest", samples))
        )
        r = np.log1p(more / a) + rest
        t = np.floor((np.log(heavy[at : at + _BLOCK])[:, None] + rest) / r)
        score = np.log(a) - r * t
        best = score.argmin(axis=0)
        lower = score[best, columns] < value
        value = np.where(lower, score[best, columns], value)
        chosen = np.where(lower, hashed[best, columns], chosen)
        level = np.where(lower, t[best, columns].astype(np.int64), level)
    return chosen, level


def text_fingerprint(text: str | None, width: int = WIDTH, samples: int = SAMPLES) -> bytes:
    """One byte per sample, 1 to 255; all zero for a text without words. Null counts as empty."""
    terms, counts = weighted_shingles(text or "", width)
    if not len(terms):
        return bytes(samples)
    chosen, level = consistent_samples(terms, counts, samples)
    # The hash names the term within its sample: it is a bijection of the term.
    mixed = _scrambled(chosen.astype(np.uint64) * _constants("code", samples) + level.astype(np.uint64))
    return ((mixed >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated generalised Jaccard similarity: equal bytes, less those equal by chance."""
    same = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    return max(0.0, (same - 1 / 255) / (1 - 1 / 255))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _of_text(batches, width, samples):
    for batch in slices(batches):
        ids, texts = batch.columns
        marks = [text_fingerprint(t, width, samples) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.binary())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH, samples: int = SAMPLES) -> DataFrame:
    """``doc_id`` and fingerprint ``fp`` (binary) of every whole text. No shuffle.

    A null text counts as empty and has the fingerprint of a text without words.
    Equal texts have equal fingerprints. Other columns do not matter.
    """
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_of_text, width=width, samples=samples), "doc_id bigint, fp binary"
    )


def _compared(text: str, fp: bytes, following: str, following_fp: bytes, width, samples) -> tuple:
    """Digest and fingerprint of the edited text, and the likeness to it and to the next text."""
    changed = edited(text, following)
    changed_fp = text_fingerprint(changed, width, samples)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return digest, changed_fp, likeness(fp, changed_fp), likeness(fp, following_fp)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("pos", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("fp", pa.binary()),
        ("edited_sha256", pa.string()),
        ("edited_fp", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("text", pa.string()),
    ]
)


def _in_order(batches, width, samples):
    """Rows of one part, each compared with the next; the part's last row waits for another part."""
    from pyspark import TaskContext

    part, pos, last = TaskContext.get().partitionId(), 0, None
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            fp = text_fingerprint(text, width, samples)
            if last:
                edge = last[2] if last[0] == 0 else None
                found = _compared(*last[2:], text, fp, width, samples)
                rows.append((part, last[0], last[1], len(last[2]), last[3], *found, edge))
            last = (pos, doc_id, text, fp)
            pos += 1
        if rows:
            yield _batch(rows, _SCHEMA)
    if last:
        row = (part, last[0], last[1], len(last[2]), last[3], None, None, None, None, last[2])
        yield _batch([row], _SCHEMA)


def _across(batches, width, samples):
    """The last rows of the parts, each with the first row of the part that follows."""
    for batch in slices(batches, 64):
        rows = []
        for row in batch.to_pylist():
            found = _compared(
                row["text"], row["fp"], row["next_text"], row["next_fp"], width, samples
            )
            rows.append(
                (row["part"], row["pos"], row["doc_id"], row["n_chars"], row["fp"], *found, None)
            )
        yield _batch(rows, _SCHEMA)


def neighbour_likeness(docs: DataFrame, width: int = WIDTH, samples: int = SAMPLES) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's.

    One row per document: ``doc_id``, ``n_chars``, ``fp``, ``edited_sha256``,
    ``edited_fp``, ``near_edited``, ``near_next``. The next document is the one
    that follows in ascending ``doc_id`` (after the last, the first); the edited
    text is the text with its last quarter replaced from the next one.

    Texts are shuffled once, into ranges of ``doc_id``, and compared while they
    pass in order; only the first and last texts of the parts meet in a join.
    The result of that pass, 128 bytes a fingerprint, is kept in the shared folder.

    A null text counts as empty. Null ids come first. Rows that repeat an id, a
    third of the table even, are ordered and split by a hash of their text. A
    single document follows itself. Other columns do not matter. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    passed = stored(
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("tie"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc_nulls_first("text"))
        .select("doc_id", "text")
        .mapInArrow(functools.partial(_in_order, width=width, samples=samples), ROWS),
        "passed",
    )
    waiting = F.col("edited_sha256").isNull()
    firsts = passed.where("pos = 0").select(
        F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp")
    )
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = passed.where("pos = 0").select(
        "part", F.coalesce(F.lead("part").over(order), F.first("part").over(every)).alias("next")
    )
    joined = (
        passed.where(waiting)
        .select("part", "pos", "doc_id", "n_chars", "fp", "text")
        .join(follows, "part")
        .join(firsts, "next")
        .select("part", "pos", "doc_id", "n_chars", "fp", "text", "next_text", "next_fp")
    )
    ends = joined.mapInArrow(functools.partial(_across, width=width, samples=samples), ROWS)
    return (
        passed.where(~waiting)
        .unionByName(ends)
        .select(
            "doc_id", "n_chars", "fp", "edited_sha256", "edited_fp", "near_edited", "near_next"
        )
    )
