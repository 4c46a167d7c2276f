"""Language identification with hyperdimensional letter profiles."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

#: Letter codes; code 0 is the gap between words. Letters beyond them share codes.
CODES = 1024
UNKNOWN = "und"
#: Rows and bytes of text that are counted at once, and trigrams whose vectors are held at
#: once. They bound memory and change no result.
ROWS, TEXT_BYTES, BLOCK = 1024, 1 << 19, 4096


@functools.cache
def _letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter, lower and upper case alike."""
    codes = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            codes[point] = (ord(char.lower()[0]) * 0x9E3779B1 & 0xFFFFFFFF) * (CODES - 1) >> 32
            codes[point] += 1
    return codes


@functools.cache
def _letter_vectors(dims: int, seed: int) -> tuple[np.ndarray, ...]:
    """Random +-1 vector of each code, permuted (rolled) by its place in the n-gram."""
    base = np.random.default_rng(seed).integers(0, 2, (CODES, dims), np.int8) * 2 - 1
    return tuple(np.roll(base, 2 - place, axis=1).astype(np.int8) for place in range(3))


def trigram_counts(
    texts: list[str | None], group: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, trigram, count) over the letters of the texts; each is its own group by default.

    Every run of other characters is one gap; a text starts and ends with a
    gap. Trigrams without a letter do not occur.
    """
    texts = [t or "" for t in texts]
    group = np.arange(len(texts)) if group is None else group
    points = np.frombuffer(
        ("  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), "<u4"
    )
    code = _letter_codes()[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    # A gap before each letter run, and one behind it: the gaps between two texts are two.
    letter = code != 0
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    code = code[at]
    first = np.concatenate(([0], code), dtype=code.dtype)  # the very first text may start with a letter
    at = np.concatenate(([0], at))
    doubled = np.concatenate(([False], (first[1:] == 0) & (first[:-1] == 0)))
    first, at = first[~doubled], at[~doubled]
    grams = (first[:-2] * CODES + first[1:-1]) * CODES + first[2:]
    owner = group[np.minimum(np.searchsorted(ends, at[1:-1], "right"), len(texts) - 1)]
    inner = first[1:-1] != 0
    key, count = np.unique(owner[inner].astype(np.int64) * CODES**3 + grams[inner], return_counts=True)
    return key // CODES**3, key % CODES**3, count


def bind(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Vector of each trigram: the product of its permuted letter vectors."""
    first, second, third = _letter_vectors(dims, seed)
    bound = first[grams // CODES**2] * second[grams // CODES % CODES]
    bound *= third[grams % CODES]
    return bound.astype(np.float32)


def bundle(
    group: np.ndarray, gram: np.ndarray, count: np.ndarray, groups: int, dims: int, seed: int
) -> np.ndarray:
    """Sum of the trigram vectors of each group, ``BLOCK`` distinct trigrams at a time."""
    sums = np.zeros((groups, dims), np.float32)
    distinct, place = np.unique(gram, return_inverse=True)
    weight = count.astype(np.float32)
    for at in range(0, len(distinct), BLOCK):
        bound = bind(distinct[at : at + BLOCK], dims, seed)
        part = np.flatnonzero((place >= at) & (place < at + BLOCK))
        own = group[part]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            rows = part[a:b]
            sums[own[a]] += weight[rows] @ bound[place[rows] - at]
    return sums


def _profiles(batches, dims, seed):
    """Bundle of all trigrams of each language in this task."""
    sums: dict[str, np.ndarray] = {}
    for batch in text_slices(batches, 0, ROWS, TEXT_BYTES):
        texts, langs = (c.to_pylist() for c in batch.columns)
        names, lang = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        total = bundle(*trigram_counts(texts, lang), len(names), dims, seed)
        for name, own in zip(names, total):
            sums[name] = sums.get(name, 0) + own.astype(float)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
        ["lang", "profile"],
    )


def fit_languages(docs: DataFrame, dims: int = 512, seed: int = 9) -> pd.DataFrame:
    """Prototype of each language: the bundle of all trigrams of its documents.

    Every row of ``docs`` with a ``lang`` counts, with its whole text. Tasks bundle
    what they read, so one vector per task and language is shuffled and one per
    language returned: the result is bounded by ``dims`` times the number of
    distinct ``lang`` values.
    """
    parts = (
        docs.where(F.col("lang").isNotNull())
        .select(F.coalesce("text", F.lit("")).alias("text"), "lang")
        .mapInArrow(
            functools.partial(_profiles, dims=dims, seed=seed), "lang string, profile array<double>"
        )
    )
    return (
        parts.select("lang", F.posexplode("profile").alias("dim", "value"))
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("profile"))
        .select("lang", F.col("profile.value").alias("profile"))
        .orderBy("lang")
        .toPandas()
    )


def _prototypes(profiles: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = profiles["lang"].tolist()
    return names, np.array(profiles["profile"].tolist(), float) if names else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def predict_texts(
    texts: list[str | None], names: list[str], prototypes: np.ndarray, seed: int, sharpness: float
) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    A text's vector bundles its trigrams. What all prototypes have in common is
    taken off both sides before cosines are compared; the score is the
    soft-max of ``sharpness`` times the cosines.
    """
    preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    owner, gram, count = trigram_counts(texts)
    if not len(names) or not len(owner):
        return preds, scores
    units = _unit(prototypes)
    middle = units.mean(axis=0) if len(names) > 1 else np.zeros(prototypes.shape[1])
    vectors = bundle(owner, gram, count, len(texts), prototypes.shape[1], seed)
    cosines = _unit(_unit(vectors) - middle) @ _unit(units - middle).T
    best = cosines.argmax(axis=1)
    sure = 1 / np.exp(sharpness * (cosines - cosines.max(axis=1, keepdims=True))).sum(axis=1)
    for k in np.unique(owner).tolist():
        preds[k], scores[k] = names[best[k]], sure[k]
    return preds, scores


def _predict(batches, names, prototypes, seed, sharpness):
    for batch in text_slices(batches, -1, ROWS, TEXT_BYTES):
        *keep, texts = batch.columns
        preds, scores = predict_texts(texts.to_pylist(), names, prototypes, seed, sharpness)
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(preds), pa.array(scores)], ["row", "lang_pred", "score"][-len(keep) - 2 :]
        )


def predict_languages(
    docs: DataFrame, profiles: pd.DataFrame, seed: int = 9, sharpness: float = 10.0
) -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``) of every row, from its whole text alone.

    ``lang_pred`` is ``und`` and the score 0 where the text is null or has no
    letter, or where nothing was learned. Equal cosines go to the language first
    in order. Ids may be null or repeat; other columns are ignored.
    """
    names, prototypes = _prototypes(profiles)
    return (
        docs.select("doc_id", "text")
        .mapInArrow(
            functools.partial(
                _predict, names=names, prototypes=prototypes, seed=seed, sharpness=sharpness
            ),
            "row bigint, lang_pred string, score double",
        )
        .withColumnRenamed("row", "doc_id")
    )


def keep_known(
    docs: DataFrame, profiles: pd.DataFrame, seed: int = 9, sharpness: float = 10.0
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language (not ``und``).

    Where nothing was learned, rows whose text has a letter stay.
    """
    names, prototypes = _prototypes(profiles)
    column = docs.columns.index("text")

    def kept(batches):
        for batch in text_slices(batches, column, ROWS, TEXT_BYTES):
            texts = batch.column(column).to_pylist()
            if names:
                preds, _ = predict_texts(texts, names, prototypes, seed, sharpness)
                keep = [p != UNKNOWN for p in preds]
            else:
                keep = np.isin(np.arange(len(texts)), trigram_counts(texts)[0]).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
