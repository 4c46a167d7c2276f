"""Whitening of embeddings from exact, bit-sliced cross-products."""

from __future__ import annotations

import functools
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Entries at or beyond this do not become a long and count as not finite.
_MOST = float(1 << 56)
_SAFE = (1 << 62) - 1
_DECIMAL = pa.decimal128(38, 0)


def integer_vectors(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable rows of a list column: their positions, lengths, and entries ``floor(64 c) + 1000000``, flat.

    A row is usable unless it is null or holds null or non-finite entries.
    """
    n = len(vectors)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    inner = vectors.values.slice(lo, hi - lo)
    values = inner.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < _MOST)
    bad |= np.asarray(inner.is_null().to_numpy(zero_copy_only=False), bool)
    sizes = np.diff(offsets)
    faults = np.concatenate(([0], np.cumsum(bad)))
    here = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool)
    usable = here & (faults[offsets[1:] - lo] == faults[offsets[:-1] - lo])
    entries = scaled[np.repeat(usable, sizes)] if n else scaled
    return np.flatnonzero(usable), sizes[usable], entries.astype(np.int64) + OFFSET


def _matrices(batches, dims: int, rows: int):
    """(ids, matrix) of the usable vectors with ``dims`` entries."""
    for batch in slices(batches, rows):
        at, sizes, flat = integer_vectors(batch.column(1))
        fits = sizes == dims
        if fits.any():
            ids = batch.column(0).take(pa.array(at[fits]))
            yield ids, flat[np.repeat(fits, sizes)].reshape(-1, dims)


def _ranges(batches):
    """Rows, least, largest and sum per length and dimension."""
    seen: dict[int, list] = defaultdict(list)
    for batch in slices(batches, 4096):
        _, sizes, flat = integer_vectors(batch.column(0))
        for size in np.unique(sizes[sizes > 0]).tolist():
            x = flat[np.repeat(sizes == size, sizes)].reshape(-1, size)
            sums = np.array([int(v) for v in x.sum(axis=0)], object)
            if size in seen:
                n, lo, hi, total = seen[size]
                seen[size] = [
                    n + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)), total + sums,
                ]
            else:
                seen[size] = [len(x), x.min(0), x.max(0), sums]
    for size, (n, lo, hi, total) in seen.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, size, np.int32)),
                pa.array(np.arange(size, dtype=np.int32)),
                pa.array(np.full(size, n, np.int64)),
                pa.array(lo),
                pa.array(hi),
                pa.array(total.tolist(), _DECIMAL),
            ],
            ["dims", "dim", "n", "lo", "hi", "total"],
        )


def bit_planes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bits of non-negative columns across rows, 64 rows a word: one row of words per (column, bit)."""
    n, dims = x.shape
    planes = np.zeros((int(bits.sum()), -(-n // 64) * 8), np.uint8)
    at = 0
    for d in range(dims):
        for p in range(int(bits[d])):
            packed = np.packbits(((x[:, d] >> p) & 1).astype(np.uint8))
            planes[at, : len(packed)] = packed
            at += 1
    return planes.view(np.uint64)


def cross_products(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns of a non-negative matrix.

    Each pair of bit planes contributes the number of rows that have both bits,
    weighted by the two places.
    """
    dims = x.shape[1]
    planes = bit_planes(x, bits)
    column = np.repeat(np.arange(dims), bits)
    place = np.concatenate([np.arange(b) for b in bits]).astype(np.int64)
    wide = 2 * int(bits.max(initial=0)) + len(x).bit_length() >= 62
    kind = object if wide else np.int64
    out = np.zeros((dims, dims), kind)
    weight = np.array([1 << int(p) for p in place], kind)
    for i in range(len(planes)):
        both = np.bitwise_count(planes[i:] & planes[i]).sum(axis=1, dtype=np.int64)
        np.add.at(out[column[i]], column[i:], both.astype(kind) * weight[i:] * weight[i])
        if i + 1 < len(planes):  # the mirrored pairs
            np.add.at(out[:, column[i]], column[i + 1 :], both[1:].astype(kind) * weight[i + 1 :] * weight[i])
    return out


def _chunk(dims: int) -> int:
    """Rows that are sliced at once: a multiple of 64, some 4 million entries."""
    return max(64, min(1 << 16, (1 << 22) // max(dims, 1)) // 64 * 64)


def _scatter(batches, lo, bits):
    """Sums of products of shifted columns, a row per pair of dimensions."""
    dims = len(lo)
    total, held, rows = np.zeros((dims, dims), object), [], 0

    def add():
        return total + cross_products(np.concatenate(held), bits).astype(object)

    for _, x in _matrices(batches, dims, _chunk(dims)):
        held.append(x - lo)
        rows += len(x)
        if rows >= _chunk(dims):
            total = add()
            held, rows = [], 0
    if held:
        total = add()
    a, b = np.triu_indices(dims)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i.astype(np.int32)),
                pa.array(j.astype(np.int32)),
                pa.array([int(v) for v in total[i, j]], _DECIMAL),
            ],
            ["a", "b", "v"],
        )


@dataclass
class Whitening:
    """What the fit found; it grows with the dimensions only."""

    n: int
    dims: int
    least: np.ndarray
    sums: np.ndarray  # of the entries less ``least``
    largest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """``n * x - sum``, exact."""
    reach = fit.n * int((fit.largest - fit.least).max(initial=0))
    kind = np.int64 if reach <= _SAFE else object
    sums = np.array([int(v) for v in fit.sums], kind)
    return (x - fit.least).astype(kind) * fit.n - sums


def _projected(centred: np.ndarray, fit: Whitening) -> np.ndarray:
    return (centred / fit.n).astype(np.float64) @ fit.vectors / np.sqrt(fit.values)


def _moments(batches, fit: Whitening, mean: np.ndarray | None):
    """Sums of whitened rows, or of their products after ``mean`` is taken off."""
    k = len(fit.values)
    total = np.zeros((k, 1 if mean is None else k))
    for _, x in _matrices(batches, fit.dims, 4096):
        w = _projected(_centred(x, fit), fit)
        if mean is None:
            total += w.sum(axis=0)[:, None]
        else:
            w = w - mean
            total += w.T @ w
    a, b = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays(
        [pa.array(a.ravel().astype(np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(total.ravel())],
        ["a", "b", "v"],
    )


def _summed(rows: DataFrame, fit: Whitening, mean: np.ndarray | None = None) -> np.ndarray:
    found = (
        rows.mapInArrow(functools.partial(_moments, fit=fit, mean=mean), "a int, b int, v double")
        .groupBy("a", "b")
        .agg(F.sum("v").alias("v"))
    )
    out = np.zeros((len(fit.values), 1 if mean is None else len(fit.values)))
    for r in found.collect():
        out[r["a"], r["b"]] = r["v"]
    return out


def fit_whitening(
    vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding"
) -> Whitening | None:
    """Eigenvectors of the exact covariance of all usable vectors; None if there are none.

    Entries c become integers ``floor(64 c) + 1000000``. One pass finds the
    range and sum of each dimension. The second shifts each dimension by its
    least entry, packs its bits across rows into words, and adds up weighted
    popcounts of ANDed planes: exact sums of products, merged as decimals of a
    row per pair of dimensions. ``n * sum(ab) - sum(a) * sum(b)`` is an exact
    integer too; only then is it divided by n squared and handed to ``eigh``.

    All vectors have the length of the longest; a shorter one counts as having
    null entries, and drops out. Directions without variance (below rounding)
    are no components. Two more passes measure ``identity_error``, the largest
    difference between the covariance of the whitened rows and the identity.
    The driver holds a table of dimensions by dimensions, whatever the rows.
    """
    only = vectors.select(embedding)
    ranges = stored(
        only.mapInArrow(
            _ranges, "dims int, dim int, n bigint, lo bigint, hi bigint, total decimal(38,0)"
        )
        .groupBy("dims", "dim")
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("total").alias("total"),
        ),
        "ranges",
    )
    dims = ranges.agg(F.max("dims")).first()[0]
    if dims is None:
        return None
    rows = ranges.where(F.col("dims") == dims).orderBy("dim").collect()
    n = rows[0]["n"]
    lo, hi = (np.array([r[c] for r in rows], np.int64) for c in ("lo", "hi"))
    sums = np.array([int(r["total"]) - n * r["lo"] for r in rows], object)
    bits = np.array([int(v).bit_length() for v in hi - lo])
    pairs = (
        only.select(F.lit(0).alias("id"), embedding)
        .mapInArrow(functools.partial(_scatter, lo=lo, bits=bits), "a int, b int, v decimal(38,0)")
        .groupBy("a", "b")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    covariance = np.zeros((dims, dims))
    for r in pairs:
        exact = n * int(r["v"]) - sums[r["a"]] * sums[r["b"]]
        covariance[r["a"], r["b"]] = covariance[r["b"], r["a"]] = exact / (n * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = values > max(values[0], 0.0) * dims * np.finfo(float).eps
    kept &= np.arange(dims) < components
    fit = Whitening(
        n, dims, lo, sums, hi, values[kept], axes[:, kept], values[kept] / np.trace(covariance)
        if kept.any() else values[kept],
    )
    if kept.any():
        each = only.select(F.lit(0).alias("id"), embedding)
        mean = _summed(each, fit)[:, 0] / n
        spread = _summed(each, fit, mean) / n
        fit.identity_error = float(np.abs(spread - np.eye(len(fit.values))).max())
    return fit


def _whitened(batches, fit: Whitening):
    k = len(fit.values)
    numbers = np.arange(1, k + 1, dtype=np.int32)
    reach = fit.n * int((fit.largest - fit.least).max(initial=0))
    short = reach * reach * fit.dims <= _SAFE
    for ids, x in _matrices(batches, fit.dims, 1024):
        centred = _centred(x, fit)
        if short:
            deviation = (centred * centred).sum(axis=1)
        else:  # beyond a long: null
            exact = (int(sum(int(v) * int(v) for v in row)) for row in centred)
            deviation = np.array([v if v < 1 << 63 else None for v in exact], object)
        m = len(x)
        each = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(each)),
                pa.array(np.tile(numbers, m)),
                pa.array(np.full(m * k, fit.n, np.int64)),
                pa.array(deviation.tolist(), pa.int64()).take(pa.array(each)),
                pa.array(_projected(centred, fit).ravel()),
                pa.array(np.tile(fit.explained, m)),
                pa.array(np.full(m * k, fit.identity_error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


_ROWS = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)


def whiten(vectors: DataFrame, fit: Whitening | None, embedding: str = "embedding") -> DataFrame:
    """Rows of (``vec_id``, ``component``) with the whitened value, for every usable vector.

    ``deviation`` is the sum over dimensions of ``(n * x - sum)^2``, null where
    it is no long. Vectors that are null, hold null or non-finite entries, or
    are shorter than the fit's have no rows. Rows that repeat an id or a vector
    each have their own; a null id stays null. Other columns do not matter.
    Without a fit, or without variance, there are no rows.
    """
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], _ROWS)
    return vectors.select("vec_id", embedding).mapInArrow(
        functools.partial(_whitened, fit=fit), _ROWS
    )
