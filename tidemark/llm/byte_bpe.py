"""Byte-level BPE with a rank queue of hierarchical bitmaps."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.chunks import CUTS, RARE
from tidemark.llm.common import slices
from tidemark.llm.token_files import id_list

#: Ranks per word of the bitmap, and the bits of a word.
WORD = 256
BIT = [1 << k for k in range(WORD)]
#: Letters below it are letters in every version of Unicode.
PLAIN = "\u0250"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 and number per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines) if t}


class ByteBPE:
    """Encoder of one rank file and one pattern, with a bounded cache of chunks and pre-tokens."""

    def __init__(self, path: str, pattern: str, cache_chars: int = 12_000_000):
        self.ranks = ranks = read_ranks(path)
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = max(self.tokens) + 1
        #: (left id, right id) -> rank, for every way to cut a token into two tokens.
        self.pairs = {
            left * self.size + right: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None
            and (right := ranks.get(token[k:])) is not None
        }
        self.single = np.array([ranks[bytes((b,))] for b in range(256)])
        self.pattern = regex.compile(pattern)
        self.cache_chars, self.held = cache_chars, 0
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian unsigned 32-bit bytes.

        The parts of each pre-token form a linked list. Every pair of
        neighbours that is a token waits in a bucket under its rank. A bitmap of
        two levels marks the ranks that have a bucket: a bit of ``low`` is a
        rank, a bit of ``top`` a non-empty word of ``low``; the lowest set bit of
        either leads to the next rank. Its positions are merged left to right,
        and an entry whose pair has changed since is skipped. All pre-tokens
        given share one queue, so that a rank is found once for all of them. A
        pre-token of n bytes takes about n log n, however long it is.
        """
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, rank in zip(pieces, whole) if rank is None]
        merged = iter(self._merged(todo) if todo else ())
        return [
            next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole
        ]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n, size, pairs = len(ids), self.size, self.pairs.get
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[starts] = -1, -1
        linked = (ids[:-1] * size + ids[1:]).tolist()
        rank_of = np.array([*(pairs(key, -1) for key in linked), -1])
        rank_of[ends - 1] = -1
        buckets, low, top = self._buckets(rank_of)
        part, pair = ids.tolist(), rank_of.tolist()
        after, before = after.tolist(), before.tolist()
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                gone = after[i]
                j = after[i] = after[gone]
                part[i], part[gone], pair[gone] = rank, -1, -1
                made = joined = -1
                if j >= 0:
                    before[j] = i
                    made = pairs(rank * size + part[j], -1)
                pair[i] = made
                h = before[i]
                if h >= 0:
                    pair[h] = joined = pairs(part[h] * size + rank, -1)
                for new, k in ((made, i), (joined, h)):
                    if new < 0:
                        continue
                    held = buckets.get(new)
                    if held is not None:
                        held.append(k)
                    else:
                        buckets[new] = [k]
                        low[new >> 8] |= BIT[new & 255]
                        top |= BIT[new >> 8]
                if -1 < made < rank or -1 < joined < rank:
                    # A lower rank came up: it goes first, the rest of this bucket waits.
                    rest = bucket[at + 1 :]
                    if rest:
                        buckets[rank] = rest
                        low[rank >> 8] |= BIT[rank & 255]
                        top |= BIT[rank >> 8]
                    break
        left = np.array(part)
        lengths = np.add.reduceat(left >= 0, starts, dtype=np.int64)
        data = left[left >= 0].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(lengths)))).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _buckets(self, rank_of: np.ndarray) -> tuple[dict[int, list[int]], list[int], int]:
        """Positions by rank, and the bitmap over the ranks that occur."""
        order = np.argsort(rank_of, kind="stable")
        order = order[np.searchsorted(rank_of[order], 0) :]
        ranks, first = np.unique(rank_of[order], return_index=True)
        order = order.tolist()
        cuts = [*first.tolist(), len(order)]
        buckets, low, top = {}, [0] * (self.size // WORD + 1), 0
        for rank, a, b in zip(ranks.tolist(), cuts, cuts[1:]):
            buckets[rank] = order[a:b]
            low[rank >> 8] |= BIT[rank & 255]
            top |= BIT[rank >> 8]
        return buckets, low, top

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; a plain word is one, which the pattern need not tell."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha() and (word.isascii() or max(word) < PLAIN):
            return [chunk]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of chunks; pre-tokens that are not known yet go through one queue."""
        split = {c: self._split(c) for c in chunks}
        words = self.words
        fresh = list(set().union(*split.values()).difference(words))
        words.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        self.held += sum(map(len, fresh)) + sum(map(len, split))
        return {
            c: words[w[0]] if len(w) == 1 else b"".join(map(words.__getitem__, w))
            for c, w in split.items()
        }

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes; null counts as empty."""
        texts = [t or "" for t in texts]
        if self.held > self.cache_chars:
            self.known, self.words, self.held = {}, {}, 0
        cut = [CUTS["kept"].findall(t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        odd = {c for c in fresh if RARE.search(c)}
        self.known.update(self._learn(fresh - odd))
        find = self.known.__getitem__
        return [
            self._learn([t])[t] if odd and not odd.isdisjoint(c) else b"".join(map(find, c))
            for t, c in zip(texts, cut)
        ]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens named by ``ids``."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of this worker process, with its cache."""
    return ByteBPE(path, pattern)


def _encode(batches, path, pattern):
    for batch in slices(batches, 1024):
        ids, texts = batch.columns
        codes = coder(path, pattern).encode(texts.to_pylist())
        yield pa.RecordBatch.from_arrays([ids, id_list(codes)], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(``doc_id``, ``ids``): BPE ids of every whole text, without special tokens.

    The text is split by ``pattern``, each match merged by the ranks of the file
    ``ranks``. A null text counts as empty and has no ids. Every row gives one
    row; ids of documents may be null or repeat; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_encode, path=ranks, pattern=pattern), "doc_id bigint, ids array<int>"
    )


def _decode(batches, path, pattern):
    for batch in slices(batches, 1024):
        doc_ids, lists = batch.columns
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().astype("<u4", copy=False)
        texts = [
            coder(path, pattern).decode(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])
        ]
        yield pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(texts, pa.binary())], ["doc_id", "bytes"]
        )


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(``doc_id``, ``bytes``) of the rows of ``encode_documents``."""
    return encoded.select("doc_id", "ids").mapInArrow(
        functools.partial(_decode, path=ranks, pattern=pattern), "doc_id bigint, bytes binary"
    )


def _digests(batches, path, pattern):
    for batch in slices(batches, 1024):
        doc_ids, texts = batch.columns
        bpe = coder(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for ids in bpe.encode(texts.to_pylist()):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text, in one pass.

    The same as ``encode_documents`` and ``decode_documents``, without carrying
    the ids from one task to another.
    """
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_digests, path=ranks, pattern=pattern),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
