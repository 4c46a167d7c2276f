"""Whole texts to token ids with a tokenizer file, chunk by chunk."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a text may be cut before a tokenizer without changing its ids.
#: Byte-level patterns break before a blank that follows a word; patterns that
#: drop white space break at every blank.
CUTS = {"kept": re.compile(r"[ \n]*[^ \n]+|[ \n]+"), "dropped": re.compile(r"[^ \n]+")}
CACHE_CHARS = {"kept": 9_000_000, "dropped": 9_000_000}
#: Where a tokenizer that splits runs of letters, digits and other signs always cuts a
#: chunk, by signs that every version of Unicode classes alike (and that stay one letter in lower case,
#: so no U+0130). Chunks are joined by a mark that none of them holds; marks are matches of their own.
#: A byte-level pattern takes a blank with what follows it, and the other white space before by itself;
#: what begins with an apostrophe is left whole.
_LETTER, _SIGN = "a-zß-öø-įı-ɏÀ-ÖØ-Þ", r"!-/:-@\[-`{-~"
_LETTERS, _SIGNS = f"[{_LETTER}]+", r"[!-&(-/:-@\[-`{-~]+"
_CASED = f"[A-Z{_LETTER}]+"
MARK = {"kept": "\r", "dropped": "\n"}
FINE = {
    "kept": re.compile(
        rf"[ \n]+(?=\r|\Z)|[ \n]+(?=[ \n])|\n| ?{_CASED}(?=[0-9{_SIGN}\r]|\Z)"
        rf"| ?[0-9]+(?=[A-Za-z{_SIGN}\r]|\Z)| ?{_SIGNS}(?=[A-Za-z0-9\r]|\Z)|[^\r]+|\r"
    ),
    "dropped": re.compile(
        rf"{_LETTERS}(?=[0-9{_SIGN}\n]|\Z)|[0-9]+(?=[a-z{_SIGN}\n]|\Z)|{_SIGNS}(?=[a-z0-9\n]|\Z)|[^\n]+|\n"
    ),
}
#: Pieces that are one word each to such a tokenizer.
WORD = {
    "kept": re.compile(f" ?(?:{_CASED}|[0-9]+|{_SIGNS})"),
    "dropped": re.compile(f"{_LETTERS}|{_SIGNS}"),
}
#: Words that go through the tokenizer as one text.
LINE_WORDS = {"kept": 16, "dropped": 256}
#: White space besides blank and line feed, by any version of Unicode; a text with it goes through whole.
RARE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is cut where the tokenizer itself always cuts, and each distinct
    chunk is encoded once while it stays in the cache. A new chunk is put
    together from its words and signs, which more chunks share; chunks are
    numbered, and their ids lie one after another in ``codes``. The cache is
    emptied when its keys exceed ``cache_chars`` characters; this bounds memory
    and changes no result.
    """

    def __init__(self, path: str, blanks: str, cache_chars: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.guard, self.mark = blanks == "kept", MARK[blanks]
        self.fine, self.word, self.line = FINE[blanks].findall, WORD[blanks].fullmatch, LINE_WORDS[blanks]
        self.cache_chars = cache_chars or CACHE_CHARS[blanks]
        self._empty()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab() if suffix and not self.guard else {}
        self.closes = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if self.guard and len(feed) == 1 else None

    def _empty(self) -> None:
        self.held, self.known = 0, {self.mark: 0}
        self.codes, self.ends = array("I"), array("q", [0, 0])

    def _ids(self, texts: list[str]) -> list[array]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", code.ids) for code in encoded]

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number new ``chunks``, whose ids lie one after another in ``ids``."""
        at = len(self.ends) - 1
        self.known.update(zip(chunks, range(at, at + len(chunks))))
        self.held += sum(map(len, chunks))
        self.ends.frombytes((self.ends[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self.codes.frombytes(ids.astype(np.uint32, copy=False).tobytes())

    def _add_pieces(self, pieces: list[str]) -> None:
        """Number new pieces: words many at a time, told apart by line feeds or the tokens that end a word."""
        many = self.feed is not None or len(self.closes)
        words = [p for p in pieces if self.word(p)] if many else []
        if words:
            lines = [words[at : at + self.line] for at in range(0, len(words), self.line)]
            if self.guard:
                ids = np.concatenate(self._ids(["\n".join(line) + "\n" for line in lines]))
                last = ids == self.feed
                ends = np.cumsum(~last)[last]
                ids = ids[~last]
            else:
                ids = np.concatenate(self._ids([" ".join(line) for line in lines]))
                ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                self._add(words, ids, np.diff(ends, prepend=0))
        rest = [p for p in pieces if p not in self.known]
        if rest:
            ids = self._ids(rest)
            self._add(rest, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of numbered chunks begin in ``codes``, and how many there are."""
        ends = np.frombuffer(self.ends, np.int64)
        first = ends[numbers]
        return first, ends[numbers + 1] - first

    def _gather(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of such spans in a row."""
        place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        place += np.arange(len(place))
        return np.frombuffer(self.codes, np.uint32)[place]

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _learn(self, chunks: list[str]) -> None:
        """Number new chunks (where case is dropped, in lower case) by the ids of their pieces."""
        pieces = self.fine(self.mark.join(chunks))
        self._add_pieces(list(set(pieces).difference(self.known)))
        numbers = self._numbers(pieces)
        first, sizes = self._spans(numbers)
        # A chunk that is one piece is numbered by now.
        new = self._numbers(chunks) < 0
        chunk = np.cumsum(numbers == 0)
        kept = new[chunk]
        totals = np.bincount(chunk, sizes, len(chunks)).astype(np.int64)
        ids = self._gather(first[kept], sizes[kept])
        self._add([chunks[i] for i in np.flatnonzero(new).tolist()], ids, totals[new])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _distinct(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of all texts, which of them lies where, and the places between texts."""
        if not self.guard:
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            found = split.flatten().dictionary_encode()
            words, at = found.dictionary, found.indices.to_numpy()
            every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            chunks = pc.binary_join(every, "\n")[0].as_py().split("\n")[: len(words)]
            return chunks, at, split.offsets.to_numpy() - split.offsets[0].as_py()
        # The chunks lie one after another in the texts' own bytes: only where they begin is worked out.
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return [], np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        byte = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        begins = (byte == 32) | (byte == 10)
        begins[1:] &= ~begins[:-1]
        begins[ends[:-1][ends[1:] > ends[:-1]] - ends[0]] = True
        first = np.flatnonzero(begins) + ends[0]
        bounds = pa.py_buffer(np.append(first, ends[-1]))
        found = pa.LargeStringArray.from_buffers(len(first), bounds, data).dictionary_encode()
        chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        return chunks, found.indices.to_numpy(), np.searchsorted(first, ends)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        ids, sizes = self.encode_flat(pa.array(list(texts), pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes))[:-1]]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; null counts as empty."""
        texts = texts.fill_null("")
        chunks, at, upto = self._distinct(texts)
        if self.held > self.cache_chars:
            self._empty()
        numbers = self._numbers(chunks)
        odd = np.zeros(len(chunks), bool)
        if self.guard:
            numbers[numbers == 0] = -1  # the mark is no chunk
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [chunks[i] for i in new.tolist()]
            if self.guard and RARE.search("\n".join(fresh)):
                odd[new] = [bool(RARE.search(c)) for c in fresh]
                new = new[~odd[new]]
                fresh = [chunks[i] for i in new.tolist()]
            self._learn(fresh)
            numbers[new] = self._numbers(fresh)
            numbers[odd] = 0
        first, sizes = self._spans(numbers)
        sizes = sizes[at]
        ids = self._gather(first[at], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[upto]
        sizes = np.diff(ends)
        if odd.any():
            parts = np.split(ids, ends[1:-1])
            whole = np.unique(np.searchsorted(upto, np.flatnonzero(odd[at]), "right") - 1)
            for k in whole.tolist():
                parts[k] = self._whole(texts[k].as_py())
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, blanks: str) -> ChunkEncoder:
    """The encoder of this worker process, with its cache."""
    key = (path, blanks)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, blanks)
    return _ENCODERS[key]
