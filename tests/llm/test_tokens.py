"""Token operators against the libraries themselves."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import SF, no_docs, odd_docs
from tidemark.llm import byte_bpe, packing, queries, token_files
from tidemark.llm.chunks import ChunkEncoder

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_bpe_equals_the_library_and_round_trips(spark, reference):
    docs = odd_docs(spark)
    got = byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect()
    want = []
    for doc_id, text in texts_of(docs):
        ids = reference(text or "")
        want.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(packed(ids)).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest(),
            )
        )
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bpe_tables_hold_ids_and_bytes(spark, reference):
    docs = odd_docs(spark)
    coded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    by_id = defaultdict(list)
    for doc_id, text in texts_of(docs):
        by_id[doc_id].append(text or "")
    for row in coded.collect():
        assert row.ids in [reference(t) for t in by_id[row.doc_id]]
    for row in byte_bpe.decode_documents(coded, RANKS, P.PATTERN).collect():
        assert bytes(row.bytes).decode() in by_id[row.doc_id]
    assert byte_bpe.encode_documents(no_docs(spark), RANKS, P.PATTERN).count() == 0


def test_bpe_query_over_a_whole_table(spark, reference):
    got = {r.doc_id: r for r in queries.QUERIES["op3_byte_bpe"](spark, SF).collect()}
    texts = texts_of(queries.table(spark, SF, "documents"))
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = reference(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t'st.\xa0é1", max_size=60))
def test_any_text(text):
    global CODERS
    bpe, kept, dropped, plain, kept_plain, dropped_plain = CODERS
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == plain(text)
    assert bpe.decode(bpe.encode([text])[0]) == text.encode()
    assert np.frombuffer(kept.encode([text])[0], "<u4").tolist() == kept_plain(text)
    assert np.frombuffer(dropped.encode([text])[0], "<u4").tolist() == dropped_plain(text)


class CountedTokenizer:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_share_calls():
    plain = library("word_bpe_49k.json")
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in ("on", "ti", "é", "ß") for c in "stuvwxyz"]
    texts = [" ".join(words[at : at + 8]) + ", 12! Don't" for at in range(0, len(words), 8)]
    coder = ChunkEncoder(P.path("word_bpe_49k.json"), "dropped")
    coder.tokenizer = CountedTokenizer(coder.tokenizer)
    ids, sizes = coder.encode_flat(pa.array([*texts, None, "", *texts]))
    want = [plain(t) for t in [*texts, None, "", *texts]]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])
    assert coder.tokenizer.texts <= 8


def test_words_not_told_apart_go_one_by_one():
    plain = library("word_bpe_49k.json")
    texts = ["One two, three; two\tone", None, " \n", "a\u0301b!? c1d22", "x\x0by\x1cz\u2003w"]
    for closes in (np.zeros(0, bool), np.zeros(60_000, bool)):
        coder = ChunkEncoder(P.path("word_bpe_49k.json"), "dropped")
        coder.closes = closes
        ids, sizes = coder.encode_flat(pa.array(["", *texts]).slice(1))
        assert ids.tolist() == sum(map(plain, texts), [])
        assert sizes.tolist() == [len(plain(t)) for t in texts]


def test_new_words_with_blanks_share_calls():
    plain = library("byte_bpe_50k.json")
    words = [f"{a}{b}{c}" for a in "ABcdefgh" for b in ("on", "ti", "é", "ß") for c in "stuvwxyz"]
    texts = [" ".join(words[at : at + 8]) + ", 12!\nDon't" for at in range(0, len(words), 8)]
    texts += [w + "," for w in words] + [None, "", *texts]
    coder = ChunkEncoder(P.path("byte_bpe_50k.json"), "kept")
    coder.tokenizer = CountedTokenizer(coder.tokenizer)
    ids, sizes = coder.encode_flat(pa.array(["x", *texts]).slice(1))
    want = [plain(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])
    assert coder.tokenizer.texts <= 64


ODD_PARTS = ["a", "The", "é", "e\u0301", "ß", "\u0130", "日本", "12", "²", "!", "_-", "'", "'s", "n't", "I'll"]
ODD_PARTS += [" ", " ", "  ", "   ", "\n", "\n\n", "\n ", "\r", "\r\n", "\t", "\x85", "\xa0", "\u200b", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ODD_PARTS)).map("".join))))
def test_kept_blanks_in_odd_texts(texts):
    ids, sizes = CODERS[1].encode_flat(pa.array(["x ", *texts, " y"], pa.string()).slice(1, len(texts)))
    want = [CODERS[4](t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])


@pytest.mark.parametrize("feed", [None, 0])
def test_words_with_blanks_not_told_apart_go_one_by_one(feed):
    plain = library("byte_bpe_50k.json")
    texts = ["One two, three; two\tone", None, " \n", "a\u0301b!? c1d22  \n\nx", "\r"]
    coder = ChunkEncoder(P.path("byte_bpe_50k.json"), "kept")
    coder.feed = feed
    ids, sizes = coder.encode_flat(pa.array(texts))
    assert ids.tolist() == sum(map(plain, texts), [])
    assert sizes.tolist() == [len(plain(t)) for t in texts]


@pytest.mark.parametrize("text", ["\u0130! abc", "x\u0130.", "\u01301 \u0130stanbul, \u0130-x"])
def test_letter_that_is_two_signs_in_lower_case(text):
    coder = ChunkEncoder(P.path("word_bpe_49k.json"), "dropped")
    ids, _ = coder.encode_flat(pa.array([text]))
    assert ids.tolist() == library("word_bpe_49k.json")(text)


@pytest.fixture(scope="module", autouse=True)
def coders(reference):
    global CODERS
    CODERS = (
        byte_bpe.ByteBPE(RANKS, P.PATTERN, cache_chars=200),
        ChunkEncoder(P.path("byte_bpe_50k.json"), "kept", cache_chars=200),
        ChunkEncoder(P.path("word_bpe_49k.json"), "dropped", cache_chars=200),
        reference,
        library("byte_bpe_50k.json"),
        library("word_bpe_49k.json"),
    )


def test_long_pretoken(reference):
    text = "ab" * 20000 + "a" * 5000
    assert np.frombuffer(CODERS[0].encode([text])[0], "<u4").tolist() == reference(text)


def check_files(rows, texts, encode):
    start, want = 0, []
    for doc_id, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = encode(text) + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    rows = sorted(map(tuple, rows), key=lambda r: r[1])
    assert rows == want


def test_token_files(spark):
    encode = library("word_bpe_49k.json")
    got = queries.QUERIES["op6_token_files"](spark, SF).collect()
    check_files(got, texts_of(queries.table(spark, SF, "documents")), encode)
    path = token_files.new_folder(spark, "odd")
    docs = odd_docs(spark)
    token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), 1)
    check_files(token_files.token_file_digests(spark, path).collect(), texts_of(docs), encode)
    few = token_files.read_token_files(spark, path, ["doc_id", "n_tokens"]).where("doc_id = 105")
    assert few.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,105)]" in (
        few._jdf.queryExecution().toString()
    )
    empty = token_files.new_folder(spark, "empty")
    token_files.write_token_files(no_docs(spark), empty, P.path("word_bpe_49k.json"), 1)
    assert token_files.token_file_digests(spark, empty).count() == 0


def check_packing(rows, texts, encode, window, most_padding):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    ids_of = defaultdict(list)
    for doc_id, text in texts:
        ids_of[doc_id].append(encode(text) + [0])
    assert docs.keys() == ids_of.keys()
    for doc_id, variants in ids_of.items():
        want = sorted(
            (at, len(ids[at : at + window]), zlib.crc32(packed(ids[at : at + window])), len(ids))
            for ids in variants
            for at in range(0, len(ids), window)
        )
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[doc_id]) == want
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= most_padding * total + 4 * window


def test_packing(spark):
    encode = library("byte_bpe_50k.json")
    rows = queries.QUERIES["op10_packing"](spark, SF).collect()
    check_packing(rows, texts_of(queries.table(spark, SF, "documents")), encode, 1024, 0.001)
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 0, 64).collect()
    check_packing(rows, texts_of(docs), encode, 64, 0.01)
    assert packing.pack_documents(no_docs(spark), P.path("byte_bpe_50k.json")).count() == 0


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_fullest_window_is_the_best_one(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    chosen = packing.fullest(counts, 32)
    assert all(1 <= c <= counts[n] for n, c in chosen.items())
    sums = {max(lengths)}
    rest = sorted(lengths)[:-1]
    for n in rest:
        sums |= {s + n for s in sums if s + n <= 32}
    assert chosen[max(lengths)] >= 1
    total = sum(n * c for n, c in chosen.items())
    powers = [s for s in sums if s & (s - 1) == 0]
    assert total == (max(powers) if powers else max(sums))


def test_kept_ids_match_their_digests(spark):
    rows = packing.pieces(odd_docs(spark), P.path("byte_bpe_50k.json"), keep_ids=True).collect()
    assert all(zlib.crc32(packed(r.ids)) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
