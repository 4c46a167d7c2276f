"""Dictionary lookups in texts against plain searches, and how much they explode."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.core.sides import small_side
from tidemark.functions import text as tx
from tidemark.operators import documents as dc
from tidemark.operators import sector as sc

DOCS = "doc_id string, doc_ts timestamp_ntz, title string, body string"


def made_texts(n=60):
    draw = random.Random(4)
    words = "the The THE apple Apple & Co. co AI ai said S&P 500 c++ İstanbul ΟΔΟΣ straße x_y a.b. naïve Bank bank of".split()
    return [" ".join(draw.choice(words) + draw.choice(["", "", ".", ",", "'s"]) for _ in range(draw.randrange(12))) for _ in range(n)]


def docs_of(spark, texts):
    rows = [(f"d{k}", None, t[: len(t) // 3] or None, t[len(t) // 3 :]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def whole(text, term):
    """Whether the term stands in the text with no word character on either side."""
    edge = r"[^\W]"
    return bool(re.search(rf"(?<!{edge}){re.escape(term)}(?!{edge})", text))


TERMS = [
    ("a", "AI", "Apple & Co."), ("b", "THE", "the bank of"), ("c", "S&P", "S&P 500"), ("d", "zzz", "İstanbul"),
    ("e", "co", "ΟΔΟΣ"), ("f", "x_y", "a.b."), ("g", "c++", "Apple"), ("h", "!!", "..."), ("i", "said", "of the"),
    ("j", None, "said"), ("k", "of", None), ("a", "AI", "Apple & Co."),
]


def lower(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.l for r in df.select("i", F.lower("t").alias("l")).collect()}


def test_mentions_equal_a_plain_search(spark):
    texts = [*made_texts(), "İstanbul'da", "ΟΔΟΣ.", "ΟΔΟΣ.Α", "", "AI", "said AI-said", "the bank of the"]
    docs = docs_of(spark, texts)
    rows = docs.select("doc_id", tx.headline_and_body(F.col("title"), F.col("body")).alias("t")).collect()
    full = {r.doc_id: r.t for r in rows}
    low = dict(zip(full, lower(spark, list(full.values())).values()))
    names = dict(zip(range(len(TERMS)), lower(spark, [n for _, _, n in TERMS]).values()))
    want = {}
    for k, (alias, ticker, _) in enumerate(TERMS):
        for doc in full:
            by_ticker = bool(ticker and re.search(r"\w", ticker) and whole(full[doc], ticker))
            by_name = bool(names[k] and re.search(r"\w", names[k]) and whole(low[doc], names[k]))
            if by_ticker or by_name:
                want[doc, alias] = max(want.get((doc, alias), 0), int(by_ticker))
    aliases = spark.createDataFrame(TERMS, "alias string, ticker string, name string")
    got = dc.mentions(docs, aliases, keep=["title"]).collect()
    assert {(r.doc_id, r.alias): r.by_ticker for r in got} == want
    assert len(got) == len(want) > 40
    assert dc.mentions(docs, aliases.where("alias = 'h'")).count() == 0
    assert dc.mentions(docs.where("false"), aliases).count() == 0


def test_a_document_gives_at_most_its_distinct_words(spark):
    """However many terms there are, and however often a word is repeated."""
    docs = docs_of(spark, [" ".join(["alpha beta gamma delta"] * 500)] * 3)
    names = [(f"n{k}", f"T{k}", f"alpha beta gamma w{k}") for k in range(500)]
    terms = dc.mention_terms(spark.createDataFrame(names, "alias string, ticker string, name string"))
    text = tx.headline_and_body(F.col("title"), F.col("body"))
    assert {r.n for r in docs.select(F.size(tx.cased_words(text)).alias("n")).collect()} <= {4, 5, 6}
    found = dc.term_words(docs, terms)
    assert found.count() == 9
    # Every term is looked up by its own word, which no document has: no text is searched.
    assert dc.rarest_words(terms, found).count() == 0
    one = docs.unionByName(docs_of(spark, ["w7 alpha beta gamma w7"]))
    anchors = dc.rarest_words(terms, dc.term_words(one, terms)).collect()
    assert [(r.alias, r.word) for r in anchors] == [("n7", "w7")]


def test_substrings_equal_a_plain_search(spark):
    texts = made_texts()
    docs = docs_of(spark, texts)
    terms = ["ai", "AI", "a", "the ", "Apple", "s&p 5", "nk o", "istan", "οδος", "zzz", "", "ß", "co", "İ", "🙂🙂"]
    low = lower(spark, [f"{t[: len(t) // 3]} {t[len(t) // 3 :]}" for t in texts])
    lows = lower(spark, terms)
    want = {(f"d{k}", t) for k in low for i, t in enumerate(terms) if t and lows[i] in low[k]}
    table = spark.createDataFrame([(t,) for t in [*terms, None, "ai"]], "term string")
    got = [(r.doc_id, r.term) for r in sc.substring_mentions(docs, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sc.substring_mentions(docs, table.where("term = ''")).count() == 0


def test_twenty_thousand_terms(spark):
    draw = random.Random(9)
    terms = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9))) for _ in range(20_000)]
    texts = ["".join(draw.choice("abcdefghij     ") for _ in range(400)) for _ in range(20)]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.doc_id, r.term) for r in sc.substring_mentions(docs, table).collect()}
    full = [f"{t[: len(t) // 3]} {t[len(t) // 3 :]}" for t in texts]
    assert got == {(f"d{k}", t) for k, x in enumerate(full) for t in set(terms) if t in x}
    aliases = spark.createDataFrame([(f"a{k}", t, t) for k, t in enumerate(terms)], "alias string, ticker string, name string")
    assert dc.mentions(docs, aliases).select("alias").distinct().count() == len(
        {f"a{k}" for k, t in enumerate(terms) if any(t in x.split() for x in full)}
    )


@pytest.mark.parametrize("rows,hinted", [(10, True), (11, False)])
def test_only_a_side_of_checked_size_is_hinted(spark, rows, hinted):
    side = small_side(spark.range(rows), 10)
    plan = side._jdf.queryExecution().logical().toString()
    assert ("broadcast" in plan) == hinted
