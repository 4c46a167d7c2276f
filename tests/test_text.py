"""Word rules, polarity, URLs, feeds and document handling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.functions import text as tx
from tidemark.functions import urls
from tidemark.operators import documents as dc
from tidemark.sources import articles as ar
from tidemark.sources import calendar as cl


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("strong beat record growth", 1.0),
        ("miss downgrade lawsuit cut", -1.0),
        ("", 0.0),
        (None, 0.0),
        ("execute", -1.0),
        ("beats", 1.0),
        ("beat cut", 0.0),
    ],
)
def test_lexicon_counts_substrings(spark, text, want):
    assert one(spark, text, tx.lexicon_score) == want


def test_overlapping_terms_count_twice(spark):
    pos, neg = tx.lexicon_counts(F.col("t"))
    row = spark.createDataFrame([("beats and cuts",)], "t string").select(pos, neg).first()
    assert tuple(row) == (2, 2)


def test_terms_match_whole_words_in_any_script(spark):
    hits = one(spark, "éai AI-led  deep\n learning, xai_ S&P 500", lambda t: tx.match_terms(t, ("ai", "deep learning", "xai", "s&p 500")))
    assert hits == ["ai", "deep learning", "s&p 500"]


def test_outcome_phrases(spark):
    def hits(text, patterns):
        return one(spark, text, lambda t: tx.pattern_hits(t, patterns))

    assert hits("The firm BEAT estimates and raised its guidance", fx.OUTCOME_POSITIVE_PATTERNS) == 2
    assert hits("It missed revenue; a downgrade followed", fx.OUTCOME_NEGATIVE_PATTERNS) == 2
    assert hits(None, fx.OUTCOME_NEGATIVE_PATTERNS) == 0


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-03-05T10:00:00Z", dt.datetime(2024, 3, 5, 10)),
        ("2024-03-05T10:00:00+02:00", dt.datetime(2024, 3, 5, 8)),
        ("2024-03-05", dt.datetime(2024, 3, 5)),
        ("Tue, 05 Mar 2024 10:00:00 GMT", dt.datetime(2024, 3, 5, 10)),
        ("Tue, 5 Mar 2024 10:00:00 +0100", dt.datetime(2024, 3, 5, 9)),
        ("soon", None),
        (None, None),
    ],
)
def test_times(spark, raw, want):
    assert one(spark, raw, lambda t: tx.parse_ts(t).cast("timestamp_ntz")) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        (" HTTPS://WWW.Example.com/A?utm_source=x&b=2&fbclid=1&a=#top ", "https://www.example.com/A?b=2&a="),
        ("//Example.com/x", "https://example.com/x"),
        ("http://example.com", "http://example.com"),
        ("http://example.com:8080/p?GCLID=1", "http://example.com:8080/p"),
    ],
)
def test_canonical_urls(spark, raw, want):
    assert one(spark, raw, urls.canonical_url) == want


def test_domains(spark):
    assert one(spark, "https://www.Example.com:80/x", urls.domain) == "example.com:80"
    assert one(spark, "a.b.c", urls.domain_suffixes) == ["a.b.c", "b.c", "c"]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, title string, body string")


def test_mentions_by_ticker_and_name(spark):
    aliases = spark.createDataFrame(
        [("tour", "TOUR", "tuniu"), ("amd", "AMD", "advanced micro devices"), ("now", "NOW", "servicenow")],
        "alias string, ticker string, name string",
    )
    rows = docs(
        spark,
        ("1", "TOUR rises", "tourism"),
        ("2", "tour of", "Advanced Micro Devices, and now"),
        ("3", "advanced  micro devices", "advanced micro, devices xAMD"),
        ("4", "Tuniu TOUR", ""),
    )
    got = sorted(tuple(r) for r in dc.mentions(rows, aliases).collect())
    assert got == [("1", "tour", 1), ("2", "amd", 0), ("4", "tour", 1)]


def test_mentions_of_long_and_punctuated_terms(spark):
    aliases = spark.createDataFrame(
        [
            ("bk", "BK", "Bank of New York Mellon"),
            ("brk", "BRK.B", "berkshire hathaway"),
            ("t", "AT&T", "at&t inc."),
            ("yhoo", "YHOO!", "yahoo!"),
            ("none", "&", None),
        ],
        "alias string, ticker string, name string",
    )
    rows = docs(
        spark,
        ("1", "The bank of new york mellon said", ""),
        ("2", "bank of new york", "mellon"),
        ("3", "Buy BRK.B now", "BRK B, brk.b"),
        ("4", "AT&T", ""),
        ("5", "at&t", "inc.x AT&TX"),
        ("6", "x at&t inc. y", ""),
        ("7", "yahoo!", ""),
        ("8", "yahoo", "!yahoo!s yahoo ! YHOO!!"),
        ("9", None, "& !"),
        ("10", "BRK.Bx BRK-B", None),
    )
    rows = rows.withColumn("n", F.length("title"))
    got = sorted(tuple(r) for r in dc.mentions(rows, aliases, keep=["n"]).collect())
    assert got == [
        ("1", "bk", 0, 32),
        ("2", "bk", 0, 16),
        ("3", "brk", 1, 13),
        ("4", "t", 1, 4),
        ("6", "t", 0, 13),
        ("7", "yhoo", 0, 6),
        ("8", "yhoo", 1, 5),
    ]
    nothing = spark.createDataFrame([], aliases.schema)
    assert dc.mentions(rows, nothing).count() == 0


def test_scoring_twice_adds_nothing(spark):
    rows = docs(spark, ("d1", "Strong beat", "earnings beat estimates"), ("d2", "Lawsuit warning", "downgrade"))
    empty = spark.createDataFrame([], "doc_id string, model_name string, score double, label string, scored_at string")
    first = dc.ensure_scores(rows, empty, "lexicon-v1", dc.lexicon_scorer(), "t0")
    assert {r["doc_id"]: r["label"] for r in first.collect()} == {"d1": "positive", "d2": "negative"}
    assert dc.ensure_scores(rows, first, "lexicon-v1", dc.lexicon_scorer(), "t1").count() == 0


def test_one_document_per_url(spark):
    rows = spark.createDataFrame(
        [("u1", 1, "b"), ("u1", 0, "c"), ("u2", 2, "a"), ("u3", 1, "a")], "url string, priority int, title string"
    )
    stored = spark.createDataFrame([("u3",)], "url string")
    got = dc.dedupe_documents(rows, stored, order=("priority", "title")).collect()
    assert sorted(tuple(r) for r in got) == [("u1", 0, "c"), ("u2", 2, "a")]


RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed</title>
<item><title>A &amp; B</title><link>https://x.com/1</link><description>d</description>
<content:encoded><![CDATA[<p>full</p>]]></content:encoded><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>
<item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><summary>s</summary>
<link href="https://y.com/1"/><updated>2024-03-06T00:00:00Z</updated></entry>
<entry><title>old</title><link href="https://y.com/2"/><updated>2020-01-01T00:00:00Z</updated></entry></feed>"""


def _check_feeds(rows):
    got = {r["url"]: r for r in rows.collect()}
    assert sorted(got) == ["https://x.com/1", "https://y.com/1"]
    assert got["https://x.com/1"]["title"] == "A & B"
    assert got["https://x.com/1"]["published_at"] == dt.datetime(2024, 3, 5, 10)
    assert got["https://y.com/1"]["description"] == "s"


def test_feeds_in_a_column(spark):
    rows = spark.createDataFrame([(RSS, "https://www.x.com/rss"), (ATOM, "https://y.com/f")], "xml string, feed_url string")
    parsed = ar.parse_feeds(rows, since="2023-01-01")
    _check_feeds(parsed)
    assert parsed.where("url like '%x.com%'").first()["content"] == "<p>full</p>"


def test_feeds_in_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    _check_feeds(ar.read_feeds(spark, str(tmp_path), since="2023-01-01"))


def test_calendar_codes(spark):
    raw = spark.createDataFrame(
        [("aa.US", "2024-01-05", None), ("AA", None, "2024-01-05"), ("bb.L", "bad", None), ("", "2024-01-05", None)],
        "code string, date string, report_date string",
    )
    assert [tuple(r) for r in cl.calendar_rows(raw).collect()] == [("AA", dt.datetime(2024, 1, 5))]
