"""Main text of pages: markup, alignment, differences between neighbours."""

import html
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from helpers import SF
from tidemark.llm import queries, web_text

SCHEMA = "page_id long, url string, html string"


class Articles(HTMLParser):
    """Text of article elements, one line per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_query_equals_a_plain_parser(spark):
    pages = {r.page_id: r for r in queries.table(spark, SF, "pages").collect()}
    rows = queries.QUERIES["op7_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parser = Articles()
        parser.feed(pages[r.page_id].html or "")
        parser.close()
        assert r.text == " ".join("".join(parser.parts).split())
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, lines",
    [
        (None, []),
        ("", []),
        ("plain &amp; &lt;b&gt; text", ["plain & <b> text"]),
        ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]),
        ("<ul><li>a<li class=comment>c<li>d</ul>x", ["a", "d", "x"]),
        ("<p class='ad'>buy<p>z", ["z"]),
        ("<div id=top-nav><div>q</div>x</div>y", ["y"]),
        ("<script>if(a<b){'</p>'}</script>t<style>p{}</style>", ["t"]),
        ("<script>never closed <p>x", []),
        ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        ("<nav>n</nav></nav></div>t<footer>f", ["t"]),
        ("<a title='>'>x</a><img alt='<p>'>y", ["xy"]),
        ("<div style='display: none'>h</div><p hidden>i</p><p aria-hidden=true>j</p>k", ["k"]),
        ("<div class='cookieNotice'>c</div><div class=adventure>a</div>", ["a"]),
        ("<body class='has-sidebar'><p>t</p></body>", ["t"]),
        ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
        ("&am; &amp &copy &#233;&#xe9;&nbsp;&nbsp;z", ["&am; & © éé z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_lines(page, lines):
    assert [t for t, _ in web_text.page_lines(page)] == lines


def test_declared_text():
    page = (
        "<body><header>Site</header><p>lead</p><article><header><h1>T</h1></header><p>x</p>"
        "<aside>s</aside><section class=comments><article class=comment><p>c</p></article></section>"
        "<form>f</form><p>y</article><p>out</p></body>"
    )
    assert web_text.page_lines(page) == [
        ("lead", False),
        ("T", True),
        ("x", True),
        ("y", True),
        ("out", False),
    ]


OWN = "A text of its own, longer than the rest."


@pytest.mark.parametrize(
    "before, after",
    [
        ("<article class='post has-sidebar'>", "</article>"),
        ("<main class='no-sidebar'>", "</main>"),
        ("<div role=main class=sidebar-left>", "</div>"),
        ("<article class='category-notices comments-open'>", "</article>"),
        ("<main><article class='category-notices comments-open'>", "</article></main>"),
        ("<div id='content' class='with-sidebar'><article>", "</article></div>"),
        ("<html class='js-menu'><body class='x'><main id=search>", "</main></body></html>"),
    ],
)
def test_marks_never_drop_declared_text(before, after):
    page = f"<div>Site</div><div class=menu>m</div>{before}<p>{OWN}</p><div class=ad>b</div>{after}out"
    assert web_text.page_lines(page) == [("Site", False), (OWN, True), ("out", False)]
    assert [t for t, _ in web_text.page_lines(f"{before}<p>x</p>{after}")] == ["x"]


def test_marks_on_most_of_a_page_leave_candidates():
    page = f"<div>Site</div><div id=content class=with-sidebar><p>{OWN}</p><div class=sidebar>s</div></div>"
    assert web_text.page_lines(page) == [("Site", False), (OWN, False)]
    cards = f"<div><p>{OWN}</p></div><div class=related><article>a card</article></div>"
    assert web_text.page_lines(cards) == [(OWN, False), ("a card", False)]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("small", [3, 256])
def test_shared_lines_are_a_longest_common_subsequence(small):
    draw = random.Random(small)
    for _ in range(300):
        a = [draw.randrange(5) for _ in range(draw.randrange(25))]
        b = [draw.randrange(6) for _ in range(draw.randrange(25))]
        places = web_text.shared_lines(a, b, small)
        assert len(places) == longest(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in places))


def page(body, extra=""):
    return (
        "<html><body><div>Site name</div><p>All our topics</p>"
        + "".join(f"<p>{p}</p>" for p in body)
        + f"{extra}<div>Copyright us</div></body></html>"
    )


def test_differences(spark):
    def body(k):
        return [f"line {k}-{i} with some words of its own" for i in range(6)]

    rows = [
        (1, "http://a.com/x/1", page(body(1))),
        (2, "http://a.com/x/2?utm=1", page(body(2))),
        (3, "http://a.com/y/3", page(body(3))),
        (4, "http://b.com/1", page(body(4))),
        (5, None, page(body(5))),
        (6, "http://c.com/1", page(body(6))),
        (7, "http://c.com/1#top", page(body(6))),
        (8, "no url", page(body(8))),
        (None, "http://a.com/x/2", None),
        (9, "http://a.com/x/9", page(["twice", "twice"] + body(9), "<article>only this</article>")),
    ]
    rows += [(20, "http://d.com/q", page(body(20)))] * 2
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'?' AS row", "'?' AS lines", "'?' AS host")
    got = [tuple(r) for r in web_text.main_text(df).collect()]
    assert len(got) == len(rows)
    text = {r[0]: r[2] for r in got}
    whole = lambda k: " ".join(["Site name", "All our topics", *body(k), "Copyright us"])
    for k in (1, 2, 3):
        assert text[k] == " ".join(body(k))
    for k in (4, 5, 6, 8, 20):  # no neighbour, or only a copy
        assert text[k] == whole(k)
    assert text[7] == whole(6) and text[None] == "" and text[9] == "only this"
    assert web_text.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_across_ranges(spark):
    draw = random.Random(3)
    rows = [(k, f"http://h{k % 3}.com/a/{draw.randrange(900)}/p{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "row long, url string")
    got = {(r.row, r.k): r.near for r in web_text.nearest_pages(df).collect()}
    want = {}
    order = sorted((re.match(r"http://([^/]+)(.*)", u).groups() + (k,)) for k, u in rows)
    for (h, _, k), (h2, _, k2) in zip(order, order[1:]):
        if h == h2:
            want[k, 1], want[k2, 0] = k2, k
    assert got == want


def test_declared_pages_are_aligned_too(spark, monkeypatch):
    """Every page with a neighbour meets it, whether or not markup declares its text."""
    rows = [
        (k, f"http://a.com/{k}", page([f"aside {k}"], f"<article>own {k}</article>")) for k in range(3)
    ]
    rows.append((3, "http://a.com/3", page(["own 3" * 20])))
    df = spark.createDataFrame(rows, SCHEMA)
    texts = {r.page_id: r.text for r in web_text.main_text(df).collect()}
    assert texts == {0: "own 0", 1: "own 1", 2: "own 2", 3: "own 3" * 20}
    met = []
    monkeypatch.setattr(web_text, "shared_lines", lambda a, b: met.append((a, b)) or [0])
    keys = [web_text._line_key(k) for k in "abcd"]
    other = {"far": 0, "k": 1, "keys": b"".join(keys[2:]), "total": 9}
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0]), pa.array([b"".join(keys[:2])]), pa.array([[4, 4]]), pa.array([[other]])],
        ["row", "keys", "sizes", "others"],
    )
    assert next(web_text._first_shared([batch], 0.8))["gone"].to_pylist() == [[0]]
    assert met == [(keys[:2], keys[2:])]


def _words_against(spark, change, sf="/root/testdata/sf0.01"):
    """Precision and recall of words, against the query's texts, of pages changed in their markup."""
    pages = queries.table(spark, sf, "pages")
    want = {r.page_id: r.text for r in web_text.main_text(pages).collect()}
    rows = [(r.page_id, r.url, change(r.html or "")) for r in pages.collect()]
    changed = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.page_id: r.text for r in web_text.main_text(changed).collect()}
    hits = sum((Counter(got[k].split()) & Counter(want[k].split())).total() for k in want)
    found, there = (sum(len(t.split()) for t in x.values()) for x in (got, want))
    return hits / found, hits / there


def test_differencing_where_no_element_declares_the_text(spark):
    precision, recall = _words_against(
        spark, lambda page: re.sub(r"(</?)(article|main)\b", r"\1div", page, flags=re.I)
    )
    assert precision >= 0.99 and recall >= 0.99


def test_differencing_alone(spark):
    """Without the elements, classes, ids and roles that name menus and text."""

    def bare(page):
        page = re.sub(r"(</?)(article|main|nav|header|footer|aside|form)\b", r"\1div", page, flags=re.I)
        return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page, flags=re.I)

    precision, recall = _words_against(spark, bare)
    assert precision >= 0.93 and recall >= 0.99


def test_runs_of_copies(spark):
    """Menus go although a page has none but copies, or near copies, beside it."""
    own = [f"one of {k} lines that all the copies of this page hold" for k in "abcdefghij"]
    other = [f"the other page's line {k}" for k in range(8)]
    rows = [(k, f"http://a.com/m?s={k}", page(own)) for k in range(5)]
    rows += [(5, "http://a.com/z", page(other))]
    rows += [(10 + k, f"http://b.com/m/{k}", page(own, f"<p>seen {k} times</p>")) for k in range(6)]
    rows += [(16, "http://b.com/z", page(other))]
    rows += [(20 + k, f"http://c.com/{k}", page([], f"<p>{'menu ' * 90}</p><p>short text of page {k}</p>")) for k in range(4)]
    rows += [(30 + k, f"http://d.com/{k}", page(own, f"<p>{k}</p>")) for k in range(4)]
    got = {r.page_id: r.text for r in web_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for k in range(5):
        assert got[k] == " ".join(own)
    for k in range(6):
        assert got[10 + k] == " ".join([*own, f"seen {k} times"])
    assert got[5] == got[16] == " ".join(other)
    for k in range(4):
        assert got[20 + k] == f"short text of page {k}"
        assert got[30 + k] == " ".join(["Site name", "All our topics", *own, str(k), "Copyright us"])


def test_references_are_decoded_once():
    assert web_text.page_lines("<p>&amp;lt;</p>") == [(html.unescape("&amp;lt;"), False)]
