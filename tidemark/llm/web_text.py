"""Main text of web pages: lines by markup, then differences between nearest URLs."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Elements whose text is never read.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are not main text.
ASIDE = frozenset(
    "head nav header footer aside form noscript template svg math canvas object button select "
    "option label fieldset dialog menu audio video map".split()
)
#: Elements that declare main text.
MAIN = frozenset("article main".split())
#: Elements that begin and end lines.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl "
    "dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements without an end.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Words in class, id or role that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments "
    "commentlist disqus respond reply replies reactions sidebar aside widget widgets related "
    "recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation "
    "navigational header masthead topbar footer footnav pagination pager toolbar search "
    "complementary contentinfo".split()
)
#: Word pairs of the same kind.
MARK_PAIRS = frozenset({("skip", "link"), ("sign", "up"), ("see", "also"), ("read", "more")})
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I
)
#: Elements within which nested articles are comments or cards.
ARTICLE = frozenset(("article",))
#: Fewer characters than this are never most of a page.
LEAST_MOST = 20
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _marked(value: str) -> bool:
    words = [w.lower() for w in WORDS.findall(value)]
    return not MARKS.isdisjoint(words) or not MARK_PAIRS.isdisjoint(zip(words, words[1:]))


def _role(name: str, attributes: str) -> tuple[str, bool]:
    """``aside``, ``main`` or nothing, by element, role and visibility; whether class or id mark it."""
    role = "aside" if name in ASIDE else "main" if name in MAIN else ""
    marked = False
    if attributes and not attributes.isspace():
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                marked = marked or _marked(value)
            elif key == "role":
                if value.lower() in ("main", "article"):
                    role = "main"
                elif _marked(value):
                    return "aside", marked
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return "aside", marked
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                return "aside", marked
    return role, marked


class _Mark:
    """An element that class or id mark as no main text."""

    __slots__ = ("around", "holds_main", "size")

    def __init__(self, around: _Mark | None):
        self.around, self.holds_main, self.size = around, False, 0


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """(text, declared) of each line of a page: its blocks without asides, in order.

    ``declared`` tells that the line lies inside an element that declares main
    text. Elements that were never closed end with the element around them.

    A class or id never makes an aside of an element that declares main text, of
    one that holds such an element, or of one with most of the page's characters;
    inside an article, nested articles are comments or cards and do not count.
    Main text inside a marked element is declared only where it is most of the
    page: else a marked list of cards would replace the text beside it.
    """
    page = page or ""
    lines: list[tuple[str, bool, _Mark | None, bool]] = []
    stack: list[tuple[str, str, bool]] = []
    marks: list[_Mark] = []
    text: list[str] = []
    asides = mains = articles = at = 0
    outside: _Mark | None = None  # innermost mark around the outermost main element

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append((line, mains > 0, marks[-1] if marks else None, outside is not None))
            text.clear()

    def close(depth: int) -> None:
        nonlocal asides, mains, articles, outside
        while len(stack) > depth:
            name, role, marked = stack.pop()
            asides -= role == "aside"
            mains -= role == "main"
            articles -= role == "article"
            if role == "article":
                mains -= 1
            if not mains:
                outside = None
            if marked:
                marks.pop()

    def depth_of(name: str, until: frozenset = frozenset()) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return k
            if stack[k][0] in until:
                return None
        return None

    while True:
        found = TAG.search(page, at)
        if not asides:
            text.append(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            flush()
        if found[1]:
            depth = depth_of(name)
            if depth is not None:
                flush()
                close(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or found[3].endswith("/"):
            continue
        if name in BLOCK:
            open_p = depth_of("p", BLOCK - {"p"})
            if open_p is not None:
                close(open_p)
        if name in ("li", "dd", "dt", "tr", "td", "th"):
            open_item = depth_of(name, frozenset(("ul", "ol", "dl", "table", "menu")))
            if open_item is not None:
                close(open_item)
        role, marked = _role(name, found[3])
        if name == "header" and mains and (role == "aside" or marked):
            role, marked = "", False
        if name in ("body", "html"):
            role, marked = "", False
        if role == "main":
            if not articles:
                marked = False
                for mark in marks:
                    mark.holds_main = True
            if not mains:
                outside = marks[-1] if marks else None
            if name in ARTICLE:
                role = "article"
        if role == "aside" or marked:
            flush()
        if name in BLOCK or role or marked:
            marked = marked and role != "aside"
            stack.append((name, role, marked))
            asides += role == "aside"
            mains += role in ("main", "article")
            articles += role == "article"
            if marked:
                marks.append(_Mark(marks[-1] if marks else None))
    flush()
    return _unmarked(lines)


def _unmarked(lines: list) -> list[tuple[str, bool]]:
    """Lines outside marked elements, except those whose mark says nothing."""
    if all(mark is None for _, _, mark, _ in lines):
        return [(line, declared) for line, declared, _, _ in lines]
    total = 0
    for line, _, mark, _ in lines:
        total += len(line)
        while mark is not None:
            mark.size += len(line)
            mark = mark.around

    def aside(mark: _Mark | None) -> bool:
        while mark is not None:
            if not mark.holds_main and (mark.size < LEAST_MOST or 2 * mark.size <= total):
                return True
            mark = mark.around
        return False

    kept = [(line, declared, inside) for line, declared, mark, inside in lines if not aside(mark)]
    within = sum(len(line) for line, declared, inside in kept if declared and inside)
    most = 2 * within > sum(len(line) for line, _, _ in kept)
    return [(line, declared and (most or not inside)) for line, declared, inside in kept]


def _bits(a: list, b: list):
    """Match vectors after each line of ``a``: a zero bit ``j`` is a longer LCS at ``b[j]``."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    state = full
    yield state
    for line in a:
        hit = state & where.get(line, 0)
        state = ((state + hit) | (state - hit)) & full
        yield state


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """LCS length of ``a`` with every prefix of ``b``."""
    for state in _bits(a, b):
        pass
    held = np.frombuffer(state.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8)
    zeros = np.unpackbits(held, bitorder="little")[: len(b)] == 0
    return np.concatenate(([0], np.cumsum(zeros)))


def shared_lines(a: list, b: list, small: int = 256) -> list[int]:
    """Positions in ``a`` of one longest common subsequence of lines with ``b``.

    Lines that the other page lacks drop out first. The table of the alignment
    is kept as bits and halved along ``a``, so memory grows with the lines, not
    with their product.
    """
    common = set(a) & set(b)
    places = [i for i, line in enumerate(a) if line in common]
    b = [line for line in b if line in common]
    found: list[int] = []
    todo = [(places, b)]
    while todo:
        places, b = todo.pop()
        if not places or not b:
            continue
        own = [a[i] for i in places]
        if len(own) > small:
            half = len(own) // 2
            ahead = _prefix_lengths(own[:half], b)
            behind = _prefix_lengths(own[half:][::-1], b[::-1])[::-1]
            cut = int(np.argmax(ahead + behind))
            todo += [(places[:half], b[:cut]), (places[half:], b[cut:])]
            continue
        states = list(_bits(own, b))
        j = len(b)
        for i in range(len(own) - 1, -1, -1):
            length = j - (states[i + 1] & ((1 << j) - 1)).bit_count()
            if length > j - (states[i] & ((1 << j) - 1)).bit_count():
                found.append(places[i])
                while j - (states[i + 1] & ((1 << j) - 1)).bit_count() == length:
                    j -= 1
    return sorted(found)


#: Bytes of a line's key: lines are told apart within the few pages they are compared with.
KEY = 6


def _line_key(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=KEY).digest()


def _split_keys(keys: bytes) -> list[bytes]:
    return [keys[i : i + KEY] for i in range(0, len(keys), KEY)]


OUTLINES = "url string, outline binary, keys binary, sizes array<int>"
PAGES = "page_id bigint, url string, outline binary, lines binary, declared boolean"
TEXTS = "page_id bigint, url string, text string"
SEPARATOR = "\n"


def _outline(lines: list[tuple[str, bool]]) -> bytes:
    """A digest of all lines of a page, whole."""
    digest = hashlib.blake2b(digest_size=16)
    for line, _ in lines:
        digest.update(line.encode() + b"\n")
    return digest.digest()


def _outlines(batches):
    """Line keys and line lengths of every page that has lines."""
    for batch in slices(batches):
        _, urls, pages = batch.columns
        parsed = [page_lines(p) for p in pages.to_pylist()]
        keys = [b"".join(_line_key(t) for t, _ in p) for p in parsed]
        rows = pa.RecordBatch.from_arrays(
            [
                urls,
                pa.array([_outline(p) for p in parsed], pa.binary()),
                pa.array(keys, pa.binary()),
                pa.array([[len(t) for t, _ in p] for p in parsed], pa.list_(pa.int32())),
            ],
            ["url", "outline", "keys", "sizes"],
        )
        yield rows.filter(pa.array([bool(k) for k in keys], pa.bool_()))


def _packed_lines(batches):
    """Lines of every page, packed, as they are shuffled; where some are declared, only those."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        ids, urls, pages = batch.columns
        parsed = [page_lines(p) for p in pages.to_pylist()]
        declared = [any(d for _, d in p) for p in parsed]
        texts = [
            SEPARATOR.join(t for t, own in p if own or not some) for p, some in zip(parsed, declared)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                urls,
                pa.array([_outline(p) for p in parsed], pa.binary()),
                pa.array([pack(t.encode()) for t in texts], pa.binary()),
                pa.array(declared, pa.bool_()),
            ],
            ["page_id", "url", "outline", "lines", "declared"],
        )


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def _addresses(pages: DataFrame, key: str, url: str) -> DataFrame:
    """Host, path and row of each page with a URL, stored in ``part`` ranges of that order."""
    address = F.coalesce(F.col(url), F.lit(""))
    narrow = pages.select(
        _host(address).alias("host"), _path(address).alias("path"), F.col(key).alias("row")
    ).where("host != ''")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(
        narrow.repartitionByRange(parts, "host", "path", "row").withColumn(
            "part", F.spark_partition_id()
        ),
        "addresses",
    )


def _steps(own: str, other: str) -> Column:
    """Path segments shared with a page of the same host; null for other hosts."""
    mine, theirs = F.split(F.col(own)["path"], "/"), F.split(F.col(other)["path"], "/")
    same = F.zip_with(mine, theirs, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.coalesce(F.array_position(same, False), F.lit(0))
    return F.when(F.col(other)["host"] == F.col(own)["host"], F.when(at == 0, 1 << 20).otherwise(at))


def _beside(places: DataFrame, names: tuple[str, ...] = ("before", "after")) -> DataFrame:
    """(``row``, ``near``, ``steps``, ``k``) of the pages of the same host beside ``own``."""
    near = [
        F.when(
            _steps("own", c).isNotNull(),
            F.struct(_steps("own", c).alias("steps"), F.col(c)["row"].alias("near"), F.lit(k).alias("k")),
        )
        for k, c in enumerate(names)
    ]
    return places.select(
        F.col("own.row").alias("row"), F.explode(F.array_compact(F.array(*near))).alias("n")
    ).select("row", "n.near", "n.steps", "n.k")


def nearest_pages(pages: DataFrame, key: str = "row", url: str = "url") -> DataFrame:
    """(``row``, ``near``): the pages next before and after each page of a host, by URL path.

    Pages are cut into ranges of (host, path, key) and sorted inside them, so a
    host with a third of all pages spreads over many tasks. The ends of ranges
    meet in one row per range. Pages without a URL have no neighbours.
    """
    return _neighbours(_addresses(pages, key, url))


def _neighbours(placed: DataFrame) -> DataFrame:
    order = Window.partitionBy("part").orderBy("host", "path", "row")
    place = F.struct("host", "path", "row")
    inside = placed.select(
        "part",
        place.alias("own"),
        F.lag(place).over(order).alias("before"),
        F.lead(place).over(order).alias("after"),
    )
    by_part = Window.orderBy("part")
    ends = (
        placed.groupBy("part")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .select(
            "part", F.lag("last").over(by_part).alias("ahead"), F.lead("first").over(by_part).alias("behind")
        )
    )
    joined = inside.join(ends, "part").select(
        "own",
        F.coalesce("before", "ahead").alias("before"),
        F.coalesce("after", "behind").alias("after"),
    )
    return _beside(joined)


def _past_copies(placed: DataFrame, copies: DataFrame) -> DataFrame:
    """Like ``nearest_pages``, but past runs of copies; ``copies``: rows that copy the page before."""
    by_part = Window.orderBy("part")
    order = Window.partitionBy("part").orderBy("host", "path", "row")
    flagged = placed.join(
        copies.select("row", F.lit(0).alias("start")), "row", "left"
    ).withColumn("start", F.coalesce("start", F.lit(1)))
    ahead = flagged.groupBy("part").agg(F.sum("start").alias("n")).select(
        "part", (F.sum("n").over(by_part) - F.col("n")).alias("ahead")
    )
    numbered = stored(
        flagged.withColumn("run", F.sum("start").over(order))
        .join(ahead, "part")
        .select(F.struct("host", "path", "row").alias("own"), (F.col("run") + F.col("ahead")).alias("run")),
        "runs",
    )
    runs = numbered.groupBy("run").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    return _beside(
        numbered.join(runs.select((F.col("run") + 1).alias("run"), F.col("last").alias("before")), "run", "left")
        .join(runs.select((F.col("run") - 1).alias("run"), F.col("first").alias("after")), "run", "left")
    )


def _met(near: DataFrame, outlines: DataFrame) -> DataFrame:
    """Own keys and sizes of each row of ``near``, and those of its near pages in order.

    Both sides grow with the pages, so they are merged, whatever their size.
    """
    others = (
        near.join(outlines.select(F.col("row").alias("near"), "keys", "total").hint("merge"), "near")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("far", -F.col("steps"), "k", "near", "keys", "total"))).alias("o"))
        .select("row", F.transform("o", lambda o: F.struct(*(o[c].alias(c) for c in ("far", "k", "keys", "total")))).alias("others"))
    )
    return outlines.join(others.hint("merge"), "row").select("row", "keys", "sizes", "others")


MET = "row bigint, gone array<int>, copied boolean"


def _first_shared(batches, copy_share):
    """Lines that a page beside shares; null where none tells. Whether the page after is a copy."""
    for batch in slices(batches):
        rows, *columns = batch.columns
        found, copied = [], []
        for own, sizes, others in zip(*(c.to_pylist() for c in columns)):
            own, total, gone, copy = _split_keys(own), sum(sizes), None, False
            for other in others:
                shared = shared_lines(own, _split_keys(other["keys"]))
                size = sum(sizes[i] for i in shared)
                if other["k"] == 1:
                    copy = size > copy_share * max(total, other["total"])
                if gone is None and shared and size <= copy_share * total:
                    gone = shared
            found.append(gone)
            copied.append(copy)
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(found, pa.list_(pa.int32())), pa.array(copied, pa.bool_())],
            ["row", "gone", "copied"],
        )


def _later_shared(batches, copy_share):
    """The same for pages with none but copies beside them: past the copies, or by two other pages."""
    for batch in slices(batches):
        rows, *columns = batch.columns
        found = []
        for own, sizes, others in zip(*(c.to_pylist() for c in columns)):
            own, total, gone = _split_keys(own), sum(sizes), None
            seen = [0] * len(own)
            for other in others:
                shared = shared_lines(own, _split_keys(other["keys"]))
                size = sum(sizes[i] for i in shared)
                if other["far"] == 0 and shared and size <= copy_share * total:
                    gone = shared
                    break
                for i in shared:
                    seen[i] += 1
            if gone is None:
                gone = [i for i, n in enumerate(seen) if n > 1]
                if total - sum(sizes[i] for i in gone) < LEAST_MOST:
                    gone = []  # copies but for a date or a number, not a text under a template
            found.append(gone)
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(found, pa.list_(pa.int32())), pa.nulls(len(found), pa.bool_())],
            ["row", "gone", "copied"],
        )


def _texts(batches):
    """Texts of pages without the lines that are gone, where markup does not object."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches):
        *keep, lines, declared, gone = batch.columns
        texts = []
        for packed, some, out in zip(*(c.to_pylist() for c in (lines, declared, gone))):
            text = unpack(packed).decode().split(SEPARATOR)
            # Markup has the last word on a line: declared ones stay, and the others go beside them.
            out = set() if some else set(out or ())
            texts.append(" ".join(t for i, t in enumerate(text) if i not in out))
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def main_text(pages: DataFrame, copy_share: float = 0.8) -> DataFrame:
    """(``page_id``, ``url``, ``text``), one row per page, from the whole html.

    A page becomes lines (its blocks, with references decoded and white space
    as single blanks), without menus, headers, footers, sidebars, notices,
    adverts, forms, comments, scripts and styles, which markup names.

    Every page is paired with its nearest page by URL path on the same host,
    their lines are aligned by a longest common subsequence, and shared lines
    are deleted as template. Markup then confirms or vetoes single lines: those
    inside an element that declares main text (article, main) stay, shared or
    not, and beside them the others go. Pages of a host
    with equal lines count as one, at the least of their addresses. A neighbour
    that shares no line tells nothing, and one that shares more than
    ``copy_share`` of the page's characters may be a copy: then the nearest
    pages past the run of copies are taken. Where these do not tell either, the
    lines go that two other pages share, unless next to nothing would be left.
    Only line keys of neighbours are joined; packed lines meet the positions that
    go, once.

    A null html gives an empty text. Pages with a null or odd URL have no
    neighbours. Null or repeated ids and repeated rows each keep their row.
    Other columns are ignored. An empty table gives an empty result.
    """
    source = pages.select("page_id", "url", "html")
    host = _host(F.coalesce("url", F.lit("")))
    outlines = stored(
        source.mapInArrow(_outlines, OUTLINES)
        .withColumn("host", host)
        .where("host != ''")
        .groupBy("host", "outline")
        .agg(
            F.min(F.struct(_path(F.col("url")).alias("path"), "url")).alias("at"),
            F.first("keys").alias("keys"),
            F.first("sizes").alias("sizes"),
        )
        .select("host", "outline", "at.url", "keys", "sizes")
        .withColumn("total", F.aggregate("sizes", F.lit(0), lambda n, x: n + x))
        .withColumn("row", F.monotonically_increasing_id()),
        "outlines",
    )
    placed = _addresses(outlines, "row", "url")
    near = stored(_neighbours(placed).withColumn("far", F.lit(0)), "near")
    first = stored(
        _met(near, outlines).mapInArrow(lambda batches: _first_shared(batches, copy_share), MET), "first"
    )
    open_rows = first.where("gone IS NULL").select("row")
    copies = (
        near.where("k = 1").join(first.where("copied").hint("merge"), "row").select(F.col("near").alias("row"))
    )
    open_rows = open_rows.hint("merge")
    past = _past_copies(placed, copies).join(open_rows, "row", "left_semi").withColumn("far", F.lit(0))
    beside = near.join(open_rows, "row", "left_semi").withColumn("far", F.lit(1))
    beyond = beside.select("row", F.col("near").alias("mid"), "k").join(
        near.select(F.col("row").alias("mid"), "near", "steps", "k").hint("merge"), ["mid", "k"]
    ).select("row", "near", "steps", "k", F.lit(2).alias("far"))
    candidates = (
        past.unionByName(beside).unionByName(beyond)
        .groupBy("row", "near")
        .agg(F.min("far").alias("far"), F.max("steps").alias("steps"), F.min("k").alias("k"))
    )
    later = _met(candidates, outlines).mapInArrow(
        lambda batches: _later_shared(batches, copy_share), MET
    )
    gone = first.unionByName(later).where("size(gone) > 0").select("row", "gone")
    template = outlines.select("row", "host", "outline").join(gone.hint("merge"), "row").drop("row")
    return (
        source.mapInArrow(_packed_lines, PAGES)
        .withColumn("host", host)
        .join(template.hint("merge"), ["host", "outline"], "left")
        .select("page_id", "url", "lines", "declared", "gone")
        .mapInArrow(_texts, TEXTS)
    )
