"""Main text of web pages: structure marks what it can, differencing against the nearest page the rest.

A page's lines are its block-level texts. Structure decides two kinds: lines inside an article or
main element are text, lines inside menus, headers, footers, sidebars, notices, adverts, forms and
comments are not. Lines of neither kind are open, as are those in an article whose name may be either.
Pages stand by URL path within their host; a page's lines are aligned with those of its neighbours on
either side by longest common subsequence, and its open lines that are shared are deleted.

Differencing alone does not give right results on pages whose menus differ from page to page and
whose articles repeat passages (README has the figures), so it decides open lines only. Lines travel
as 64-bit hashes; texts stay where they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .url_filter import host_of, path_of

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Starts of these do not end an open paragraph, and none is looked for beyond SCOPE_TAGS.
IN_PARAGRAPH = frozenset("body caption html legend optgroup option select tbody td tfoot th thead tr".split())
SCOPE_TAGS = frozenset("button caption html object table td template th".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Whatever these are called, they hold the page or its text.
ROOT_TAGS = MAIN_TAGS | {"html", "body"}
SKIP_TAGS = frozenset("nav header footer aside menu dialog button select textarea head noscript template svg iframe object canvas audio video".split())
_NAMES = (
    r"(?:(?:site|page|main|top|global|primary)[-_]?)?(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|popup|modal|overlay|"
    r"sidebar|side-bar|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|header|footer|comments?|disqus|replies|respond|share|sharing|social|related|toolbar|login|search)"
)
_PARTS = (
    r"(?:[-_](?:bars?|box(?:es)?|links?|lists?|menus?|nav|wrap|wrapper|container|inner|outer|area|section|blocks?|widgets?|items?|text|messages?|banners?|buttons?|icons?|forms?|panels?|content|top|bottom|"
    r"left|right|main|header|footer|notices?|posts?|articles?|stories|units?|slots?|signup|popup|overlay|modal|body|title|media|count|thread|\d[\dx]*))*"
)
#: Names of what is no text; with other endings (social-history) they may be anything, which differencing decides.
SKIP_NAMES = re.compile(rf"(?:^|\s){_NAMES}{_PARTS}(?=\s|$)", re.I)
SOFT_NAMES = re.compile(rf"(?:^|\s){_NAMES}[-_][\w-]*(?=\s|$)", re.I)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Text of these is never markup; it ends at the element's own end tag only.
RAW = re.compile(r"(?is)<(script|style|title|textarea|xmp|noembed|noframes)\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)")
#: A quote opens a value only behind an equals sign; nothing here is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
TAG_START = re.compile(r"</?[a-zA-Z]")
NAMES = re.compile(r"(?i)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none")
#: Kinds of lines: in an article or main element; of no marked place; in a form; in an article in an article; of a name that may be anything.
MAIN, OPEN, FORM, INNER, SOFT = 1, 0, 2, 3, 4
SKIPPED = "skipped"
#: Start tags that end an open element of a kind, and those it is not looked for beyond: (ended, ends, limits).
_IMPLIED = (
    (("p",), frozenset(("p",)), SCOPE_TAGS),
    (("li",), frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    (("dd", "dt"), frozenset(("dd", "dt")), frozenset(("dl",))),
    (("td", "th"), frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), frozenset(("table",))),
    (("tr",), frozenset(("tr", "tbody", "thead", "tfoot")), frozenset(("table",))),
)
_ENDED = {name: k for k, (names, _, _) in enumerate(_IMPLIED) for name in names}
_LIMITS = {name: [k for k, row in enumerate(_IMPLIED) if name in row[2]] for name in frozenset().union(*(row[2] for row in _IMPLIED))}
_ENDS = {name: [k for k, row in enumerate(_IMPLIED) if name in row[1]] for name in BLOCK_TAGS}
for _name in BLOCK_TAGS - IN_PARAGRAPH - {"p"}:
    _ENDS[_name] = [0, *_ENDS[_name]]


def _place(name: str, attributes: str, kind: int | str) -> int | str:
    """Where an element's lines are, given where it is itself."""
    if kind == SKIPPED or (name in SKIP_TAGS and not (name == "header" and kind in (MAIN, INNER))):
        return SKIPPED
    inner = name == "article" and kind in (MAIN, INNER)
    soft = False
    if attributes and (name not in ROOT_TAGS or inner):
        for key, value in NAMES.findall(attributes):
            value = value.strip("\"'")
            if value.lower() in SKIP_ROLES if key.lower() == "role" else SKIP_NAMES.search(value):
                return SKIPPED
            soft = soft or key.lower() != "role" and bool(SOFT_NAMES.search(value))
        if HIDDEN.search(attributes):
            return SKIPPED
    if inner:
        return INNER
    if name in MAIN_TAGS or 'role="main"' in attributes:
        return MAIN
    if name == "form":
        return FORM
    return SOFT if soft and kind == MAIN else kind


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, kind) of a page in order, without what its structure marks as no text. Time is linear in the page."""
    found: list[tuple[str, int]] = []
    block: list[str] = []
    stack: list[tuple[str, int | str, tuple[int, ...]]] = []  # name, kind of its lines, where open elements that a start may end are
    opened: Counter = Counter()
    kind: int | str = OPEN
    of = OPEN  # kind of the block's text
    nowhere = (-1,) * len(_IMPLIED)

    def flush() -> None:
        if block:
            line = " ".join("".join(block).split())
            if line:
                found.append((line, of))
            block.clear()

    def cut(to: int) -> int | str:
        for name, _, _ in stack[to:]:
            opened[name] -= 1
        del stack[to:]
        return stack[-1][1] if stack else OPEN

    source = RAW.sub(lambda m: " " if m[0][:2] in ("<!", "<?") else "", page or "")
    tag, at, search = TAG, 0, 0
    while True:
        begin = source.find("<", search)
        m = tag.match(source, begin) if begin >= 0 else None
        if m is None and begin >= 0:
            if not TAG_START.match(source, begin):
                search = begin + 1
                continue
            if tag is TAG:  # a value that is never closed: from here on a tag ends at the next >
                tag = CUT_TAG
                continue
        if kind != SKIPPED:
            piece = source[at : begin if begin >= 0 else len(source)]
            if piece:
                of = kind
                block.append(html.unescape(piece) if "&" in piece else piece)
        if m is None:  # the end, or a tag cut off by it
            break
        at = search = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            block.append(" ")
        if closing:
            if name == "p":
                if stack and stack[-1][2][0] >= 0:
                    kind = cut(stack[-1][2][0])
            elif opened[name]:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                kind = cut(to)
            continue
        for k in _ENDS.get(name, ()):
            if stack and stack[-1][2][k] >= 0:
                kind = cut(stack[-1][2][k])
        if name in VOID_TAGS:
            continue
        if name in BLOCK_TAGS or name in SKIP_TAGS or "class" in attributes or "id=" in attributes or "role" in attributes:
            if attributes.endswith("/") and name not in BLOCK_TAGS:
                continue
            open_ = list(stack[-1][2] if stack else nowhere)
            for k in _LIMITS.get(name, ()):
                open_[k] = -1
            if name in _ENDED:
                open_[_ENDED[name]] = len(stack)
            kind = _place(name, attributes, kind)
            stack.append((name, kind, tuple(open_)))
            opened[name] += 1
    flush()
    return found


def decide(lines: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """(line, whether differencing decides it) of the lines that may be text.

    Lines of an article are text, and open lines are not if the articles hold most of the page's text;
    where they do not, they are teasers. A form's lines are text if they are most of the page (some
    pages are one form), those of an article in an article (comments) if they outweigh the outer one.
    """
    size = Counter()
    for line, kind in lines:
        size[kind] += len(line)
    main = size[MAIN] + size[SOFT]
    inner = size[INNER] > main
    main += inner * size[INNER]
    form = size[FORM] > main + size[OPEN]
    open_ = size[OPEN] + form * size[FORM] > main
    keeps = {MAIN: True, SOFT: True, INNER: inner, FORM: form and open_, OPEN: open_}
    return [(line, kind not in (MAIN, INNER)) for line, kind in lines if keeps[kind]]


def _prefixes(ours: list, theirs: list) -> np.ndarray:
    """Lengths of the longest common subsequences of all beginnings of `ours` with the whole of `theirs`, bits of a number at a time."""
    at: dict = {}
    for i, line in enumerate(ours):
        at[line] = at.get(line, 0) | 1 << i
    whole = (1 << len(ours)) - 1
    row = whole
    for line in theirs:
        both = row & at.get(line, 0)
        row = ((row + both) | (row - both)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(ours) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(ours)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared(ours: list, theirs: list) -> set[int]:
    """Positions in `ours` of a longest common subsequence with `theirs`, in linear space: halves are aligned by themselves."""
    kept: set[int] = set()
    todo = [(0, len(ours), 0, len(theirs))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and ours[a] == theirs[c]:
            kept.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and ours[b - 1] == theirs[d - 1]:
            b, d = b - 1, d - 1
            kept.add(b)
        if a == b or c == d:
            continue
        if d - c == 1:
            kept.update([next((i for i in range(a, b) if ours[i] == theirs[c]), -1)])
            continue
        half = (c + d) // 2
        split = a + int((_prefixes(ours[a:b], theirs[c:half]) + _prefixes(ours[a:b][::-1], theirs[half:d][::-1])[::-1]).argmax())
        todo += [(a, split, c, half), (split, b, half, d)]
    return kept - {-1}


_SCHEMA = "row long, page_id {kind}, url string, host string, path string, lines array<string>, open array<int>, hashes array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, opened, hashes = [], [], []
        for page in batch.column("html"):
            got = decide(lines_of(page.as_py()))
            lines.append([t for t, _ in got])
            opened.append([i for i, (_, loose) in enumerate(got) if loose])
            hashes.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in got] if opened[-1] else [])
        columns = [batch.column(c) for c in ("row", "page_id", "url", "host", "path")]
        columns += [pa.array(lines, pa.list_(pa.string())), pa.array(opened, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "page_id", "url", "host", "path", "lines", "open", "hashes"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for row, ours, before, after in zip(*(batch.column(c) for c in ("row", "hashes", "before", "after"))):
            mine = ours.as_py()
            gone = set()
            for other in (before.as_py(), after.as_py()):
                if other:
                    gone |= shared(mine, other)
            rows.append(row.as_py())
            found.append(sorted(gone))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["row", "gone"])


def neighbours(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(row, hashes, before, after): the lines of the pages next to each in its host, by path.

    Range partitions of the order, each with a window of its own; a partition's first and last rows
    look at the table of partition ends, so no window spans a host and no pair is missed.
    """
    order = ["host", "path", "page_id", "row"]
    sorted_ = pages.select("row", "page_id", "host", "path", "hashes").repartitionByRange(*order).sortWithinPartitions(*order)
    table = scratch.write(sorted_.select("row", F.struct("host", "hashes").alias("page"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "order")
    ends = table.groupBy("part").agg(F.min_by("page", "place").alias("first"), F.max_by("page", "place").alias("last"))
    over = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(over).alias("last_before"), F.lead("first").over(over).alias("first_after"))
    inner = Window.partitionBy("part").orderBy("place")
    near = table.select("*", F.lag("page").over(inner).alias("lag"), F.lead("page").over(inner).alias("lead")).join(ends, "part")
    before, after = F.coalesce("lag", "last_before"), F.coalesce("lead", "first_after")
    at = F.col("page")["host"]
    return near.select("row", F.col("page")["hashes"].alias("hashes"), F.when(before["host"] == at, before["hashes"]).alias("before"), F.when(after["host"] == at, after["hashes"]).alias("after"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per page.

    Null and empty html give an empty text; pages without an address have an empty host and are
    neighbours of each other. Repeated rows have a row each. Pages of one host with the same lines are
    copies: they are differenced as one page, at its smallest path, so they never delete each other's text. Unclosed, misnested and
    cut-off markup is read to its end. Other columns are ignored; empty tables give empty results.
    """
    scratch = Scratch(pages.sparkSession, "html")
    url = F.col(url_col)
    slim = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    parsed = scratch.write(slim.mapInArrow(_parse, _SCHEMA.format(kind=kind)), "parsed")
    open_pages = parsed.where(F.size("open") > 0)
    text = F.array_join("lines", "\n\n")
    settled = parsed.where(F.size("open") == 0).select("page_id", "url", text.alias("text"))
    if open_pages.isEmpty():
        return settled
    copies = F.xxhash64("host", "hashes")
    one = open_pages.groupBy(copies.alias("row"), "host").agg(F.min(F.struct("path", "page_id")).alias("at"), F.first("hashes").alias("hashes"))
    one = scratch.write(one.select("row", "at.page_id", "host", "at.path", "hashes"), "one")
    gone = scratch.write(neighbours(scratch, one).mapInArrow(_compare, "row long, gone array<int>"), "gone").withColumnRenamed("row", "_row")
    left = open_pages.join(gone, copies == F.col("_row"), "left")
    kept = F.filter("lines", lambda line, i: ~F.coalesce(F.array_contains("gone", i) & F.array_contains("open", i), F.lit(False)))
    return settled.unionByName(left.select("page_id", "url", F.array_join(kept, "\n\n").alias("text")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_text of all pages, with the number of code points; null and empty html give an empty text of 0."""
    text = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.select("*", F.length("text").cast("long").alias("n_chars"))
