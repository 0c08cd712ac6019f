"""Main text of web pages: differencing against the page with the nearest URL, and the containers of the lines."""

from __future__ import annotations

import bisect
import html as html_lib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import common_lines
from .urls import host_and_path

#: Where a line stands: in an explicit container of the main text, in none that says anything, in one whose class speaks of boilerplate, in one that is never main text.
MAIN, OPEN, SOFT, HARD = range(4)

_SKIPPED = frozenset("script style noscript template svg iframe object select textarea button head title canvas audio video datalist math applet".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are not tracked: they hold no blocks, or nothing at all.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside form menu dialog".split())
#: An open element of these ends where another of the same kind begins.
_SIBLINGS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_LIMITS = frozenset("ul ol dl table div article section main blockquote body".split())
#: Elements whose text goes on to the end of the page where they are not closed.
_RAW = frozenset("script style textarea title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPEAKS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related recommended search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget footer header".split())
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_NEUTRAL = frozenset("article body container content entry has layout main no page post text title with without wrapper".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _zone(tag: str, attributes: str, outer: int) -> int:
    """The zone inside an element, from its name, its class, id and role, and the zone around it."""
    if outer == HARD or tag in _NEVER:
        return HARD
    marks = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = marks.get("role", "")
    if role in _ROLES or "hidden" in marks or marks.get("aria-hidden") == "true":
        return HARD
    spoken = False
    for name in (marks.get("class", "") + " " + marks.get("id", "")).split():
        tokens = set(re.split(r"[_\-\d]+", name))
        if tokens & _COMMENTS and not tokens & {"no", "without", "has", "with"}:
            return HARD
        spoken |= bool(tokens & _SPEAKS) and not tokens & _NEUTRAL
    if tag in ("article", "main") or role == "main" or marks.get("itemprop") == "articlebody":
        return SOFT if spoken else MAIN
    if tag in ("html", "body"):
        return outer
    if spoken or tag == "header" and outer != MAIN:
        return HARD if outer == MAIN else SOFT
    return outer


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """The text of each block of a page, in page order, and its zone.

    A block ends where a block element begins or ends, and where the zone changes. Character
    references are decoded, white space (no-break space included) becomes one space, blocks without
    text go. Scripts, styles, forms' controls, the head and comments have no text. Unclosed and
    unmatched tags are taken as they come; a tag cut off by the end of the page is dropped.
    """
    html = html or ""
    lines: list[str] = []
    zones: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    endless: set[str] = set()
    zone, at = OPEN, 0

    def end_block() -> None:
        if held:
            if text := " ".join(html_lib.unescape("".join(held)).split()):
                lines.append(text)
                zones.append(zone)
            held.clear()

    def close(names: set[str], barrier: frozenset[str] = frozenset()) -> None:
        nonlocal zone
        if not any(opened.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                end_block()
                zone = stack[depth][1]
                for name, _ in stack[depth:]:
                    opened[name] -= 1
                del stack[depth:]
                return
            if stack[depth][0] in barrier:
                return

    while token := _TOKEN.search(html, at):
        if token.start() > at:
            held.append(html[at : token.start()])
        at = token.end()
        if token[2] is None:  # a comment, a declaration or a tag without an end
            continue
        tag = token[2].lower()
        if tag in _SKIPPED:
            held.append(" ")
            if token[1] or token[3].endswith("/") or tag in endless:
                continue
            if end := re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at):
                at = end.end()
            elif tag in _RAW:
                at = len(html)
            else:
                endless.add(tag)
        elif token[1]:
            if tag in _BLOCKS:
                end_block()
            close({tag})
        else:
            if tag in _BLOCKS:
                end_block()
                if tag in _SIBLINGS:
                    close(_SIBLINGS[tag], _LIMITS)
                elif opened.get("p"):
                    close({"p"}, _LIMITS)
            if tag == "br":
                held.append(" ")
            if tag in _INLINE or tag in _VOID or token[3].endswith("/"):
                continue
            inner = _zone(tag, token[3], zone)
            if inner != zone:
                end_block()
            stack.append((tag, zone))
            opened[tag] = opened.get(tag, 0) + 1
            zone = inner
    if at < len(html):
        held.append(html[at:])
    end_block()
    return lines, zones


@dataclass
class _Page:
    """A page on its way through the stream of pages in URL order."""

    row: tuple
    host: str
    path: str
    context: bool
    lines: list[str] = field(default_factory=list)
    zones: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)


def shared_with(page: _Page, other: _Page, most: float) -> set[int] | None:
    """Lines of `page` that a longest common subsequence with `other` takes; None if they hold more than the share `most` of its text, as then the pages are copies and tell nothing."""
    found = common_lines(page.hashes, other.hashes)
    total = sum(len(x) for x in page.lines)
    return None if sum(len(page.lines[i]) for i in found) > most * total else set(found)


def nearness(a: str, b: str) -> tuple[int, int]:
    """How much of the beginning of two paths is equal: whole segments, then characters."""
    n = len(os.path.commonprefix([a, b]))
    return a.count("/", 0, n) + (n == len(a) == len(b)), n


def main_lines(page: _Page, shared: set[int]) -> list[int]:
    """Lines that stay: those in main containers where the page has any; else those in no telling container that are not shared with the nearest page.

    The containers check what the differencing found: a passage that two articles share is not
    deleted from their articles, and a menu that differs from the nearest page's is.
    """
    main = [i for i, z in enumerate(page.zones) if z == MAIN]
    return main or [i for i, z in enumerate(page.zones) if z == OPEN and i not in shared]


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.8, ranges: int | None = None) -> DataFrame:
    """(id, url, text, n_chars, n_lines, n_shared) of every page: its main text, its code points, its blocks of text, and how many of them the nearest page shares.

    Pages are put in the order of (host, path, id, url). A page's partner is that neighbour of its
    host whose path begins most like its own (whole segments, then characters; the earlier one if
    both do), which is the nearest of the host, as paths are sorted. Their lines are aligned by a
    longest common subsequence and shared lines are deleted. If more than `copy_share` of a page's
    text is shared, the two are copies: the other neighbour takes the partner's place, and without
    one nothing is deleted. Then main_lines() checks the deletion against the lines' containers.

    The keys alone are sorted first, for the boundaries of `ranges` key ranges (four for each shuffle
    partition); then each page is sent to its range once, and the first and last page of a range to
    the neighbouring range too, so a page meets its neighbours whatever host it belongs to, and a
    host with most of the pages lies in many ranges. A task streams through its ranges and holds
    three pages at a time.

    Null or empty html gives an empty text; pages with a null or hostless url have no partner; null
    ids and repeated rows pass through; an empty table gives an empty result; other columns are not
    read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    page_id, url = F.col(id_col).cast("long"), F.col(url_col).cast("string")
    place = [host.alias("host"), path.alias("path"), F.coalesce(page_id, F.lit(-(1 << 63))).alias("place"), F.coalesce(url, F.lit("")).alias("address")]
    names = ["host", "path", "place", "address"]
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct(*names)
    parts = pages.select(*place).repartitionByRange(n, *names).groupBy(F.spark_partition_id().alias("part")).agg(F.min(own).alias("lo"), F.max(own).alias("hi")).collect()
    bounds = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in parts)
    # code points and UTF-8 bytes sort alike
    sent = spark.sparkContext.broadcast(([lo for lo, _ in bounds], [hi for _, hi in bounds]))

    @F.pandas_udf("array<struct<part: int, context: boolean>>")
    def targets(host: pd.Series, path: pd.Series, place: pd.Series, address: pd.Series) -> pd.Series:
        los, his = sent.value
        out = []
        for key in zip(host, path, place, address):
            i = bisect.bisect_left(his, key)
            to = [(i, False)]
            if i and key == los[i]:
                to.append((i - 1, True))
            if i + 1 < len(his) and key == his[i]:
                to.append((i + 1, True))
            out.append(to)
        return pd.Series(out)

    rows = pages.select(page_id.alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), *place)
    dealt = rows.withColumn("to", F.explode(targets(*names))).select("page_id", "url", "html", *names, "to.part", "to.context")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", *names, "context")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Page | None = None
        page: _Page | None = None
        done: dict[str, list] = {}

        def finish(after: _Page | None) -> None:
            if page is None or page.context:
                return
            near = [x for x in (before, after) if x is not None and x.host == page.host and page.host]
            near.sort(key=lambda x: nearness(page.path, x.path), reverse=True)
            shared = next((s for x in near if (s := shared_with(page, x, copy_share)) is not None), set())
            text = "\n".join(page.lines[i] for i in main_lines(page, shared))
            for name, value in zip(("page_id", "url", "text", "n_chars", "n_lines", "n_shared"), (*page.row, text, len(text), len(page.lines), len(shared)), strict=True):
                done.setdefault(name, []).append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(done.get(f.name, []), f.type) for f in _RESULT], schema=_RESULT)
            done.clear()
            return batch

        last = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "host", "path", "part", "context")]
            for i in range(batch.num_rows):
                page_id, url, html, host, path, part, context = (c[i].as_py() for c in columns)
                new = _Page((page_id, url), host, path, context, *page_lines(html))
                new.hashes = [xxhash.xxh3_64_intdigest(x) for x in new.lines]
                if part != last:
                    finish(None)
                    before = page = None
                    last = part
                finish(new)
                before, page = page, new
                if len(done.get("text", ())) >= 200:
                    yield flush()
        finish(None)
        yield flush()

    return dealt.mapInArrow(stream, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long").withColumnsRenamed({"page_id": id_col, "url": url_col})


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])
