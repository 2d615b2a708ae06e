"""Main text of web pages by differencing each page against the nearest one of its host.

A page becomes a list of lines, one for each block element. Elements that are no article by their
kind, class or role (menus, headers, forms, scripts, ...) are left out while reading. What a page
marks as its article (``article``, ``main``) is its text. Of a page without such a mark, the lines
are aligned with those of the page whose URL path is nearest within the host, by their longest
common subsequence; what both have is the site's template and is deleted, what is left is the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import materialize, shuffle_partitions

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9-]*)")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_HEADING = re.compile(r"h[1-6]\Z")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
_SKIPPED = frozenset("nav footer aside form button select menu dialog object embed canvas audio video head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe "
    "subscription signup login sidebar sidenav side menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended recommendations comment comments respond replies "
    "disqus footer masthead topbar toolbar widget widgets complementary contentinfo search".split()
)


#: Names that mean the same as a part of a longer class name ("comment-body", "left-sidebar").
_STRONG = _NOT_TEXT - frozenset("side search notice notices alert popup modal overlay login widget widgets related".split())
#: What such a part does not mean after one of these ("with-sidebar", "no-comments") or before one ("comments-open").
_ABOUT = frozenset("no not non with without has have hide hidden show single layout is".split())
_STATE = frozenset("open opened closed close on off enabled disabled count free".split())
_HEADERS = frozenset("header site-header page-header main-header global-header top-header".split())
_MAIN = frozenset(("article", "main"))


def _is_noise(tag: str, attributes: str, marked: bool) -> bool:
    """Whether an element is no article text by its class, id or role.

    An id or a role counts as a whole, so "side-effects" names a section; a class counts as a whole or
    by its first or last part. An element that is an article itself goes by whole classes and first
    parts, a heading or a paragraph by whole classes only.
    """
    if not attributes or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return tag not in _MAIN
    for found in _MARKS.finditer(attributes):
        text = (found[1] or found[2] or found[3] or "").lower()
        names = text.split()
        if not _NOT_TEXT.isdisjoint(n.replace("_", "-") for n in names):
            return tag not in _MAIN or found[0][:2].lower() != "id"
        if not marked and tag not in _MAIN and not _HEADERS.isdisjoint(names) and not _HEADING.match(tag):
            return True
        if found[0][:5].lower() != "class" or tag == "p" or _HEADING.match(tag):
            continue
        for name in names:
            parts = re.split(r"[_-]+", name)
            if len(parts) < 2 or parts[0] in _ABOUT or parts[-1] in _STATE:
                continue
            if parts[0] in _STRONG or tag not in _MAIN and parts[-1] in _STRONG:
                return True
    return False


def page_lines(source: str) -> tuple[list[str], list[str]]:
    """The lines inside the page's article, and those outside it that are not left out by kind.

    Character references are decoded, white space within a line becomes one space. An element that is
    left out ends with its own tag or with the article around it, whatever articles (comments, teasers)
    it holds; where it is never closed it ends at the page's first article.
    """
    inside: list[str] = []
    outside: list[str] = []
    parts: list[str] = []
    skip, depth = "", 0  # the element that is left out, and how often its kind is open in it
    inner = 0  # articles open inside it
    marked = 0
    last_end: dict[str, int] = {}

    def never_closed(tag: str, at: int) -> bool:
        if not last_end:
            last_end.update((m[1].lower(), m.start()) for m in _END.finditer(source))
        return last_end.get(tag, -1) < at

    def flush() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                (inside if marked else outside).append(line)

    at = 0
    for token in _TOKEN.finditer(source):
        if not skip and token.start() > at:
            parts.append(source[at : token.start()])
        at = token.end()
        if token[3] is None:
            continue
        tag, closing = token[3].lower(), bool(token[2])
        if skip:
            if tag == skip:
                depth += -1 if closing else 1
                if depth > 0 and not (tag == "p" and not closing):
                    continue
                skip = ""
                if closing:
                    continue
            elif tag in _MAIN:
                if closing:
                    if inner or not marked:
                        inner = max(0, inner - 1)
                        continue
                elif inside or marked or not never_closed(skip, at):
                    inner += 1
                    continue
                skip = ""
            elif tag == "body" or skip == "p" and tag not in _INLINE and not closing:
                skip = ""  # it was never closed
            else:
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        left_out = not closing and tag not in _VOID and (
            tag in _SKIPPED or tag == "header" and not marked or _is_noise(tag, token[4], marked > 0)
        )
        if left_out:
            if tag in _INLINE:
                parts.append(" ")
            skip, depth, inner = tag, 1, 0
        elif tag in _MAIN:
            marked = max(0, marked + (-1 if closing else 1))
    if not skip:
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)  # a tag that the page's end cuts off
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return inside, outside


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (longest increasing run of matches)."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out: list[int] = []
    node = nodes[-1] if nodes else None
    while node is not None:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _difference(mine: list[str], other: list[str]) -> list[str]:
    """``mine`` without the lines shared with ``other``; a copy of the page teaches nothing."""
    if mine == other:
        return mine
    shared = set(common_lines(mine, other))
    return [line for k, line in enumerate(mine) if k not in shared]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        main, rest = [], []
        for source in batch["html"].to_pylist():
            inside, outside = page_lines(source or "")
            main.append("\n".join(inside) if inside else None)
            rest.append([] if inside else outside)
        yield pa.record_batch(
            [*(batch[c] for c in ("page_id", "url", "host", "path")), pa.array(main, pa.string()),
             pa.array(rest, pa.list_(pa.string()))],
            names=["page_id", "url", "host", "path", "main", "rest"],
        )


def _alike(one: str | None, two: str | None) -> int:
    n = 0
    for a, b in zip(one or "", two or "", strict=False):
        if a != b:
            break
        n += 1
    return n


def _against_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order, piece by piece: each against the nearer of the two different pages around it.

    A run is pages that follow each other with one host and equal lines. The pages before and after
    it are the nearest ones that differ. A lent page only serves as a partner.
    """

    def settle(before: dict | None, run: list[dict], after: dict | None) -> list[tuple]:
        first = run[0]
        near = [p for p in (before, after) if p and (p["piece"], p["host"]) == (first["piece"], first["host"])]
        left: dict[int, str] = {}  # by partner: equal lines are compared once
        out = []
        for page in run:
            if page["lent"]:
                continue
            k = max(range(len(near)), key=lambda k: _alike(near[k]["path"], page["path"]), default=-1)
            if k not in left:
                left[k] = "\n".join(_difference(first["rest"], near[k]["rest"]) if near else first["rest"])
            out.append((page["page_id"], page["url"], left[k]))
        return out

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )

    before: dict | None = None
    run: list[dict] = []
    for batch in batches:
        rows = []
        for page in batch.to_pylist():
            if run and all(page[c] == run[0][c] for c in ("piece", "host", "rest")):
                page["rest"] = None  # the run's first page holds it
                run.append(page)
                continue
            if run:
                rows += settle(before, run, page)
                before = run[-1] | {"rest": run[0]["rest"]}
            run = [page]
        yield out(rows)
    if run:
        yield out(settle(before, run, None))


def _lent(pieces: list[dict]) -> list[tuple[int, int]]:
    """``(place, piece)``: pages that pieces need from others, as the nearest different ones of their
    first and last runs. ``pieces`` are in order; a run can go through any number of them."""
    out = []
    for this, other, way in (("first", "last", pieces), ("last", "first", pieces[::-1])):
        run = end = beyond = None  # the run before this piece, its near page, the near page of the run before it
        for p in way:
            mine = p[this]
            near = beyond if run is not None and mine["run"] == run else end
            if near is not None and near["host"] == mine["host"]:
                out.append((near["place"], p["piece"]))
            far = p[other]
            if p[f"next_{other}"] is not None:  # the piece has several runs
                beyond = p[f"next_{other}"]
            elif mine["run"] != run:
                beyond = end
            run, end = far["run"], far
    return out


def _piece_ends(placed: DataFrame) -> list[dict]:
    """For each piece, its outermost pages and, going inwards, the first ones of another run."""
    keys = placed.select(
        "piece", "place",
        F.struct("place", "host", F.struct("host", F.xxhash64("rest"), F.md5(F.to_json("rest"))).alias("run")).alias("page"),
    )
    ends = keys.groupBy("piece").agg(F.min_by("page", "place").alias("first"), F.max_by("page", "place").alias("last"))
    inner = keys.join(ends, "piece")
    after, before = (F.when(F.col("page.run") != F.col(f"{end}.run"), F.col("place")) for end in ("first", "last"))
    inner = inner.groupBy("piece").agg(
        F.first("first").alias("first"), F.first("last").alias("last"),
        F.min_by("page", after).alias("next_first"), F.max_by("page", before).alias("next_last"),
    )
    return sorted((r.asDict(recursive=True) for r in inner.collect()), key=lambda p: p["piece"])


def _differenced(unmarked: DataFrame) -> DataFrame:
    """``page_id, url, text`` of pages with a host and lines, each against its nearest different one."""
    spark = unmarked.sparkSession
    order = ["host", "path", "page_id", "url", "rest"]
    ranged = unmarked.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # places grow along the order: the piece is in their upper bits
    placed = ranged.withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("piece", F.shiftright("place", 33)), "pages-in-order")
    lent = spark.createDataFrame(_lent(_piece_ends(placed)), "_place long, _piece long")
    rows = placed.withColumn("lent", F.lit(False)).unionByName(
        placed.join(lent, F.col("place") == F.col("_place"))
        .withColumn("piece", F.col("_piece"))
        .drop("_place", "_piece")
        .withColumn("lent", F.lit(True))
    )
    pieces = rows.repartition(shuffle_partitions(spark), "piece").sortWithinPartitions("piece", "place")
    return pieces.mapInArrow(_against_nearest, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    A page with an article is its article, whatever lies beside it: passages that articles share are
    their text. Only pages without one are differenced, each against the nearest such page of its
    host, before or after it in the order of (host, path, id), whose lines differ from its own. They
    are sorted into ranges, so that a large host is many tasks; pages that a range needs from
    another one are lent to it, so that the cuts decide nothing. A page alone with its lines, or one
    without a readable url, keeps them all. Null html is an empty text. Repeated and null ids are kept.
    """
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1).alias("path"),
        "html",
    )
    read = rows.mapInArrow(
        _read, "page_id long, url string, host string, path string, main string, rest array<string>"
    )
    read = materialize(read, "page-lines")
    paired = F.col("main").isNull() & (F.col("host") != "") & (F.size("rest") > 0)
    alone = read.where(~paired).select(
        "page_id", "url", F.coalesce("main", F.array_join("rest", "\n")).alias("text")
    )
    unmarked = read.where(paired).drop("main")
    out = alone if unmarked.isEmpty() else alone.unionByName(_differenced(unmarked))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
