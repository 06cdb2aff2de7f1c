"""Main-text extraction by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path. Each path has the length of its text, its
punctuation and its number of nodes; their ratio is large for running text and small for menus,
labels and links. The ratios judge what stands outside the page's content, and what inside it has a name that furniture and content
share (related, share, header, ..., any name of which only a part is furniture's, as in hidden-gems, and the tags of fallbacks): such an element stays if its own ratio, at half weight, comes up to a share of the mean of the
content, and most of its text is no link. All else inside is kept but what elements call page furniture (by a tag; or by whole
names that content does not bear, if they do not hold all but a few words of a page without article and main). Kept nodes stand in page order.

An element's sums and what it has from those around it are found in one pass up and one pass down the elements, so time grows with the page, however deep it is nested.

The content is what article and main hold. Other text of such a page must reach a share of the best ratio with a tenth of its own
(ratios are smoothed there with the mean of the container that holds most of the text). A page without them has as
its content the deepest container with most of the text. Beside it, and throughout a page that only body holds together, each
block below is judged whole: it stays if one of its paths reaches a share of the best ratio (here length
and punctuation of a node count up to those of a paragraph, so that one long block cannot outdo the others), and
running blocks (paragraphs, headings, quotes, bare text), and all blocks under body, also stay unless most of their text is links.

Every page is worked on alone where it is read, so nothing is shuffled. Defined results: null or empty
html, or html without text, gives an empty text; whole pages are read, however long; unclosed and
stray tags are closed as their surroundings demand; repeated rows give repeated results; null ids and
urls are carried through; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: A comment, a tag (quotes count after "=" alone), a declaration, or a tag that the end of the page cuts.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>=]|=)*+)>|<[!?/][^>]*>|<[a-zA-Z/!?](?:=\s*+(?:"[^"]*+|'[^']*+)\Z|[^<>=]|=)*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?]")

# HTML elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "template", "svg", "head", "audio", "video", "datalist"}
#: Elements that are furniture outside the content, and in it if their text is not running text.
FALLBACKS = {"canvas", "fieldset", "map", "menu", "noscript", "object"}
HOLDERS = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disqus", "disclaimer", "footer", "gdpr", "hidden", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "replies", "reply", "respond", "responses", "sidebar", "signup", "sponsor", "sponsored", "subscribe"}
#: Names that content bears as well; and words before a name that make it one of the layout around.
SHARED_NAMES = {"feedback", "header", "masthead", "overlay", "recommended", "related", "reviews", "share", "sharing", "skip", "social", "tags", "teaser", "toolbar", "widget"}
LAYOUT = {"has", "hide", "no", "non", "with", "without"}
#: Who writes what is no article; and words that say no more of a name than its place: with these alone beside it, a name is still all that an element is called.
READERS = {"customer", "reader", "readers", "user", "users", "visitor"}
PLACES = {"area", "bar", "block", "body", "bottom", "box", "col", "column", "container", "content", "desktop", "entry", "fixed", "form", "global", "group", "holder", "info", "inline", "inner", "item", "items", "left", "links", "list", "main", "message", "mobile", "outer", "page", "panel", "post", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "thread", "top", "unit", "wrap", "wrapper"}
#: An element of the key's kind ends an open one of these before it opens.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARS = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: Blocks of running text: no containers of a page's content.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address"}
NO_CONTAINERS = RUNNING | {"ul", "ol", "li", "dl", "dt", "dd", "tr", "th", "caption"}
PAGE = {"", "html", "body"}
#: Length and punctuation of a node beyond which it is no more of a paragraph.
LENGTH, MARKS = 200, 4

#: Share of the best fused ratio that a kept path outside the content reaches (of the content's mean, for elements of shared
#: names in it), and weights of what is outside and of shared names.
THRESHOLD, OUTSIDE, SHARED_WEIGHT = 0.2, 0.1, 0.5
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I | re.A) for tag in RAW}


def _named(attributes: str) -> int:
    """How class, id, role and hidden call the element: 2 page furniture by a whole name, 1 by part of one or by a shared name, else 0."""
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'").lower(), key.lower()
        if key == "hidden" or key == "role" and value in ROLES:
            return 2
        if key in ("class", "id"):
            for name in value.split():
                parts = [p for p in re.split(r"[^a-z]+", name) if p]
                own = {b for a, b in zip(["", *parts], parts, strict=False) if a not in LAYOUT}
                if own & NAMES or own & READERS and "reviews" in own:
                    if own <= NAMES | SHARED_NAMES | PLACES | READERS and len(own) == len(set(parts)):
                        return 2
                    found = 1
                found |= bool(own & SHARED_NAMES)
    return found


class Page:
    """The elements of a page in the order in which they open, so that a parent stands before its children (0: the page itself), and its text nodes.

    nodes: (text, element, whether a block or line begins before it) of every text node outside raw elements.
    """

    def __init__(self, page: str):
        self.tags, self.parents, self.paths, self.names = [""], [0], [0], [0]
        self.nodes: list[tuple[str, int, bool]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [0]  # the open elements
        open_at: dict[str, list[int]] = {}  # their places in the stack, by tag
        blocks, bars, p_bars = [0], [0], [0]  # the places of blocks, and of what a start tag closes nothing beyond
        p_limits = BARS | {"td", "th", "li"}
        paths: dict[tuple[int, str], int] = {}
        at, broken = 0, True

        def text(part: str) -> None:
            nonlocal broken
            if part:
                self.nodes.append((part, stack[-1], broken))
                broken = False

        def close(place: int) -> None:
            for k in stack[place:]:
                open_at[self.tags[k]].pop()
            del stack[place:]
            for places in (blocks, bars, p_bars):
                while places[-1] >= place:
                    places.pop()

        while at < len(page):
            m = TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                broken = True
            if m[1]:
                own = open_at.get(tag)
                if own and not (tag in INLINE and blocks[-1] > own[-1]):
                    close(own[-1])
                continue
            for ends, limits in ((CLOSES.get(tag), bars), (P if tag in ENDS_P else None, p_bars)):
                if ends:
                    last = max((open_at[e][-1] for e in ends if open_at.get(e)), default=0)
                    if last and last >= limits[-1]:
                        close(last)
            if tag in VOID:
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = len(page) if end is None else end.start()
                continue
            place = len(stack)
            open_at.setdefault(tag, []).append(place)
            if tag not in INLINE:
                blocks.append(place)
            if tag in BARS:
                bars.append(place)
            if tag in p_limits:
                p_bars.append(place)
            self.parents.append(stack[-1])
            stack.append(len(self.tags))
            self.paths.append(paths.setdefault((self.paths[self.parents[-1]], tag), len(paths) + 1))
            self.tags.append(tag)
            self.names.append(_named(m[3]) if m[3] else 0)

    def summed(self, own: list[float]) -> list[float]:
        """Of each element the sum over it and all below it."""
        total = list(own)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total


P = {"p"}


def extract(page: str | None) -> str:
    held = Page(page or "")
    tags, parents, names, paths = held.tags, held.parents, held.names, held.paths
    n = len(tags)
    nodes = [(t := entities.unescape(raw), e, b, len(t.strip())) for raw, e, b in held.nodes]
    # Text that no tag calls furniture; what holds an article or a heading is a frame around it. On a page without text in article or main, what holds most of the text
    # is no furniture by its names, nor as a form; if its whole name calls it furniture, that is so only where next to nothing stands beside it.
    by_tag, in_holder = [False] * n, [False] * n
    for k in range(1, n):
        by_tag[k] = by_tag[parents[k]] or tags[k] in FURNITURE and tags[k] != "form"
        in_holder[k] = in_holder[parents[k]] or tags[k] in HOLDERS
    own, articled = [0] * n, False
    for _, e, _, size in nodes:
        if not by_tag[e]:
            own[e] += size
            articled |= size > 0 and in_holder[e]
    raw = held.summed(own)
    total = raw[0]
    around, frames = [False] * n, [False] * n
    for k in range(n - 1, -1, -1):
        if k and (around[k] or tags[k] in HOLDERS or tags[k] == "h1"):
            around[parents[k]] = True
        most = not articled and 2 * raw[k] > total
        frames[k] = around[k] or tags[k] in PAGE or most and (names[k] < 2 or total - raw[k] < LENGTH)

    # Of each element: whether it is kept so far, and the outermost element of a shared name that it is in.
    stays, shared, linked = [True] * n, [0] * n, [False] * n
    for k in range(1, n):
        tag, up = tags[k], parents[k]
        stays[k], shared[k] = stays[up], shared[up]
        named = names[k] if not frames[k] and tag not in HOLDERS else 0
        fallback = tag in FALLBACKS and not frames[k]
        inside = in_holder[k]
        if tag in FURNITURE and not (tag == "form" and frames[k]) or named == 2 or tag == "header" and not around[k] and not inside or (named or fallback) and articled and not inside:
            stays[k] = False
        elif (named or fallback) and not shared[k]:
            shared[k] = k
        linked[k] = tag == "a" or k != shared[k] and linked[up]

    stats: dict[int, list[float]] = {}
    units: dict[int, list[float]] = {}  # of an element of a shared name: length, punctuation and number of its nodes, length of links
    own, holders = [0] * n, False
    for t, e, _, size in nodes:
        if not size or not stays[e]:
            continue
        marks = len(PUNCTUATION.findall(t))
        if shared[e]:
            u = units.setdefault(shared[e], [0, 0, 0, 0])
            u[3] += size * linked[e]
        else:
            holders |= in_holder[e]
            u = stats.setdefault(paths[e], [0, 0, 0])
            own[e] += size
        u[0] += size
        u[1] += marks
        u[2] += 1
    if not stats and not units:
        return ""
    kept_names = _of_content(units, stats)
    stays = [s and (not top or top in kept_names) for s, top in zip(stays, shared, strict=True)]
    if not stats:
        stats = {0: [sum(u[0] for u in units.values()), 0, 1]}
    judged = _beside_holders if holders else _beside_container
    kept = judged(held, [(e, size) for _, e, _, size in nodes], stats, stays, shared, in_holder, held.summed(own))
    text = [(" " if b else "") + t if k else " " * b for (t, _, b, _), k in zip(nodes, kept, strict=True)]
    return " ".join("".join(text).split())


def _ratio(size: float, marks: float, nodes: float) -> float:
    """Length and punctuation of a node count up to those of a paragraph."""
    return min(size / nodes, LENGTH) * (1 + min(marks / nodes, MARKS))


def _of_content(units: dict[int, list[float]], stats: dict) -> set[int]:
    """The elements of shared names whose ratio is that of content."""
    total = sum(s[0] for s in stats.values())
    mean = sum(s[0] * _ratio(*s) for s in stats.values()) / total if total else 0.0
    return {k for k, (size, marks, nodes, links) in units.items() if SHARED_WEIGHT * _ratio(size, marks, nodes) >= THRESHOLD * mean and 2 * links <= size}


def _beside_holders(page: Page, nodes: list[tuple[int, int]], stats: dict, stays: list[bool], shared: list[int], in_holder: list[bool], sizes: list[float]) -> list[bool]:
    """Which nodes are kept on a page with text in article or main: all there, and what is far more text outside."""
    ratio = {p: _ratio(*s) for p, s in stats.items()}
    containers = [0] * len(page.tags)  # the nearest container with most of the page's text, below body
    for k in range(1, len(page.tags)):
        tag = page.tags[k]
        if tag not in PAGE:
            containers[k] = k if tag not in INLINE and tag != "p" and 2 * sizes[k] >= sizes[0] else containers[page.parents[k]]
    means: dict[int, list[float]] = {}
    for e, size in nodes:
        if containers[e] and size and page.paths[e] in ratio:
            m = means.setdefault(containers[e], [0.0, 0.0])
            m[0] += size * ratio[page.paths[e]]
            m[1] += size
    fused = []
    for e, _ in nodes:
        r, c = ratio.get(page.paths[e], 0.0), containers[e]
        if c in means:
            r = max(r, (r + means[c][0] / means[c][1]) / 2)
        fused.append(stays[e] * r * (1 if in_holder[e] else OUTSIDE))
    best = max(fused)
    return [stays[e] and (in_holder[e] or shared[e] > 0) or f >= THRESHOLD * best and f > 0 for f, (e, _) in zip(fused, nodes, strict=True)]


def _beside_container(page: Page, nodes: list[tuple[int, int]], stats: dict, stays: list[bool], shared: list[int], in_holder: list[bool], sizes: list[float]) -> list[bool]:
    """Which nodes are kept on a page without: all in the deepest container with most text, and what is text beside it."""
    n = len(page.tags)
    ratio = {p: _ratio(*s) for p, s in stats.items()}
    asked = THRESHOLD * max(ratio.values())
    chain, content = {0}, 0  # the content and what it stands in
    for k in range(1, n):
        if page.parents[k] == content and 2 * sizes[k] > sizes[0] and page.tags[k] not in INLINE and page.tags[k] not in NO_CONTAINERS:
            chain.add(k)
            content = k
    # Of each element the one of the chain that it stands in, the block below that (or the chain's element, for its bare text), and whether a link leads up there.
    within, top, link = [0] * n, [0] * n, [False] * n
    for k in range(n):
        up = page.parents[k]
        if k in chain:
            within[k], top[k] = k, -1
        else:
            within[k], top[k], link[k] = within[up], k if up in chain else top[up], link[up] or page.tags[k] == "a"
    # Of each block beside the content: length of its text and of links in it, and whether a path of it is running text.
    units: dict[int, list] = {}
    unit_of = [x if t < 0 or page.tags[t] in INLINE else t for x, t in zip(within, top, strict=True)]
    for e, size in nodes:
        if stays[e] and size and not shared[e]:
            u = units.setdefault(unit_of[e], [0, 0, False])
            u[0] += size
            u[1] += size * link[e]
            u[2] |= ratio.get(page.paths[e], 0.0) >= asked
    bare = page.tags[content] in PAGE

    def keep(e: int) -> bool:
        x, unit = within[e], unit_of[e]
        if not stays[e] or unit not in units and x != content:
            return False
        if x == content and not bare:
            return True
        size, links, running = units.get(unit, (0, 0, False))
        return running or (unit == x or page.tags[unit] in RUNNING or bare) and 2 * links <= size

    return [keep(e) for e, _ in nodes]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.selectExpr(f"`{page_id}` AS page_id", f"`{url}` AS url", f"`{html}` AS html")
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


#: For pages with one article element, and the character references of the given tables.
SQL = r"""SELECT page_id, url, text, length(text)::bigint AS n_chars FROM (
SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's'), '</?(?:b|i|em|a|span|strong)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages)"""
