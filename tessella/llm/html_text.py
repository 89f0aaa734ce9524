"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of block elements with their classes and, for
containers, their place among siblings of that kind. The features of a node are the blocks of text in it and
below it. A feature of ``n`` of the node's ``m`` pages has an entropy of ``log n / log m``: 0 if one page alone
has it, 1 if all have. The composite importance of a node is 1 less the mean entropy of its features' occurrences,
with a small weight for the entropy of its sequences of children (its presentation): near 1 where pages differ,
near 0 where they repeat, be it in parts, as menus drawn from a stock of entries. A branch is cut from each page
if all its nodes are of low importance. Before that, elements that never hold an article are cut by what they are
(scripts, forms, navigation, ...) or say they are (role; class or id made of nothing but such words and neutral ones),
as their contents may vary from page to page. What is left is read by where most of the text is: all of ``main`` with
what is nested in it, else all ``article`` elements if they hold half of the text or more, else the body without them.

Elements that are open are found by name, so a page costs time in proportion to its length, however it is nested.

Nodes are rated only where a host has ``LEAST_PAGES`` different pages with that node; others are kept. Features are
counted over different pages, so copies of a page do not make its article a template.

Defined results: null or empty html has an empty text; a null url is a host of its own; repeated rows each
get their text; an empty table gives no rows; other columns are ignored. An unclosed comment or tag hides what
follows it, as in browsers.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

LEAST_PAGES, LEAST_IMPORTANCE, CONTENT_WEIGHT = 5, 0.25, 0.9
#: Elements told apart by their place among siblings of the same kind, up to this place.
PLACED, LAST_PLACE = frozenset("div section table td ul ol dl".split()), 9
#: Elements nested deeper than this belong to the node above them, so that a page's tree stays in proportion to the page.
DEEPEST = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements without article text.
DROPPED = frozenset("head script style noscript template iframe nav footer aside form button select textarea object canvas svg math dialog menu audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Start tags that close an open element of these names first, up to a container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Roles of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark what is not the article, if all its other words are neutral.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted banner banners cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup popup modal overlay sidebar sidenav widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer "
    "masthead topbar toolbar comment comments disqus respond login pagination pager copyright".split()
)
NEUTRAL = frozenset(
    "main site page global local primary secondary top bottom left right upper lower inner outer header box bar bars list lists area section wrapper wrap container holder link links button buttons block blocks item items "
    "form group panel pane slot unit row rows col column columns grid post posts article articles story stories content text title head heading body icon icons media tools tool fixed sticky float mobile desktop small large "
    "new latest more also read like us policy privacy message messages bg dark light js is".split()
)
NEGATED = frozenset("has with no without not".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<(?=[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")


def _marked(tag: str, names: str) -> bool:
    """Whether a class or id says that an element is not the article."""
    if tag in ("html", "body", "article", "main"):
        names = " ".join(n for n in names.split() if n.lower() in ("comment", "ad", "sponsored", "promoted", "related"))
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in NEGATED and not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words):
            return True
    return False


class Page:
    """One pass over a page: its blocks of text with the tree node and the landmarks they are in."""

    def __init__(self, source: str, low: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, bool, bool, str, bool]] = []  # node, in main, in an article, text, mostly a link and no paragraph
        self.shape: dict[int, list[str]] = {}  # the children of each node, in order
        self.parents: dict[int, int] = {}
        self.low = low
        self._stack: list[tuple[str, int, bool, bool, bool, dict[str, int]]] = [("", 0, False, False, False, {})]  # tag, node, hidden, in main, in an article, children by label
        self._open_at: dict[str, list[int]] = {}  # the places in the stack of the open elements of each name
        self._text: list[str] = []
        self._linked = self._all = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((*self._where, text, self._linked * 2 > self._all and not self._paragraph))
        self._text, self._linked, self._all = [], 0, 0

    def _say(self, raw: str) -> None:
        _, node, hidden, main, article, _ = self._stack[-1]
        if hidden:
            return
        if not self._text:
            self._where, self._paragraph = (node, main, article), bool(self._open_at.get("p"))
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        n = len(text.strip())
        self._all += n
        if any(s[0] == "a" for s in self._stack[-4:]):
            self._linked += n

    def _last(self, names: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of these names, or 0."""
        return max((self._open_at[n][-1] for n in names if self._open_at.get(n)), default=0)

    def _pop(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of these names and all inside it, if none of ``stop`` is nearer."""
        at = self._last(names)
        if not at or self._last(stop) > at:
            return
        if any(s[0] not in INLINE for s in self._stack[at:]):
            self._flush()
        for s in self._stack[at:]:
            self._open_at[s[0]].pop()
        del self._stack[at:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._flush()
            return
        if tag in CLOSES_P:
            self._pop({"p"}, {"td", "th", "button", "object", "caption"})
        if tag in SIBLINGS:
            self._pop(*SIBLINGS[tag])
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        _, node, hidden, main, article, children = self._stack[-1]
        names = ""
        if attributes and not hidden:
            for name, value in _ATTRIBUTE.findall(attributes):
                value, name = value.strip("\"'"), name.lower()
                if name == "role":
                    main = main or value.lower() == "main"
                    hidden = hidden or value.lower() in ROLES
                elif name in ("class", "id"):
                    names += " " + value
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
            hidden = hidden or bool(names) and _marked(tag, names)
        main, article = main or tag == "main", article or tag == "article"
        hidden = hidden or tag in DROPPED or (tag == "header" and not main and not article)
        if tag not in INLINE and not hidden and len(self._stack) <= DEEPEST:
            label = tag + "." + ".".join(sorted(_DIGITS.sub("0", names).split()))
            if tag in PLACED:
                place = children[label] = children.get(label, -1) + 1
                child = xxhash.xxh64_intdigest(f"{node}/{label}/{min(place, LAST_PLACE)}") - (1 << 63)
            else:
                child = xxhash.xxh64_intdigest(f"{node}/{label}") - (1 << 63)
            self.shape.setdefault(node, []).append(label)
            self.parents[child] = node
            node = child
            hidden = node in self.low
        self._open_at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, node, hidden, main, article, {}))

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if not m:
                self._say(source[at:])
                return
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in INLINE:
                    self._pop({tag}, CLOSES_P | {"td", "th", "li"})
                elif tag == "br":
                    self._flush()
                else:
                    self._pop({tag})
            elif tag in RAW:
                self._flush_raw(tag)
                end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(tag, m[3])

    def _flush_raw(self, tag: str) -> None:
        if tag not in INLINE and tag not in ("script", "style", "noscript", "template"):
            self._flush()

    def text(self) -> str:
        """The blocks of the part of the page that holds the article, one a line."""
        if any(main for _, main, *_ in self.blocks):
            part = [text for _, main, _, text, _ in self.blocks if main]
        else:
            size = [0, 0]
            for _, _, article, text, linked in self.blocks:
                size[article] += 0 if linked else len(text)
            inside = size[1] >= size[0] and any(article for _, _, article, *_ in self.blocks)
            part = [text for _, _, article, text, linked in self.blocks if article == inside and (inside or not linked)]
        return "\n".join(part)


def page_nodes(source: str) -> set[tuple[int, int, bool, tuple[int, ...] | None]]:
    """(node, value, is_text, up) of a page's tree: a hash of each block of text, and one of each node's children.

    ``up`` names the node and those above it, for children; for texts it is null.
    """
    page, out, above = Page(source), set(), {}
    for node, _, _, text, _ in page.blocks:
        out.add((node, xxhash.xxh64_intdigest(text) - (1 << 63), True, None))
        if node not in above:
            way, at = [], node
            while at:
                way.append(at)
                at = page.parents.get(at, 0)
            for i, at in enumerate(way or [0]):
                above[at] = tuple(way[i:])
    for node, way in above.items():
        out.add((node, xxhash.xxh64_intdigest(" ".join(page.shape.get(node, []))) - (1 << 63), False, way))
    return out


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance, up) over all pages of each host; ``up`` names the node and those above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = xxhash.xxh64_intdigest(source) - (1 << 63)
                    rows += [(host, page, *n) for n in page_nodes(source)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["host", "page", "node", "value", "is_text", "up"])

    found = pages.where("html is not null").select("host", "html").mapInArrow(run, "host string, page long, node long, value long, is_text boolean, up array<long>")
    each = found.distinct().groupBy("host", "node", "is_text", "value").agg(F.count(F.lit(1)).alias("n"), F.any_value("up").alias("up"))  # copies of a page count once
    n, text = F.col("n"), F.col("is_text")
    weighed = n * F.log(n)
    nodes = each.groupBy("host", "node").agg(
        F.sum(F.when(~text, n)).alias("pages"), F.sum(F.when(~text, weighed)).alias("of_shape"), F.sum(F.when(text, n)).alias("texts"), F.sum(F.when(text, weighed)).alias("of_texts"), F.any_value("up", ignoreNulls=True).alias("up")
    )
    log = F.log("pages")
    rated = nodes.select(
        "host", "node", "pages", "up", F.coalesce("texts", F.lit(0)).alias("texts"), F.when(F.col("pages") > 1, F.col("of_texts") / log).alias("common"),
        F.when(F.col("pages") > 1, 1 - F.col("of_shape") / F.col("pages") / log).otherwise(1.0).alias("shape"),
    )
    rated = materialise(rated, "tree")  # of the size of the templates; both sides of the join below read it
    below = rated.select("host", F.explode("up").alias("node"), "texts", "common").groupBy("host", "node").agg(F.sum("texts").alias("all_texts"), F.coalesce(F.sum("common"), F.lit(0.0)).alias("all_common"))
    both = rated.select("host", "node", "pages", "up", "shape").join(below, ["host", "node"])
    content = 1 - F.col("all_common") / F.col("all_texts")
    return both.select("host", "node", "pages", (content * CONTENT_WEIGHT + F.col("shape") * (1 - CONTENT_WEIGHT)).alias("importance"), "up")


def low_nodes(tree: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, node) of the branches to cut: nodes of low importance with none below that is not."""
    kept = (F.col("pages") < least_pages) | (F.col("importance") >= least_importance)
    branches = tree.select("host", F.explode("up").alias("node"), kept.alias("kept"))
    return branches.groupBy("host", "node").agg(F.bool_or("kept").alias("kept")).where("not kept").select("host", "node")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    The nodes to cut are a table of one row a host; Spark broadcasts it if it is below its own threshold, and joins
    by shuffle otherwise.
    """
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = low_nodes(style_tree(hosted), least_pages, least_importance)
    cut = materialise(low.groupBy("host").agg(F.collect_set("node").alias("cut")), "nodes")  # as many as a host's template has nodes
    joined = hosted.join(cut, "host", "left").select("page_id", "url", "html", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [Page(h or "", frozenset(c or ())).text() for h, c in zip(part.column("html").to_pylist(), part.column("cut").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
