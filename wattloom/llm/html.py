"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths. At each element the tree
counts its presentations (the rows of child elements) and, at leaves, its contents. An
element that always looks or reads the same carries little information: its importance is
the normalised entropy of those counts, an inner element's also that of its children.
Branches that are of low importance throughout, on hosts with pages enough to tell, are cut
out of each page.
Pages that share their longest block of text are copies and have one vote together.

Two kinds of knowledge come before the tree. Elements that are menus, forms, scripts and
the like by their tag, class or role are cut everywhere: on small hosts they vary as much as
texts do, so that entropy alone would keep them. Headings and paragraphs inside an article have an
importance of one, and what holds an article is never cut as a whole. Of what is left after the cuts, articles alone are taken if they
hold half of the text or more.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import materialize

#: An element must occur on so many different pages of a host before it is judged, and is cut below this importance.
MIN_PAGES, LOW = 8, 0.6
#: How fast the weight of an element's own presentation falls with the number of its children.
GAMMA = 0.9
#: Articles holding such a share of a page's text are taken alone.
ARTICLE_SHARE = 0.5
#: Low branches that may be sent to every task (8 bytes each).
SMALL_LOW = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav aside form button input select textarea iframe object embed svg canvas dialog menu fieldset audio video map footer".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead comment comments commentlist disqus respond replies share sharing social related recommended widget toolbar pagination pager login signup footer skip".split())
#: What may stand beside a noise word in one class name; any other word makes it a name of its own, as in related-work.
LAYOUT = frozenset("area articles bar bg block body bottom bottombar box btn button buttons col column container content dialog fixed flex float footer frame global grid group header hidden holder inline inner item items js layout left link links list main menu message middle mobile module outer page pane panel posts primary right rail row secondary section site slot sticky stories tab tabs text title top topbar unit wrap wrapper zone".split())
_OUTSIDE_ONLY = frozenset(["header"])  # a page's header, not an article's
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}, "tfoot": {"tr", "tbody"}}
_SCOPE = frozenset("html body table td th ul ol dl select article section div main button object".split())
_KEPT_INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_MARKUP = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_STOP = re.compile(r"[<>\"']")
_LETTER = re.compile(r"/?[a-zA-Z]|!")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    """A node of a page: its tag, its marks (class names, id and role), and its children (elements and strings). `holds`: an article lies in it."""

    __slots__ = ("tag", "marks", "hidden", "children", "parent", "holds")

    def __init__(self, tag: str, parent: Element | None = None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.marks: tuple[str, ...] = ()
        self.hidden = self.holds = False
        if attributes and _TELLING.search(attributes):
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            self.marks = tuple(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split())
            style = found.get("style", "").replace(" ", "").lower()
            self.hidden = "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true"

    def label(self) -> str:
        return ".".join((self.tag, *(m for m in self.marks if not any(map(str.isdigit, m)))))


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """Where the attributes that start at `at` end, and where the page goes on.

    A quoted value may hold anything if its end is followed by what follows an attribute. A
    quote that opens no value or finds no end is a character like others, and a tag that is
    not closed ends before the next one: so broken markup costs no text, and each step is
    bounded by the distance to the next mark.
    """
    while found := _STOP.search(page, at):
        mark, at = found[0], found.end()
        if mark == ">":
            return found.start(), at
        if mark == "<":
            if _LETTER.match(page, at):
                return found.start(), found.start()
        elif page[max(0, at - 80) : at - 1].rstrip().endswith("="):
            close = page.find(mark, at)
            if close >= 0:
                value = page[at:close]
                if page[close + 1 : close + 2] in " \t\n\r\f/>" or not ("<" in value or ">" in value):
                    at = close + 1
    return len(page), len(page)


def parse(page: str) -> Element:
    """A tolerant tree: missing end tags are implied, stray ones ignored, broken pages end where they end. Linear in the page's length."""
    root = node = Element("#root")
    at, missing = 0, set()  # ends that occur no more on the page

    def end_of(mark: str, start: int) -> int:
        """Just past the next `mark`; -1 if there is none."""
        if mark in missing:
            return -1
        k = page.find(mark, start)
        if k < 0:
            missing.add(mark)
            return -1
        return k + len(mark)

    while True:
        found = _MARKUP.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            node.children.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        if page[at] in "!?":
            if page.startswith("![CDATA[", at) and (end := end_of("]]>", at)) >= 0:
                node.children.append(page[at + 8 : end - 3])
            elif not (page.startswith("!--", at) and (end := end_of("-->", at + 3)) >= 0):
                end = end_of(">", at)
            if end < 0:
                node.children.append("<")
            at = max(at, end)
            continue
        closing = page[at] == "/"
        name = _NAME.match(page, at + closing)
        tag = name[0].lower()
        stop, at = _tag_end(page, name.end())
        if closing:
            node = _close(node, tag)
            continue
        if tag not in INLINE:  # a block ends an open paragraph, whatever inline elements are still open in it
            node = _close(node, "p", _SCOPE)
        for other in _CLOSED_BY.get(tag, ()):
            node = _close(node, other, frozenset(("table", "ul", "ol", "dl", "select")))
        attributes = page[name.end() : stop]
        child = Element(tag, node, attributes)
        node.children.append(child)
        if _is_article(child):
            up: Element | None = child
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        if tag in RAW:
            end = None if tag in missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                raw, at = page[at : end.start()], end.end()
            else:  # nothing can tell code from text, but a title or frame that is never closed holds none
                missing.add(tag)
                raw, at = (page[at:], len(page)) if tag in ("script", "style") else ("", at)
            child.children.append(entities.unescape(raw) if tag in ("title", "textarea") else raw)
        elif tag not in VOID and not attributes.endswith("/"):
            node = child


def _close(node: Element, tag: str, stop: frozenset[str] = frozenset()) -> Element:
    """The element that is open once the nearest `tag` is closed; `node` itself if there is none in scope."""
    up = node
    while up is not None and up.tag != tag:
        if up.tag in stop:
            return node
        up = up.parent
    return up.parent if up is not None else node


def _noise_mark(mark: str, inside: bool) -> bool:
    """Whether a class name, id or role says noise: one of its words does, and the others tell only place or shape."""
    words = [w for w in _SPLIT.split(mark) if w and not w.isdigit()]
    noise = [w in NOISE or (w in _OUTSIDE_ONLY and not inside) for w in words]
    return any(noise) and all(n or w in LAYOUT for n, w in zip(noise, words, strict=True))


def is_noise(e: Element, inside: bool) -> bool:
    """By its tag or marks alone. `inside`: in an article."""
    if e.tag in DROPPED or e.hidden or (e.tag == "header" and not inside):
        return True
    return e.tag not in ("html", "body") and any(_noise_mark(m, inside) for m in e.marks)


def _is_article(e: Element) -> bool:
    return e.tag in ("article", "main") or "main" in e.marks and e.tag in ("div", "section")


class _Paths(dict):
    """(path, label) -> path of the child with that label, as 64 bits; emptied when large."""

    def __missing__(self, key: tuple[int, str]) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[key] = out = _hash(f"{key[0]}/{key[1]}")
        return out


_PATHS = _Paths()


def root_path(host: str) -> int:
    return _hash(f"host {host}")


def main_text(root: Element, path: int = 0, low=frozenset()) -> str:
    """Blocks of the page joined by line ends, without the branches in `low`. `path`: the root's own."""
    blocks: list[tuple[str, bool]] = []
    buffer: list[str] = []

    def flush(inside: bool) -> None:
        if text := " ".join("".join(buffer).split()):
            blocks.append((text, inside))
        buffer.clear()

    # An explicit stack: pages may nest deeper than Python does.
    stack: list = [(root, path, "", False)]
    while stack:
        e, path, above, inside = stack.pop()
        if e is None:
            flush(inside)
            continue
        if isinstance(e, str):
            buffer.append(e)
            continue
        if e.tag != "#root":
            block = e.tag not in INLINE
            if is_noise(e, inside):
                if block:
                    flush(inside)
                continue
            if block and (label := e.label()) != above:
                path, above = _PATHS[path, label], label
                if path in low and not e.holds and not (inside and e.tag in _KEPT_INSIDE):
                    flush(inside)
                    continue
            if e.tag == "br":
                buffer.append(" ")
                continue
        if e.tag not in INLINE:
            flush(inside)
            inside = inside or _is_article(e)
            stack.append((None, 0, "", inside))
        stack.extend((c, path, above, inside) for c in reversed(e.children))
    flush(False)
    own = [t for t, inside in blocks if inside]
    if sum(map(len, own)) < ARTICLE_SHARE * sum(len(t) for t, _ in blocks):
        own = [t for t, _ in blocks]
    return "\n".join(own)


def tree_marks(root: Element, path: int = 0) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The page's mark, and (path, parent path, level, presentation, content) of its elements.

    The mark is a hash of the longest text without inner blocks. Elements of one path are
    taken together; an element labelled as its parent is part of it. Content is hashed where
    children are inline only, else 0. An article's own paragraphs count as different on each
    page, so that their importance is one.
    """
    seen: dict[int, list] = {}
    kept: set[int] = set()
    longest = ""
    stack: list = [(root, path, "", 0, False)]
    while stack:
        e, path, above, level, inside = stack.pop()
        kids = [c for c in e.children if not isinstance(c, str) and c.tag not in INLINE]
        own, inner = path, inside
        if e.tag != "#root":
            if e.tag in RAW:
                continue
            text = "" if kids else _all_text(e)
            longest = max(longest, text, key=lambda t: (len(t), t))
            label = e.label()
            if label != above:
                own, level = _PATHS[path, label], level + 1
                entry = seen.setdefault(own, [path, level, [], []])
                entry[2].append(" ".join(c.label() for c in kids))
                if not kids:
                    entry[3].append(text)
                if inside and e.tag in _KEPT_INSIDE:
                    kept.add(own)
            above, inner = label, inside or _is_article(e)
        stack.extend((c, own, above, level, inner) for c in reversed(kids))
    mark, rows = _hash(longest), []
    for own, (parent, level, style, content) in seen.items():
        found = mark if own in kept else _hash("\n".join(content)) if len(content) == len(style) else 0
        rows.append((own, parent, level, mark if own in kept else _hash("|".join(style)), found))
    return mark, rows


def _all_text(e: Element) -> str:
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in RAW:
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_MARKS = "page long, path long, parent long, level int, style long, content long"


def _marks(pages: DataFrame) -> DataFrame:
    """(page, path, parent, level, style, content) of the elements of `pages` (host, html)."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark, rows = tree_marks(parse(page), root_path(host))
                for row in rows:
                    for column, value in zip(out, (mark, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.int64()) for k, c in enumerate(out)], ["page", "path", "parent", "level", "style", "content"])

    return pages.select("host", "html").mapInArrow(marks, _MARKS)


def importance(marks: DataFrame) -> DataFrame:
    """(path, pages, score, top): the importance of each path found on MIN_PAGES pages or more, and the largest in its branch.

    Every path has its host in it, so hosts need no column. Levels are worked off from the
    deepest to the first: a parent needs its children's sums only.
    """
    once = marks.groupBy("path", "parent", "level", "page").agg(F.min("style").alias("style"), F.min("content").alias("content"))
    once = materialize(once, "style-tree")

    def entropy(column: str) -> DataFrame:
        """Entropy of a column's values over the pages of each path, divided by its largest possible value."""
        by = once.groupBy("path", "parent", "level", column).agg(F.count("*").alias("n"))
        sums = by.groupBy("path", "parent", "level").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("w"), F.max(column).alias("most"), F.min(column).alias("least"))
        value = F.when(F.col("pages") == 1, 1.0).otherwise((F.log("pages") - F.col("w") / F.col("pages")) / F.log("pages"))
        return sums.select("path", "parent", "level", "pages", value.alias(f"{column}_entropy"), ((F.col("most") != 0) | (F.col("least") != 0)).alias(f"has_{column}"))

    nodes = entropy("style").drop("has_style").join(entropy("content").select("path", "content_entropy", "has_content"), "path").where(F.col("pages") >= MIN_PAGES)
    nodes = materialize(nodes, "style-nodes")
    own = F.when(F.col("has_content"), F.col("content_entropy")).otherwise(F.col("style_entropy"))
    done, below = None, None
    for level in range(nodes.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = nodes.where(F.col("level") == level)
        if below is None:
            scored = here.select("path", "parent", "pages", own.alias("score"), own.alias("top"))
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("kids"), F.sum("pages").alias("weight"), F.sum(F.col("pages") * F.col("score")).alias("sum"), F.max("top").alias("top")).withColumnRenamed("parent", "path")
            share = F.pow(F.lit(GAMMA), F.col("kids"))
            inner = (1 - share) * F.col("style_entropy") + share * F.col("sum") / F.col("weight")
            scored = here.join(sums, "path", "left").withColumn("score", F.when(F.col("kids").isNull(), own).otherwise(inner))
            scored = scored.select("path", "parent", "pages", "score", F.greatest("score", "top").alias("top"))
        below = materialize(scored, "style-level")
        done = below if done is None else done.unionByName(below)
    if done is None:
        done = nodes.select("path", "pages", own.alias("score"), own.alias("top"))
    return done.select("path", "pages", "score", "top")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    A null html counts as empty and gives an empty text. Pages without a host form one site of
    their own. Repeated rows are extracted each, but have one vote in the tree. Broken markup
    and very long pages take time in proportion to their length. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    low = materialize(importance(_marks(rows)).where(F.col("top") < LOW).select("path"), "low-branches")
    own_type = "array<bigint>"
    if low.count() <= SMALL_LOW:
        shared = pages.sparkSession.sparkContext.broadcast(np.array([r.path for r in low.collect()], np.int64))
        rows = rows.withColumn("low", F.array().cast(own_type))
    else:  # each page's own low branches, found by a join on the path
        shared = None
        page = F.xxhash64("host", "html")
        paths = _paths_of(rows.select(page.alias("page"), "host", "html")).join(low, "path")
        rows = rows.withColumn("page", page).join(paths.groupBy("page").agg(F.collect_set("path").alias("low")), "page", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frozenset(shared.value.tolist()) if shared else None
        for batch in batches:
            hosts, htmls, lows = (batch.column(k).to_pylist() for k in (2, 3, 4))
            texts = [main_text(parse(page), root_path(h), frozenset(own or ()) if common is None else common) for h, page, own in zip(hosts, htmls, lows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    page_id = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "host", "html", "low").mapInArrow(extract, f"page_id {page_id}, url string, text string, n_chars long")


def _paths_of(pages: DataFrame) -> DataFrame:
    """(page, path): every path on each of `pages` (page, host, html)."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for page, host, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = [r[0] for r in tree_marks(parse(text), root_path(host))[1]]
                out[0].extend([page] * len(found))
                out[1].extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["page", "path"])

    return pages.mapInArrow(paths, "page long, path long").distinct()
