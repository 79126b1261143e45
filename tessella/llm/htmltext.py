"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its path of tags (and classes) from the root. Per path
are summed the characters, the punctuation marks, the nodes and the characters inside links.
Characters per node and marks per node are smoothed over neighbouring paths of one parent, in page
order, then fused: (characters per node) x (marks per node, plus one) x (share outside links) x
(what the path's names leave of it). Names only lower a ratio: to LOWERED of it under elements that
a tag, role, class or id calls boilerplate (menus, footers, sidebars, page headers, forms, notices,
adverts, reader comments), to OUTSIDE of it outside the article or main elements of a page that has text in them.

Paths at or above ``threshold`` of the greatest ratio, and at least FLOOR, are content paths. The
main element is the lowest one that holds all text of the content paths, but none below an article or
main element. The paths inside it that no name lowers count as content too (so headings, captions and
short paragraphs stay), as does a first heading before it. Where the main element is the body itself, that goes for
headings, and for what lies between the first heading or content and the last content and is not mostly links.

A class or id names boilerplate if all parts of one of its words are boilerplate names or usual
companions of them (``ad-box``, ``site-footer``), never with a word such as ``no`` or ``has``; it says nothing of
an element around the first heading or the main element, and the weaker names and forms say nothing of
one that holds nearly all text of the page (``cover``). Scripts, styles and what is hidden is no text.

Defined cases: null or empty html gives an empty text; an unfinished tag at the end of a page is
dropped, unclosed elements end with the page; a page without main text gives ""; repeated rows
are extracted each; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore

MARKUP = re.compile(r"""<(?:!--|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([a-zA-Z][^\s/>]*+)([^>]*+)>|/([a-zA-Z][^\s/>]*+)[^>]*+>|[!?/][^>]*+>)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
MARKS = re.compile(r"[.,;:!?…、。，！？]")

# Names of HTML elements, roles, and usual class names of boilerplate.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template title textarea svg math iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside button select option dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies respond "
    "cookie cookies consent gdpr footer newsletter pagination pager share sharing social".split()
)
WEAK = frozenset("promo promotion notice notification banner popup modal overlay related recommended subscribe subscription signup login header masthead logo widget toolbar copyright disclaimer skip paywall regwall".split())
#: Names of reader comments that may as well be a part of an article, where they say nothing.
THREADS = frozenset("discussion discussions reactions responses talkback".split())
COMPANIONS = frozenset(
    "site page global main top bottom left right upper lower primary secondary sub user reader blog post posts story stories entry article articles box bar list lists item items container wrapper wrap inner outer "
    "area section block panel group content body text title row column col link links button buttons icon icons form thread tree count meta media unit slot zone rail fixed sticky floating large small mini mobile desktop to "
    "more you may like also news tags inline module part holder frame responsive default new".split()
)
DENIALS = frozenset("no not non without has have with hide hidden is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body main".split())
#: What is left of the ratio of a path that a name calls boilerplate, and of one outside the article.
LOWERED, OUTSIDE = 1e-9, 0.04
#: The least ratio of a content path: one character a node.
FLOOR = 1.0


class Limits:
    """Share of the greatest ratio for a content path, and share of the text that no form or weakly named element holds.

    ``ratios`` and ``names`` switch off either part, to see what it does.
    """

    def __init__(self, threshold: float = 0.05, cover: float = 0.9, ratios: bool = True, names: bool = True):
        self.threshold, self.cover, self.ratios, self.names = threshold, cover, ratios, names


def named(value: str, in_article: bool) -> int:
    """What a class or id says: 2 that the element is boilerplate, 1 that it may be, else 0."""
    most = 0
    for word in value.split():
        parts = {x.lower() for x in NAME_PART.findall(word)}
        if in_article:
            parts -= {"header"} if len(parts) > 1 else set()
        names = parts & (STRONG | WEAK | (frozenset() if in_article else THREADS))
        if names and not parts & DENIALS and all(x in COMPANIONS or x in names or x.isdigit() for x in parts) and not (in_article and names == {"header"}):
            most = max(most, 2 if names & STRONG else 1)
    return most


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """Whether an element is unseen, whether its tag or role calls it boilerplate, and what its class or id says of that."""
    if tag in UNSEEN:
        return True, False, 0
    boilerplate, said = tag in BOILERPLATE or (tag == "header" and not in_article), int(tag == "form")
    if attributes and tag not in KEPT_WHOLE:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name in ("class", "id"):
                said = max(said, named(value, in_article))
            elif name == "role":
                boilerplate = boilerplate or value.strip().lower() in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return True, False, 0
    return False, boilerplate, said


class Page:
    """Elements, and text nodes as (element, block, characters), of one page in one sweep."""

    def __init__(self, source: str):
        self.parent, self.tag, self.classes, self.unseen, self.boilerplate, self.said = [-1], ["#"], [""], [False], [False], [0]
        self.article, self.linked = [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self._block = 0
        stack, opened = [0], {}

        def close(to: int) -> None:
            while len(stack) > to:
                tag = self.tag[stack.pop()]
                opened[tag] -= 1
                if tag not in INLINE:
                    self._block += 1

        at, n = 0, len(source)
        ends = source.rfind(">") + 1  # past it no markup can end, so none is looked for
        while at < n:
            m = MARKUP.search(source, at, ends) if at < ends else None
            self._text(source[at : m.start()] if m else self._tail(source, at), stack[-1])
            if not m:
                break
            at = m.end()
            name = m[1] or m[3]
            if name:
                tag, attributes = name.lower(), m[2] if m[1] else m[4]
                if tag not in INLINE and opened.get("p"):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != "p":
                        k -= 1
                    close(k)
                elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.tag[stack[-1]] == tag:
                    close(len(stack) - 1)
                if tag == "br":
                    self._text(" ", stack[-1])
                if tag not in INLINE:
                    self._block += 1
                if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
                    continue
                self._open(tag, attributes, stack[-1])
                stack.append(len(self.tag) - 1)
                opened[tag] = opened.get(tag, 0) + 1
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                    at = end.start() if end else n
            elif m[5]:
                tag = m[5].lower()
                if opened.get(tag):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    close(k)
            elif m[0] == "<!--":
                end = source.find("-->", at)
                at = n if end < 0 else end + 3

    @staticmethod
    def _tail(source: str, at: int) -> str:
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        return rest[: cut.start()] if cut else rest

    def _open(self, tag: str, attributes: str, parent: int) -> None:
        unseen, boilerplate, said = _kind(tag, attributes, self.article[parent])
        self.parent.append(parent)
        self.tag.append(tag)
        self.classes.append(attributes if "class" in attributes else "")
        self.article.append(self.article[parent] or tag in ("article", "main"))
        self.linked.append(self.linked[parent] or tag == "a")
        self.unseen.append(self.unseen[parent] or unseen)
        self.boilerplate.append(boilerplate)
        self.said.append(said)

    def _text(self, raw: str, element: int) -> None:
        if raw and not self.unseen[element]:
            self.texts.append((element, self._block, entities.unescape(raw) if "&" in raw else raw))

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked; parents come before their children."""
        out = own[:1]
        for e in range(1, len(own)):
            out.append(own[e] or out[self.parent[e]])
        return out

    def held(self, own: list[int]) -> list[int]:
        """Sums over all that an element holds."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def lowered(page: Page, cover: float) -> list[bool]:
    """Which elements are boilerplate by name, or inside one that is."""
    size = [0] * len(page.tag)
    for element, _, text in page.texts:
        size[element] += len(text) - sum(map(str.isspace, text))
    size = page.held(size)
    around = page.held([int(t in ("h1", "main")) for t in page.tag])
    own = [page.boilerplate[e] or (said > 0 and not around[e] and (said > 1 or size[e] < cover * size[0])) for e, said in enumerate(page.said)]
    return page.inherited(own)


def _smooth(values: list[float], parents: list[int]) -> list[float]:
    """Half of each value and a quarter of its neighbours' under the same parent, or its own where there is none."""
    out = []
    for k, x in enumerate(values):
        near = [values[j] if 0 <= j < len(values) and parents[j] == parents[k] else x for j in (k - 1, k + 1)]
        out.append(0.5 * x + 0.25 * sum(near))
    return out


class Paths:
    """Paths of a page's elements and their fused ratios."""

    def __init__(self, page: Page, low: list[bool], limits: Limits):
        ids: dict[tuple, int] = {}
        self.of, self.parent = [0], [-1]
        for e in range(1, len(page.tag)):
            up = self.of[page.parent[e]]
            k = ids.setdefault((up, page.tag[e], page.classes[e], low[e]), len(ids) + 1)
            if k == len(self.parent):
                self.parent.append(up)
            self.of.append(k)
        sums: dict[int, list] = {}
        for element, _, text in page.texts:
            n = len(text) - text.count(" ")
            if n and not text.isspace():
                s = sums.setdefault(self.of[element], [0, 0, 0, 0, element])
                s[0] += n
                s[1] += len(MARKS.findall(text))
                s[2] += 1
                s[3] += n * page.linked[element]
        inside = any(page.article[s[4]] and not low[s[4]] for s in sums.values())
        parents = [self.parent[p] for p in sums]
        chars = _smooth([s[0] / s[2] for s in sums.values()], parents)
        marks = _smooth([s[1] / s[2] for s in sums.values()], parents)
        self.links = {p: s[3] / s[0] for p, s in sums.items()}
        self.left = {p: (LOWERED if low[s[4]] else 1.0) * (OUTSIDE if inside and not page.article[s[4]] else 1.0) if limits.names else 1.0 for p, s in sums.items()}
        self.ratio = {p: c * (1 + m) * (1 - self.links[p]) * self.left[p] for p, c, m in zip(sums, chars, marks, strict=True)}
        least = max(limits.threshold * max(self.ratio.values(), default=0.0), FLOOR)
        self.content = {p for p, x in self.ratio.items() if x >= least or not limits.ratios}


def main_element(page: Page, paths: Paths) -> int:
    """The lowest element that holds all text of the content paths, none below an article or main element."""
    weight = [0] * len(page.tag)
    for element, _, text in page.texts:
        if paths.of[element] in paths.content:
            weight[element] += len(text)
    weight = page.held(weight)
    main = 0
    for e in range(1, len(weight)):  # parents come before their children
        if page.parent[e] == main and not page.article[main] and weight[e] > 0 and weight[e] == weight[0] and page.tag[e] not in INLINE and page.tag[e] not in HEADINGS and page.tag[e] != "p":
            main = e
    return main


def main_text(source: str, limits: Limits | None = None) -> str:
    """Blocks of the main text in page order, joined by blank lines."""
    limits = limits or Limits()
    page = Page(source)
    low = lowered(page, limits.cover) if limits.names else [False] * len(page.tag)
    paths = Paths(page, low, limits)
    if not paths.content:
        return ""
    main = main_element(page, paths)
    inside = page.inherited([e == main for e in range(len(page.tag))])
    heading = page.inherited([t in HEADINGS for t in page.tag])
    first = page.inherited([t == "h1" for t in page.tag])
    whole = page.article[main] or page.tag[main] not in ("#", "html", "body")
    content = [k for k, (e, _, _) in enumerate(page.texts) if paths.of[e] in paths.content]
    titles = [k for k, (e, _, t) in enumerate(page.texts) if first[e] and inside[e] and not low[e] and not t.isspace()]
    begin = min(content[0], titles[0]) if titles else content[0]

    def counts(k: int, e: int) -> bool:
        """Whether a text node that no name lowers belongs to the main text though its path's own ratio is small."""
        if first[e] and not titles and k < content[0]:
            return True
        if not inside[e]:
            return False
        return whole or heading[e] or (begin < k < content[-1] and paths.links.get(paths.of[e], 0.0) < 0.5)

    blocks: dict[int, list[str]] = {}
    for k, (element, block, text) in enumerate(page.texts):
        if paths.of[element] in paths.content or (not low[element] and counts(k, element)):
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks.values())))


def extract(pages: DataFrame, column: str = "html", limits: Limits | None = None) -> DataFrame:
    """The columns of ``pages`` but the html, with text and n_chars (replacing columns of these names)."""
    rest = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textcore.slices(whole, column):
                table = pa.Table.from_batches([batch])
                texts = [main_text(x.as_py() or "", limits) for x in batch.column(batch.schema.get_field_index(column))]
                table = table.select(rest).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))
                yield from table.to_batches()

    return pages.select(*rest, F.col(column)).mapInArrow(run, schema)
