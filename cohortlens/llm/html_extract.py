"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the element tree (implied ends of paragraphs, items and cells;
stray end tags are ignored).  Every run of text between block boundaries is a block.  A
block gives its container ``1 + commas + min(length / 100, 3)`` points, the next ancestor
half of them, further ones a share that falls with the distance; the ``article`` (or a
``main`` without one) around it has all of its blocks' points.  Points are discounted by
link density, and the container with most is kept, with those siblings that score at least
a fifth of it, plain paragraphs beside it, and headings before it if it has none itself.
Lists and boxes within that are nearly all links are menus and go.

Boilerplate neither scores nor is kept: menus, headers, footers, sidebars, forms and dialogs
by element or role, hidden elements, and elements (articles too) whose class or id has a word
for notices, adverts, comments and the like, alone or in a compound, or that begin with a
heading for comments.  Some words tell less: with them a paragraph or section goes only if it
has few words, many links or fewer points a block than half of what is around it.  A word after
``has``, ``with`` or ``no`` says nothing, nor does one on a wrapper that holds most of the page,
and the head of an article is part of it.  The ancestors of the largest article are never
boilerplate, nor a form around most of the page.  If nothing is left, class and id words are
disregarded.

References are decoded after markup is removed, white space inside a block is one space,
blocks are joined in page order by two newlines, and nothing is capped.

Edge cases: null or empty html gives the empty text and 0 characters; unclosed elements end
with their parent; an unclosed script, style or comment swallows the rest; a ``<`` that no ``>``
follows is text; once quotes leave no tag to be ended, quotes count as other characters; pages
of any length are read whole in linear time; repeated rows give equal rows; columns besides
those named are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_REMARKS = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|replies|responses)(?: \(\d+\))?:?|leave a (?:comment|reply)", re.I)
_SENTENCE = re.compile(r"[.!?…。！？]\W*$")

# Element names and class words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object canvas textarea title select".split())
_OPEN_RAW = frozenset("svg math object noscript select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BOX = frozenset("# article main section div body td blockquote center".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LINKS = frozenset("ul ol menu dl table div section".split())
_BOILERPLATE = frozenset("nav header footer aside form menu dialog button search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion rail "
    "remarks replies reply respond reviews share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar widget".split()
)
# words that may as well be a part of the text's own, and what makes them boilerplate all the same
_WEAK = frozenset("discussion discussions recommended related responses review".split())
_LISTS = frozenset("articles content items links news pages posts products reading stories topics videos".split())
# parts of compounds: what a word has in it, and what may follow or come before "ad" and "ads"
_COMPOUND = re.compile(r"advert|breadcrumb|comments|cookie|disqus|masthead|newsletter|paywall|pop(?:up|over)|sidebar|sponsor|^ads?(?:bar|block|box|container|frame|holder|label|panel|sense|slot|space|unit|wrap|wrapper|zone)|^comment(?:area|box|form|list|section|thread)|(?:banner|sky|text|top)ads?$")
_HEAD_WORDS = frozenset("header masthead banner".split())
_OWN_HEAD = frozenset("article content entry post story title".split())
_SAYS_NOTHING = frozenset("has with no without".split())
_WRAPPER = frozenset("wrap wrapper container layout page site outer inner".split())
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "option": (("option",), ("select", "datalist")),
}


def _class_words(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id has a word for boilerplate, one that tells less, and whether it may be that of a wrapper."""
    negative = weak = wrapper = False
    for name in value.lower().split():
        words = _WORD.findall(name)
        hit = [w for w in words if w in _NEGATIVE or _COMPOUND.search(w)]
        hit += [w for w, after in zip(words, [*words[1:], ""], strict=True) if w in _WEAK and (after in _LISTS or after == "list")]
        weak = weak or not _WEAK.isdisjoint(words)
        if not hit or words[0] in _SAYS_NOTHING or (_HEAD_WORDS.issuperset(hit) and not _OWN_HEAD.isdisjoint(words)):
            continue
        negative = True
        wrapper = wrapper or words[-1] in _WRAPPER
    return negative, weak, wrapper


class _Page:
    """Elements in page order (parents first) and blocks of text (element, text, characters in links)."""

    def __init__(self) -> None:
        self.tag, self.parent = ["#"], [-1]
        self.negative, self.named, self.weak, self.wrapper = [False], [False], [False], [False]  # by element or state; by class words; by those that tell less; of a possible wrapper
        self.blocks: list[tuple[int, str, int]] = []

    def add(self, tag: str, attributes: str, parent: int) -> int:
        negative, named, weak, wrapper = tag in _BOILERPLATE, False, False, False
        if attributes and tag not in ("html", "body", "main"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    one, less, other = _class_words(value)
                    named, weak, wrapper = named or one, weak or less, wrapper or other
                elif name == "hidden" or (name == "role" and value.lower() in _ROLES) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value.lower())):
                    negative = True
        for held, value in ((self.tag, tag), (self.parent, parent), (self.negative, negative), (self.named, named), (self.weak, weak), (self.wrapper, wrapper)):
            held.append(value)
        return len(self.tag) - 1


class _Ends:
    """Where the tags of a page end; each search for what isn't there is made once."""

    def __init__(self, source: str) -> None:
        self.source, self.quotes, self.missing = source, True, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def of_tag(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; those in quotes don't."""
        plain = self.find(">", at)
        if plain < 0 or not self.quotes:
            return plain
        now = at
        while True:
            end = self.find(">", now)
            if end < 0:
                self.quotes = False
                return plain
            first = min((q for q in (self.source.find('"', now, end), self.source.find("'", now, end)) if q >= 0), default=-1)
            if first < 0:
                return end
            close = self.find(self.source[first], first + 1)
            now = first + 1 if close < 0 else close + 1

    def of_raw(self, tag: str, at: int) -> int:
        """The place behind the end tag of an element whose content isn't read, or -1."""
        if tag in self.missing:
            return -1
        end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(self.source, at)
        if not end:
            self.missing.add(tag)
        return end.end() if end else -1


def _parse(source: str) -> _Page:
    page, stack, ends = _Page(), [0], _Ends(source)
    opened: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each name
    boxes = [0]  # depths of the open blocks
    parts: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[boxes[-1]], text, links))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag = page.tag[stack.pop()]
            opened[tag].pop()
            in_link -= tag == "a"
            if boxes[-1] >= len(stack):
                boxes.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in names if opened[t]), default=-1)

    def say(text: str) -> None:
        nonlocal links
        parts.append(text)
        if in_link:
            links += len(text)

    while (start := source.find("<", at)) >= 0:
        if start > at:
            say(source[at:start])
        at = start + 1
        if source.startswith("!--", at):
            end = source.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(source)
            continue
        name = _NAME.match(source, at)
        if source[at : at + 1] in ("!", "?") or name:
            end = ends.of_tag(name.end() if name else at) if name else ends.find(">", at)
        else:
            end = -1
        if end < 0:
            say("<")
            continue
        inner, at = (source[name.end() : end] if name else ""), end + 1
        if not name:
            continue
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag]:
                depth = opened[tag][-1]
                if tag in _BLOCK:
                    flush()
                if tag in _BLOCK or boxes[-1] < depth:  # an inline end tag doesn't close blocks
                    close(depth)
            elif tag == "p":
                flush()
            continue
        if tag in _RAW:
            end = ends.of_raw(tag, at)
            at = end if end >= 0 else at if tag in _OPEN_RAW else len(source)
            continue
        if tag in ("br", "hr", "img"):
            if tag == "hr":
                flush()
            say(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS:
                own, stop = (last(x) for x in _ENDS[tag])
                if own > stop:
                    close(own)
            if opened["p"]:
                close(opened["p"][-1])
            boxes.append(len(stack))
        in_link += tag == "a"
        opened[tag].append(len(stack))
        stack.append(page.add(tag, inner, stack[-1]))
    say(source[at:])
    flush()
    return page


def _sums(page: _Page, gone: list[bool] | None = None) -> tuple[list[int], list[int]]:
    """Characters, and characters in links, in each element and below."""
    n = len(page.tag)
    whole, linked = [0] * n, [0] * n
    for node, text, links in page.blocks:
        if not gone or not gone[node]:
            whole[node] += len(text)
            linked[node] += min(links, len(text))
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
        linked[page.parent[i]] += linked[i]
    return whole, linked


def _points_of(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _poor(page: _Page, whole: list[int], linked: list[int]) -> list[bool]:
    """Which elements with a word that tells less are no part of the text: lists and boxes, and what has few words, many links or few points a block."""
    n = len(page.tag)
    blocks, points, words = [0] * n, [0.0] * n, [0] * n
    for node, text, _ in page.blocks:
        blocks[node] += 1
        points[node] += _points_of(text)
        words[node] += len(text.split())
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        blocks[p], points[p], words[p] = blocks[p] + blocks[i], points[p] + points[i], words[p] + words[i]
    out = [False] * n
    for i in range(1, n):
        if page.weak[i]:
            own = page.tag[i] in ("p", "section", *_HEADING)
            up = page.parent[i]
            others, rest = blocks[up] - blocks[i], points[up] - points[i]
            like = not others or points[i] * others >= 0.5 * rest * blocks[i]
            heading = page.tag[i] in _HEADING
            out[i] = not own or (not heading and (words[i] < 5 or linked[i] * 4 > whole[i] or not like))
    return out


def _boilerplate(page: _Page, by_name: bool) -> list[bool]:
    """Which elements are, or are in, boilerplate."""
    n = len(page.tag)
    whole, linked = _sums(page)
    largest, size = -1, 0
    for i in range(n):
        if page.tag[i] in ("article", "main") and whole[i] - linked[i] > size:
            largest, size = i, whole[i] - linked[i]
    safe = [False] * n
    while largest >= 0:
        safe[largest], largest = True, page.parent[largest]
    remarks, seen = [False] * n, [False] * n
    for node, text, _ in page.blocks:  # an element that begins with a heading for comments
        box = page.parent[node]
        if box > 0 and not seen[box] and page.tag[box] not in ("html", "body", "article", "main"):
            remarks[box] = page.tag[node] in _HEADING and _REMARKS.fullmatch(text) is not None
        seen[box] = True
    poor = _poor(page, whole, linked) if by_name and any(page.weak) else page.weak
    gone, inside = [False] * n, [False] * n
    for i in range(1, n):
        p, tag = page.parent[i], page.tag[i]
        inside[i] = inside[p] or tag in ("article", "main")
        drop = page.negative[i] and not (tag == "header" and inside[p]) and not (tag in ("form", "fieldset") and whole[i] * 2 > whole[0])
        drop = drop or remarks[i] or (by_name and poor[i]) or (by_name and page.named[i] and not (page.wrapper[i] and whole[i] * 2 > whole[0]))
        gone[i] = gone[p] or (drop and not safe[i])
    return gone


def extract_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = _parse(source)
    n, tag, parent = len(page.tag), page.tag, page.parent
    for by_name in (True, False):
        gone = _boilerplate(page, by_name)
        kept = [b for b in page.blocks if not gone[b[0]]]
        if kept:
            break
    if not kept:
        return ""
    whole, linked = _sums(page, gone)
    density = [k / w if w else 0.0 for k, w in zip(linked, whole, strict=True)]

    has_article = [False] * n
    for i in range(n - 1, 0, -1):
        has_article[parent[i]] |= has_article[i] or (tag[i] == "article" and whole[i] > 0)
    around = [-1] * n  # the article, or main without one, that an element is in
    for i in range(1, n):
        around[i] = i if tag[i] == "article" or (tag[i] == "main" and not has_article[i]) else around[parent[i]]
    points = [0.0] * n
    for node, text, _ in kept:
        score = _points_of(text)
        # a bare run of text in a box counts for that box, a paragraph for what holds it
        level, up = 0, node if tag[node] in _BOX else parent[node]
        while up >= 0 and level < 5:
            if up != around[node]:
                points[up] += score / (1, 2, 6, 9, 12)[level]
            up, level = parent[up], level + 1
        if around[node] >= 0:
            points[around[node]] += score
    points = [s * (1 - d) for s, d in zip(points, density, strict=True)]
    best = max(range(n), key=lambda i: (points[i], -i))

    chosen = {best}
    inner = [False] * n
    for i in range(n):
        inner[i] = i == best or (i > 0 and inner[parent[i]])
    if best > 0:
        direct, headed = defaultdict(list), False
        for node, text, _ in kept:
            direct[node].append(text)
            headed |= inner[node] and tag[node] in ("h1", "h2")
        for i in range(1, n):
            if parent[i] != parent[best] or i == best or gone[i]:
                continue
            text = " ".join(direct[i])
            plain = tag[i] == "p" and ((len(text) >= 80 and density[i] < 0.25) or (0 < len(text) < 80 and not density[i] and _SENTENCE.search(text)))
            title = tag[i] in ("h1", "h2") and i < best and not headed and density[i] < 0.5
            if plain or title or points[i] >= 0.2 * points[best]:
                chosen.add(i)
    within = [False] * n
    for i in range(n):
        menu = tag[i] in _LINKS and density[i] > 0.8 and i not in chosen
        within[i] = i in chosen or (i > 0 and within[parent[i]] and not menu)
    return "\n\n".join(text for node, text, _ in kept if within[node])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, ``text``) of each row; no shuffle."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract_text(x.as_py()) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["id", "url", "text"])

    kinds = [source.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = source.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
