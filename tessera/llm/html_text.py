"""Main text of web pages by two passes over their blocks.

A page's markup is cut into blocks at block-level tags. The first pass judges
each block by its length, stop-word density and link density, and by where it
stands: what is needed to be good is little inside a page's article, more
outside it, and more again where a class or id hints at another part of the
page. Menus, forms and the like, by tag, or by a class that names nothing else,
are bad whatever they say. Short blocks stay undecided. In the second pass they
take the label of the nearest decided neighbours; where these differ, a block
inside the page's article is good.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .session import light

#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "textarea", "title", "noframes", "xmp"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "head", "audio", "video", "datalist", "label", "optgroup", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "semantics", "object", "canvas", "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "meter", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
#: Words in class, id and role that tell a part of a page that isn't its article.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus",
    "footer", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "alert", "gdpr", "login", "recommend", "recommended", "recommendations",
}
#: Words that say nothing about a part: a class of them and of one above names that part, one with other words only hints at it.
GENERIC = {
    "area", "articles", "aside", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "center", "col", "column", "container", "content", "fixed", "form", "global", "grid", "group", "holder", "icons", "info", "inline", "inner", "item", "items", "left", "link", "links", "list", "local", "main",
    "media", "message", "outer", "overlay", "page", "panel", "post", "posts", "primary", "region", "right", "rail", "row", "secondary", "section", "site", "slot", "small", "stories", "sub", "text", "thread", "title", "top", "unit", "view", "wrap", "wrapper", "zone", "js", "ui", "the", "and", "us", "your", "hidden", "large", "desktop", "mobile", "sticky",
}
#: Words by which a name only mentions such a part, as in has-sidebar.
WITHOUT = {"has", "no", "with", "without"}
#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with you not but they"
    " au aux ce ces dans de des du elle en est et il la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous"
    " als am an auf aus bei das dem den der des die ein eine einem einen einer er es für im in ist mit nicht sich sie sind so und von war wie zu zum zur auch dass"
    " al como con cuando del el ella en es esta este las lo los más me mi muy no o para pero por se sin sobre su sus una uno y ya".split()
)

#: A quote counts where its closing one ends an attribute; else it is a character like others, so that a tag with an open quote ends all the same.
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[\"'])*+)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")

#: A block with fewer characters is short; a longer one needs this share of stop words, and at most this share of its characters in links.
SHORT, STOP_LOW, STOP_HIGH, LINKS = 70, 0.02, 0.08, 0.4


@dataclass
class Block:
    main: bool
    bad: bool
    hint: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


#: What an element's attributes say: it names a part that isn't the article, hints at one, or neither.
NAMED, HINT, NOTHING = 2, 1, 0


def _says(attributes: str, whole: bool) -> int:
    """whole: only a class that is one of the names as it stands counts."""
    most = NOTHING
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return NAMED
        if name in ("class", "id", "role"):
            for token in value.split():
                words = {token.lower()} if whole else {p.lower() for p in PART.findall(token)}
                if words & NAMES and not words & WITHOUT:
                    if words <= NAMES | GENERIC:
                        return NAMED
                    most = HINT
    return most


class Place:
    """The open elements that change where we are, with counts instead of searches."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []
        self.open: dict[str, int] = {}
        self.says, self.main = [0, 0, 0], 0

    def enter(self, tag: str, says: int, main: bool) -> None:
        self.stack.append((tag, says, main))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.says[says] += 1
        self.main += main

    def leave(self, tag: str) -> None:
        while True:
            top, says, main = self.stack.pop()
            self.open[top] -= 1
            self.says[says] -= 1
            self.main -= main
            if top == tag:
                return

    def block(self) -> Block:
        return Block(self.main > 0, self.says[NAMED] > 0, self.says[HINT] > 0)


def blocks(page: str) -> list[Block]:
    """A page's blocks in order, those without text left out."""
    out: list[Block] = []
    now, place = Block(False, False), Place()
    links, at, n = 0, 0, len(page)

    def say(text: str) -> None:
        if text:
            now.parts.append(text)
            if links:
                now.linked += len(WHITE.sub("", text))

    def end_block() -> None:
        nonlocal now
        if now.parts:
            now.text = WHITE.sub(" ", html.unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
        now = place.block()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag in VOID or closing:
                if closing and place.open.get(tag):
                    end_block()
                    place.leave(tag)
                    end_block()
            elif says := _says(attributes, False):
                if says == NAMED or place.main == 0:
                    end_block()
                    place.enter(tag, NAMED, False)
                    end_block()
            continue
        end_block()
        links = 0
        if tag in VOID:
            continue
        if closing:
            if place.open.get(tag):
                place.leave(tag)
        elif tag == "p":
            pass  # paragraphs often stay open; they say nothing about where we are unless named
        else:
            inside = place.main > 0
            says = NAMED if tag in ASIDE and not (tag == "header" and inside) else _says(attributes, tag in MAIN or tag == "body")
            if says == HINT and not inside:
                says = NAMED
            if says or tag in MAIN or tag in ASIDE or place.open.get(tag) or tag in ("div", "section", "ul", "ol", "dl", "table"):
                place.enter(tag, says, tag in MAIN and says != NAMED)
        now = place.block()
        if tag == "p" and not closing:
            says = _says(attributes, False)
            now.bad |= says == NAMED or (says == HINT and not now.main)
            now.hint |= says == HINT
    end_block()
    return out


def densities(b: Block) -> tuple[int, float, float]:
    """Characters, share of stop words among words, and of characters in links."""
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))
    return len(b.text), stop, b.linked / max(1, len(b.text.replace(" ", "")))


def first_pass(b: Block, marked: bool) -> bool | None:
    """A block's label by itself; None if it is too short to tell. marked: whether the page has an article."""
    size, stop, links = densities(b)
    if b.bad:
        return False
    if links > LINKS and (b.hint or not b.main):
        return False
    if size < SHORT:
        return False if marked and not b.main else None
    if b.main:  # lists and tables of an article have few stop words
        return stop >= STOP_LOW if b.hint else True
    if marked:
        return stop >= STOP_HIGH  # a page that marks its article has little else worth keeping
    return stop >= (STOP_LOW if size > 3 * SHORT else STOP_HIGH)


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are the article's."""
    marked = any(b.main and not b.bad for b in found)
    labels = [first_pass(b, marked) for b in found]

    def nearest(order) -> dict[int, bool | None]:
        """The label of the last decided block before each, and inside an article of the last one there."""
        out, last = {}, {True: None, False: None}
        for k in order:
            out[k] = last[found[k].main]
            if labels[k] is not None and not (found[k].bad and found[k].main):
                last[False] = labels[k]
                last[True] = labels[k] if found[k].main else None
        return out

    before, after = nearest(range(len(found))), nearest(reversed(range(len(found))))
    out = []
    for k, (b, label) in enumerate(zip(found, labels)):
        if label is None:
            near = {x for x in (before[k], after[k]) if x is not None}
            label = near != {False} if b.main else near == {True}
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, classify(found)) if good)


def _texts(batches):
    for batch in batches:
        names = batch.schema.names
        pages = batch.column(names.index("html"))
        for a in range(0, batch.num_rows, 256):
            rows = batch.slice(a, 256)
            texts = [main_text(x.as_py()) for x in pages.slice(a, 256)]
            yield pa.RecordBatch.from_arrays([rows["page_id"].cast(pa.int64()), rows["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html; other columns are not read).

    Returns page_id, url, text and n_chars (its code points). Character
    references are decoded, white space inside a block is one space, blocks
    are joined by one line feed. Null and empty pages, and pages without an
    article's text, have an empty text; a repeated row is a row of its own.
    """
    return pages.select("page_id", "url", "html").mapInArrow(light(_texts), "page_id long, url string, text string, n_chars long")
