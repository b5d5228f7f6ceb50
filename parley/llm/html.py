"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The events of the standard parser make lines: the text between two block tags, with the number of tags it took.  End
tags that HTML lets a page leave out are supplied.  Elements that are never text (scripts, menus, footers, fields)
open no line.  Class words, forms and page headers only make a block suspicious.  Of all lines the text-to-tag ratio,
smoothed by a Gaussian over neighbours in the same block, is compared with a threshold; runs of lines above it are the
content regions.  A suspicious block stays out unless it holds much of the dense text, or all of it.  A region stands
for the part of the page that holds it: short lines of the same article belong to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset(
    "head title script style noscript template nav menu footer aside button select textarea input label legend option "
    "optgroup datalist svg canvas iframe object audio video map dialog".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
HOLDER = frozenset("article main section div td body center blockquote".split())
ROOTS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog "
                  "tablist".split())
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar rail aside footer foot masthead topbar toolbar cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "register share sharing social related recommended recommendations widget widgets pagination pager search "
    "searchform hidden skip copyright legal disclaimer".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADS = frozenset("header head pageheader siteheader".split())
PLACES = frozenset("area bar block bottom box button buttons col column container group inner item items left link links "
                   "list outer page panel right row site slot top unit wrap wrapper zone".split())
NEITHER = frozenset(("has", "with", "no"))  # "with-sidebar" names the page, not the sidebar
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
#: How far class words are believed: other words beside them, nothing else, readers' comments.
MAYBE, LIKELY, NEVER = 1, 2, 3

# What a start tag ends, and the elements beyond which it ends nothing.
TABLE = frozenset("table html template".split())
CELL = TABLE | frozenset("td th caption object".split())
ENDED = {tag: (frozenset(("p",)), CELL | {"button"}) for tag in
         "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 "
         "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDED["li"] = (frozenset(("li",)), CELL | {"ul", "ol", "menu"})
ENDED["dt"] = ENDED["dd"] = (frozenset(("dt", "dd")), CELL | {"dl"})
ENDED["td"] = ENDED["th"] = (frozenset(("td", "th", "caption")), TABLE)
ENDED["tr"] = (frozenset(("tr", "caption")), TABLE)
ENDED["tbody"] = ENDED["thead"] = ENDED["tfoot"] = (frozenset(("tbody", "thead", "tfoot", "caption")), TABLE)
ENDED["option"] = ENDED["optgroup"] = (frozenset(("option",)), CELL | {"select", "datalist"})
#: Elements beyond which an end tag ends nothing.
WITHIN = {"li": ENDED["li"][1], "dt": ENDED["dt"][1], "dd": ENDED["dd"][1]} | {
    tag: TABLE for tag in "td th tr tbody thead tfoot caption".split()} | {"table": frozenset(), "body": frozenset(),
                                                                          "html": frozenset()}


class Lines(HTMLParser):
    """Lines of one page: text, tags, characters inside links, the holder and the suspicious block they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.at: list[int] = []
        self.within: list[int] = []
        self.parent = [-1]  # of each holder
        self.name = ["page"]
        self.level = [0]  # of each suspicious block; block 0 is what lies outside them
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, opens furniture, opens a holder, block around it
        self.open: dict[str, int] = {}
        self.skip = 0
        self.holder = 0
        self.block = 0
        self.parts: list[str] = []
        self.seen = 0
        self.in_link = 0
        self.link_chars = 0

    def end_line(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.text.append(line)
                self.tags.append(self.seen)
                self.linked.append(self.link_chars)
                self.at.append(self.holder)
                self.within.append(self.block)
                self.seen = 0
            self.parts = []
            self.link_chars = 0

    def rooted(self) -> bool:
        return any(self.open.get(r) for r in ROOTS)

    def is_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE:
            return True
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def suspicion(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """How far the element's names speak against its text."""
        level = 0
        if tag == "form":
            level = MAYBE
        elif tag == "header" and not self.rooted():
            level = LIKELY
        if tag in ("html", "body"):
            return 0
        heads = frozenset() if self.rooted() else HEADS
        for name, value in attrs:
            if name == "role" and (value or "").lower() == "form":
                level = max(level, MAYBE)
            if name not in ("class", "id"):
                continue
            for part in (value or "").split():
                own = {w.lower() for w in SPLIT(part)}
                if own & NEITHER:
                    continue
                if own & COMMENTS:
                    level = NEVER
                elif tag in ROOTS:
                    level = max(level, LIKELY * ("ad" in own))
                elif own & WORDS or own & heads:
                    level = max(level, MAYBE if own - WORDS - HEADS - PLACES else LIKELY)
        return level

    def pop(self) -> str:
        name, furniture, holds, block = self.stack.pop()
        self.open[name] -= 1
        self.skip -= furniture
        self.in_link -= name == "a"
        self.block = block
        if holds:
            self.holder = self.parent[self.holder]
        return name

    def close_to(self, depth: int) -> None:
        self.end_line()
        while len(self.stack) > depth:
            self.pop()

    def imply_ends(self, tag: str) -> None:
        """Ends that the page may leave out before this start tag."""
        if self.open.get("head") and tag not in IN_HEAD:
            self.close_to(next(i for i, e in enumerate(self.stack) if e[0] == "head"))
        if tag == "main" and self.skip:  # the main part doesn't lie inside a menu
            self.close_to(next(i for i, e in enumerate(self.stack) if e[1]))
        targets, bounds = ENDED.get(tag, (frozenset(), TABLE))
        if any(self.open.get(t) for t in targets):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in bounds:
                    break
                if self.stack[i][0] in targets:
                    self.close_to(i)
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        self.imply_ends(tag)
        if tag in BLOCK:
            self.end_line()
        if tag in VOID:
            return
        furniture = self.is_furniture(tag, attrs) if attrs or tag in FURNITURE else False
        level = self.suspicion(tag, attrs) if attrs or tag in ("form", "header") else 0
        if tag not in BLOCK:  # part of a line: it goes where its names say nothing else
            furniture, level = furniture or level >= LIKELY, 0
        holds = tag in HOLDER
        self.stack.append((tag, furniture, holds, self.block))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.skip += furniture
        self.in_link += tag == "a"
        if level:
            self.level.append(max(level, self.level[self.block]))
            self.block = len(self.level) - 1
        if holds:
            self.parent.append(self.holder)
            self.name.append(tag)
            self.holder = len(self.parent) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCK:
            self.end_line()
        if not self.open.get(tag):
            return
        bounds = WITHIN.get(tag, CELL) if tag in BLOCK else BLOCK
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:  # unclosed elements inside end too
                    self.pop()
                return
            if self.stack[i][0] in bounds:
                if tag in BLOCK:
                    return
                break
        # An inline element that blocks were opened in: it ends, they don't.
        while self.stack[i][0] != tag:
            i -= 1
        _, furniture, _, _ = self.stack.pop(i)
        self.open[tag] -= 1
        self.skip -= furniture
        self.in_link -= tag == "a"

    def handle_data(self, data: str) -> None:
        if self.skip and self.stack[-1][0] == "head" and data.strip():
            self.close_to(len(self.stack) - 1)
        if not self.skip:
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data)


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """Values smoothed by a Gaussian; at the ends its weights are those of the neighbours that are there."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, weights)[reach:-reach]
    return total / np.convolve(np.ones(len(values)), weights)[reach:-reach]


def _subtrees(weight: np.ndarray, parent: list[int]) -> np.ndarray:
    """Weights of holders with those inside them: children come after their parents."""
    weight = weight.copy()
    for h in range(len(weight) - 1, 0, -1):
        weight[parent[h]] += weight[h]
    return weight


def _part_of(weight: np.ndarray, parent: list[int]) -> tuple[int, np.ndarray]:
    """The innermost holder of nearly all the weight, and which holders lie in it."""
    weight = _subtrees(weight, parent)
    at = 0
    if weight[0]:
        for h in range(1, len(weight)):
            if parent[h] == at and weight[h] >= 0.9 * weight[0]:
                at = h
    own = np.zeros(len(weight), bool)
    own[at] = True
    for h in range(at + 1, len(weight)):
        own[h] = own[parent[h]]
    return at, own


def content_lines(page: Lines, sigma: float, share: float, least: int) -> np.ndarray:
    """Which lines are content."""
    chars = np.array([len(t) for t in page.text], np.float64)
    linked = np.minimum(np.array(page.linked, np.float64), chars)
    ratio = (chars - linked) / np.maximum(1, np.array(page.tags))
    heavy = linked > 0.5 * chars
    holders, block = np.array(page.at), np.array(page.within)
    inside = np.zeros(len(page.parent), bool)
    for h in range(1, len(inside)):
        inside[h] = inside[page.parent[h]] or page.name[h] in ROOTS
    rooted = inside[holders]
    # An article's lines don't lift what stands beside it.
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (rooted[1:] != rooted[:-1])) + 1
    smooth = np.concatenate([gaussian(r, sigma) for r in np.split(ratio, cuts)])
    dense = smooth >= min(smooth.std(), smooth.mean())
    mass = np.bincount(block, np.where(dense, chars - linked, 0), minlength=len(page.level))
    level = np.array(page.level)
    good = (level == 0) | (level == MAYBE) & (mass >= max(share * mass.sum(), least))
    if not (good[block] & dense & ~heavy).any():  # no text elsewhere: the names mislead
        most = int(np.where((level > 0) & (level < NEVER), mass, 0).argmax())
        good[most] |= mass[most] >= least
    keep = good[block]
    inner = keep & rooted
    if (inner & dense).any():
        # A section or div of links inside the article is no text, single lines are; beside it dense regions stay.
        links = _subtrees(np.bincount(holders, linked, minlength=len(inside)), page.parent)
        size = _subtrees(np.bincount(holders, chars, minlength=len(inside)), page.parent)
        many = _subtrees(np.bincount(holders, heavy, minlength=len(inside)), page.parent) >= 3
        drop = np.zeros(len(inside), bool)
        for h in range(1, len(inside)):
            above = page.parent[h]
            drop[h] = drop[above] or inside[above] and page.name[h] not in ROOTS and many[h] and links[h] > 0.5 * size[h]
        inner &= ~drop[holders]
        region = keep & ~rooted & (smooth >= smooth.mean())
        at, own = _part_of(np.bincount(holders, np.where(region, chars, 0), minlength=len(inside)), page.parent)
        if region.any() and not (own & inside).any():
            region |= keep & own[holders] & ~rooted
    else:
        inner &= ~heavy
        region = keep & dense
        _, own = _part_of(np.bincount(holders, np.where(region & ~heavy, chars, 0), minlength=len(inside)), page.parent)
        region |= keep & own[holders]
    # Outside an article a line of links counts only between two lines of text.
    text = np.r_[False, region & ~heavy, False]
    return inner | region & (~heavy | text[:-2] & text[2:])


def main_text(html: str, sigma: float = 1.5, share: float = 0.4, least: int = 250) -> str:
    """The content lines of a page, in order, with one space between.

    A form, or a block with a suspicious word among others in its class, is content if it holds ``share`` of the dense
    text and ``least`` characters; any suspicious block but readers' comments is if there is no other dense text.
    """
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.text:
        return ""
    return " ".join(t for t, ok in zip(page.text, content_lines(page, sigma, share, least)) if ok)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.5,
            share: float = 0.4, least: int = 250) -> DataFrame:
    """Columns ``keep`` of every row with ``text`` and ``n_chars`` (code points).

    A null or empty page, and one without content, has the empty text.  Nothing is cut, however long a page is.
    Repeated rows stay, nulls in kept columns too.  An empty table gives no rows.  Other columns are not read.
    """
    small_batches(pages.sparkSession, 500)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma, share, least) if h else "" for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, html).mapInArrow(apply, kinds + "text string, n_chars long")
