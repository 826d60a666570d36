"""HTML extraction by minimum cut: blocks of a page are labelled content or boilerplate together.

A page is read once, tag by tag, tolerant of what is unclosed. Text outside markup, scripts, styles and comments forms
blocks, bounded by block-level tags; inline tags and <br> only part words. A logistic classifier (fixed weights) turns a
block's place (the elements around it and words of their class, id and role), size and links into a probability of
content; evidence is bounded, and what speaks against an element around the whole article doesn't count. Its two costs become capacities from the source and to the sink; edges of smoothness join neighbouring
blocks, more strongly the closer they lie in the tree (same parent, same section), less across the border of a
sectioning element. A maximum flow gives the cheapest labelling; blocks on the source's side are the article, joined in
page order.

Null html is empty: text "" with 0 characters. Pages of any size and depth are read whole; each row gives one result,
repeated rows too; an empty table gives an empty result; other columns pass by. White space is [\\x20\\x09-\\x0D] and the no-break space.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that bound blocks, whose text is no text, that are sections of their own, and void ones.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = set("script style noscript template textarea iframe object svg math canvas select button title head datalist audio video applet map".split())
RAW = set("script style textarea title iframe noscript xmp noembed noframes".split())
SECTION = set("article aside body div footer form header main nav section table".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when another of the first column begins.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that may stand in the head; others end it.
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: Elements that are boilerplate even around an article.
NEVER_AROUND = set("nav aside footer dialog menu".split())
#: Bounds of an element's and a block's evidence.
LEAST_ODDS, MOST_ODDS = -9.0, 4.0
#: Evidence (log odds of content) of elements around a block, and of words in their class, id and role.
TAG_ODDS = {"article": 3.0, "main": 2.5, "p": 0.6, "h1": 1.0, "h2": 0.6, "h3": 0.5, "blockquote": 0.6, "pre": 0.6, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -4.0, "form": -5.0, "menu": -5.0, "dialog": -6.0, "fieldset": -4.0, "figcaption": 0.3}
WORD_ODDS = {
    "content": 1.5, "article": 2.0, "post": 1.0, "entry": 1.0, "main": 1.5, "story": 1.5, "text": 0.8, "body": 0.5,
    "nav": -5.0, "navigation": -5.0, "navbar": -5.0, "menu": -5.0, "footer": -6.0, "header": -3.0, "sidebar": -6.0, "side": -3.0, "aside": -5.0, "widget": -4.0, "ad": -7.0, "ads": -7.0, "advert": -7.0, "advertisement": -7.0, "adsense": -7.0, "banner": -5.0, "sponsor": -6.0, "sponsored": -6.0, "promo": -5.0, "promotion": -5.0,
    "cookie": -7.0, "cookies": -7.0, "consent": -7.0, "gdpr": -7.0, "notice": -6.0, "notification": -5.0, "alert": -4.0, "popup": -6.0, "modal": -6.0, "overlay": -5.0, "comment": -7.0, "comments": -7.0, "disqus": -7.0, "reply": -5.0, "replies": -5.0, "respond": -6.0, "share": -5.0, "sharing": -5.0, "social": -5.0, "related": -5.0, "recommended": -5.0, "breadcrumb": -5.0, "breadcrumbs": -5.0, "newsletter": -6.0, "subscribe": -6.0, "signup": -5.0, "login": -5.0, "search": -5.0, "tags": -3.0, "copyright": -5.0, "legal": -3.0, "disclaimer": -4.0, "skip": -4.0, "pagination": -5.0, "pager": -5.0, "toolbar": -4.0, "contentinfo": -6.0, "complementary": -6.0,
}
BIAS, LINK_ODDS, LENGTH_ODDS, NO_HOME = 0.2, -5.0, 0.35, -1.0
#: Smoothness: of neighbours, by how near in the tree they are; added between blocks of one parent that are not adjacent.
NEXT, SAME_PARENT, SAME_SECTION, OTHER, SIBLING = 0.2, 1.0, 0.5, 0.05, 0.4
#: Quotes have a meaning behind = alone; one that is never closed, or not before white space, / or >, is a character.
VALUE = r"""(?>"[^"<>]*"|'[^'<>]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s>]*)"""
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+{VALUE})*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D\xA0]+")
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


def odds_of(tag: str, attributes: str) -> float:
    """Evidence of one element; hidden ones are no content."""
    odds = TAG_ODDS.get(tag, 0.0)
    for name, *values in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            odds -= 8
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in WORD.findall(value)}
            odds += sum(WORD_ODDS.get(w, 0.0) for w in words)
    return max(LEAST_ODDS, min(MOST_ODDS, odds))


class Block:
    """Text between two block-level borders. home: the element it stands in, around: that element's block-level parent, section: the sectioning element."""

    __slots__ = ("parts", "linked", "home", "around", "section", "odds", "text")

    def __init__(self, home: int, around: int, section: int):
        self.parts, self.linked, self.home, self.around, self.section, self.odds, self.text = [], 0, home, around, section, 0.0, ""


class Page:
    """What a pass over a page finds: its elements (tag, own evidence, parent, all by number) and the blocks with text, in order."""

    def __init__(self):
        self.tags, self.odds, self.parents, self.blocks = [""], [0.0], [0], []

    def read(self, page: str) -> None:
        """Reads tag by tag. Of each open element the stack holds: tag, number, nearest block-level element at or above it,
        nearest sectioning element, open links, silent elements."""
        stack = [("", 0, 0, 0, 0, 0)]
        current, at, size, open_ = None, 0, len(page), {}
        around = [0]  # by element: the block-level element above its nearest block-level one
        lower = None

        def close(k: int) -> None:
            for e in stack[k:]:
                open_[e[0]] -= 1
            del stack[k:]

        def text(piece: str) -> None:
            nonlocal current
            if not piece:
                return
            if stack[-1][0] == "head" and WHITE.sub("", piece):
                close(len(stack) - 1)  # text ends the head
            top = stack[-1]
            if top[5]:
                return
            if current is None:
                if not WHITE.sub("", piece):
                    return
                current = Block(top[2], around[top[2]], top[3])
                self.blocks.append(current)
            current.parts.append(piece)
            if top[4]:
                current.linked += len(piece)

        while at < size:
            m = PIECE.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if tag in BLOCK:
                current = None
            elif tag == "br":
                text("\n")
            if m[1]:
                if open_.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] in SECTION and tag not in SECTION:
                            break  # a stray end tag closes nothing beyond its section
                continue
            if open_.get("head") and tag not in IN_HEAD:
                close(next(k for k, e in enumerate(stack) if e[0] == "head"))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDS[tag]:
                        close(k)
                        break
                    if stack[k][0] in BLOCK and not (tag == "tr" and stack[k][0] in ("td", "th")):
                        break
            if tag in BLOCK and tag != "p" and stack[-1][0] == "p":
                close(len(stack) - 1)
            above, number = stack[-1], len(self.tags)
            self.tags.append(tag)
            self.odds.append(0.0 if tag in ("html", "body") else odds_of(tag, m[3]))
            self.parents.append(above[1])
            around.append(above[2])
            open_[tag] = open_.get(tag, 0) + 1
            stack.append((tag, number, number if tag in BLOCK else above[2], number if tag in SECTION else above[3], above[4] + (tag == "a"), above[5] + (tag in SILENT)))
            if tag in RAW:
                if lower is None:
                    lower = page.lower() if len(page.lower()) == size else re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{tag}", at)
                at = size if end < 0 else end

    def inside(self) -> tuple[list[int], list[int]]:
        """By element: the first and the last of the blocks below it (their number and -1 if there is none)."""
        first, last = [len(self.blocks)] * len(self.tags), [-1] * len(self.tags)
        for k, block in enumerate(self.blocks):
            first[block.home], last[block.home] = min(first[block.home], k), max(last[block.home], k)
        for e in range(len(self.tags) - 1, 0, -1):
            up = self.parents[e]
            first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
        return first, last

    def judge(self) -> None:
        """Gives blocks their text and the evidence of the elements around them.

        Negative evidence adds up, of positive evidence the strongest counts, within bounds. Evidence against an element
        around the article is no evidence against the article: pages stand in forms, and classes tell of sidebars. The
        article begins with the first article or main element that nothing of its own speaks against; without one, with
        the first h1; without that, elements with nine tenths of the text are around it.
        """
        for block in self.blocks:
            block.text = WHITE.sub(" ", entities.unescape("".join(block.parts))).strip(" ")
        self.blocks = [b for b in self.blocks if b.text]
        first, last = self.inside()
        begins = [e for e, tag in enumerate(self.tags) if tag in ("article", "main") and self.odds[e] > 0 and last[e] >= 0]
        any_main = bool(begins)
        begins = begins or [e for e, tag in enumerate(self.tags) if tag == "h1" and last[e] >= 0]
        upto = [0]
        for block in self.blocks:
            upto.append(upto[-1] + len(block.text))
        around = set()
        if begins:
            e = self.parents[begins[0]]
            while e:
                around.add(e)
                e = self.parents[e]
        else:
            around = {e for e in range(len(self.tags)) if last[e] >= 0 and 10 * (upto[last[e] + 1] - upto[first[e]]) >= 9 * upto[-1]}
        total, in_main = [0.0] * len(self.tags), [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            tag, odds, up = self.tags[e], self.odds[e], self.parents[e]
            if odds < 0 and (e in around and tag not in NEVER_AROUND or tag == "header" and in_main[up]):
                odds = 0.0
            above = total[up]
            total[e] = max(LEAST_ODDS, above + odds if odds < 0 else max(above, odds) if above >= 0 else above + min(odds, 0.5))
            in_main[e] = in_main[up] or tag in ("article", "main")
        for block in self.blocks:
            block.odds = total[block.home] + (0.0 if in_main[block.home] or not any_main else 2 * NO_HOME)


def read_page(page: str) -> list[Block]:
    """The blocks of a page with text and evidence, in order."""
    found = Page()
    found.read(page)
    found.judge()
    return found.blocks


def content_odds(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    share = block.linked / max(1, sum(map(len, block.parts)))
    return BIAS + block.odds + LINK_ODDS * max(0.0, share - 0.3) + LENGTH_ODDS * min(3.0, math.log1p(len(block.text) / 20))


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut. A node's odds are its capacity from the source (positive) or to the sink."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, x in enumerate(odds):
        if x >= 0:
            edge(source, k, x, 0.0)
        else:
            edge(k, sink, -x, 0.0)
    for (a, b), w in edges.items():
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        used = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                cut = None
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if cut is None and room[e] <= 1e-9:
                        cut = k
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while used[a] < len(graph[a]):
                e = graph[a][used[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                used[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None) -> str:
    """The article of a page."""
    found = read_page(page) if page else []
    if not found:
        return ""
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1]
            edges[k - 1, k] = NEXT + (SAME_PARENT if a.around == b.around and a.section == b.section else SAME_SECTION if a.section == b.section else OTHER)
        j = last_of.get(b.around)
        if j is not None and j < k - 1:
            edges[j, k] = SIBLING
        last_of[b.around] = k
    kept = min_cut([content_odds(b) for b in found], edges)
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep with text and n_chars of each row. One scan, no shuffle."""

    def work(frames):
        for frame in frames:
            for start in range(0, len(frame), 500):
                part = frame.iloc[start : start + 500]
                texts = [main_text(h) if isinstance(h, str) else "" for h in part["_html"]]
                yield part.drop(columns="_html").assign(text=pd.Series(texts, index=part.index, dtype=object))

    read = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "_html")
    return read.mapInPandas(work, f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))
