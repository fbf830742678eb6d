"""Pages as trees of blocks: parsing, features of each block, and pages to learn from."""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass, field
from html import unescape

import numpy as np

#: Content of these is never text, and its tags are none: it ends at the end tag or with the page.
_RAW = "script|style|textarea|title|iframe|noscript"
#: Content of these is never text either. One without an end tag behind it hides nothing; one
#: whose end tag stands behind its parent's ends with the parent.
_HIDDEN = frozenset("template object svg math canvas select button".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_HIDDEN_END = re.compile(rf"</({'|'.join(sorted(_HIDDEN))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")

#: Kinds of blocks that features tell apart; all other tags are inline and belong to the block around.
KINDS = ("root", "p", "heading", "list", "item", "article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "quote", "figure", "pre")
_KIND = {
    "html": 0, "body": 0, "p": 1, "ul": 3, "ol": 3, "dl": 3, "menu": 3, "li": 4, "dt": 4, "dd": 4, "article": 5, "main": 6, "nav": 7, "header": 8, "footer": 9, "aside": 10,
    "form": 11, "fieldset": 11, "dialog": 11, "section": 12, "div": 12, "center": 12, "hgroup": 12, "address": 12, "details": 12, "summary": 12, "table": 13, "tbody": 13, "thead": 13, "tfoot": 13, "tr": 13,
    "td": 13, "th": 13, "caption": 13, "blockquote": 14, "figure": 15, "figcaption": 15, "pre": 16, "hr": 12,
} | {f"h{i}": 2 for i in range(1, 7)}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first ends an open tag of the second, up to the nearest of the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_AROUND_P = {"td", "th", "table", "li", "blockquote", "article", "div", "section", "main", "body", "aside", "figure", "form"}

#: Groups of words in class, id and role attributes.
GROUPS = (
    {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "toolbar"},
    {"header", "masthead", "topbar", "branding", "logo", "banner", "site"},
    {"footer", "copyright", "legal", "bottom", "colophon", "contentinfo"},
    {"sidebar", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "more", "tags", "complementary"},
    {"notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "overlay", "warning", "announcement", "message", "paywall"},
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "promotion", "adsense", "banner", "outbrain", "taboola", "commercial"},
    {"form", "login", "signup", "subscribe", "newsletter", "search", "register", "signin", "contact"},
    {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "discussion", "reader", "feedback", "review", "reviews"},
    {"share", "sharing", "social", "follow", "byline", "meta", "author", "tools", "print"},
    {"article", "content", "main", "post", "entry", "story", "text", "body", "articlebody", "page", "blog", "hentry"},
)


@dataclass
class Page:
    kind: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # one behind the last block inside
    groups: list[int] = field(default_factory=list)  # bits
    tokens: list[int] = field(default_factory=list)  # hashed words of attributes, as bits
    depth: list[int] = field(default_factory=list)
    above_kind: list[int] = field(default_factory=list)  # bits, of all blocks around
    above_groups: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)  # of the block's own text
    linked: list[int] = field(default_factory=list)  # of these, in links
    marks: list[int] = field(default_factory=list)  # of these, punctuation
    inline: list[int] = field(default_factory=list)
    runs: list[tuple[int, list[str]]] = field(default_factory=list)  # (block, its pieces of text)


#: Words of attributes are hashed to so many places, whether they are in a group or not.
TOKEN_PLACES = 48


def _attribute_words(attributes: str) -> tuple[int, int]:
    """(bits of the groups, bits of the hashed places) of the words in class, id and role."""
    groups = places = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORDS.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            places |= 1 << zlib.crc32(w.encode()) % TOKEN_PLACES
            for g, words in enumerate(GROUPS):
                if w in words:
                    groups |= 1 << g
    return groups, places


class _Open:
    """The open elements, from the outermost in, and where those of each tag stand."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []  # tag, block, whether the block is its own
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, block: int, own: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block, own))

    def pop(self) -> tuple[str, int, bool]:
        top = self.stack.pop()
        self.places[top[0]].pop()
        return top

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags; 0, the page's own, without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def parse(html: str) -> Page:
    """The tree of a page's blocks, forgiving as browsers are about tags left open. Time and
    space grow with the page's length alone, however deep its tags are."""
    page = Page()
    opened_now = _Open()
    stack = opened_now.stack
    links, at, fresh, hidden = 0, 0, True, 0
    last_end: dict[str, int] = {}  # of hidden elements
    for m in _HIDDEN_END.finditer(html):
        last_end[m[1].lower()] = m.start()

    def opened(tag: str, attributes: str) -> None:
        nonlocal fresh
        up = stack[-1][1] if stack else -1
        if hidden:
            opened_now.push(tag, up, False)
            return
        opened_now.push(tag, len(page.kind), True)
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.above_kind.append(page.above_kind[up] | 1 << page.kind[up] if up >= 0 else 0)
        page.above_groups.append(page.above_groups[up] | page.groups[up] if up >= 0 else 0)
        page.kind.append(_KIND[tag])
        page.end.append(0)
        groups, places = _attribute_words(attributes) if "=" in attributes else (0, 0)
        page.groups.append(groups)
        page.tokens.append(places)
        for x in (page.chars, page.linked, page.marks, page.inline):
            x.append(0)
        fresh = True

    def closed(down_to: int) -> None:
        nonlocal fresh, hidden
        while len(stack) > down_to:
            tag, block, own = opened_now.pop()
            if own:
                page.end[block] = len(page.kind)
            hidden -= tag in _HIDDEN
        fresh = True

    def text(raw: str) -> None:
        nonlocal fresh
        if hidden:
            return
        if "&" in raw:
            raw = unescape(raw)
        node = stack[-1][1]
        if raw and not raw.isspace():
            n = len(raw)
            page.chars[node] += n
            page.linked[node] += n if links else 0
            page.marks[node] += len(_PUNCTUATION.findall(raw))
        elif fresh:
            return
        if fresh:
            page.runs.append((node, []))
            fresh = False
        page.runs[-1][1].append(raw)

    opened("body", "")
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _HIDDEN:
            if m[2]:
                if place := opened_now.nearest((tag,)):
                    broken = fresh
                    closed(place)
                    fresh = broken
            elif last_end.get(tag, -1) > m.start() and not m[4].endswith("/"):
                opened_now.push(tag, stack[-1][1], False)
                hidden += 1
            continue
        if tag not in _KIND:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                text(" ")
            elif not m[2] and not hidden:
                page.inline[stack[-1][1]] += 1
            continue
        if m[2]:
            if place := opened_now.nearest((tag,)):
                closed(place)
            fresh, links = True, 0
            continue
        if tag in ("html", "body"):
            continue
        links = 0 if tag != "li" else links
        if tag in _CLOSES:
            ends, around = _CLOSES[tag]
            border = opened_now.nearest(around)
            while (place := opened_now.nearest(ends)) > border:
                closed(place)
        if (place := opened_now.nearest(("p",))) > opened_now.nearest(_AROUND_P):
            closed(place)
        opened(tag, m[4])
        if tag in _VOID or m[4].endswith("/"):
            closed(len(stack) - 1)
    if at < len(html):
        text(html[at:])
    closed(0)
    return page


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every block of all pages, its parent's row, each page's end)."""
    sizes = np.array([len(p.kind) for p in pages])
    ends = np.cumsum(sizes)
    base = np.repeat(ends - sizes, sizes)
    join = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    kind, groups, chars, linked, marks, inline = map(join, ("kind", "groups", "chars", "linked", "marks", "inline"))
    parent = join("parent")
    root = parent < 0
    parent = np.where(root, np.arange(len(parent)), parent + base)
    end = join("end") + base
    n = len(kind)
    row = np.arange(n)

    def inside(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[row]

    all_chars, all_linked, all_marks, blocks = inside(chars), inside(linked), inside(marks), end - row
    tags = blocks + inside(inline)
    depth, above_kind, above_groups, places = map(join, ("depth", "above_kind", "above_groups", "tokens"))
    order = np.bincount(parent[~root], minlength=n)  # children of each block
    siblings = np.where(root, 1, order[parent])
    first = np.zeros(n, np.int64)
    place = np.zeros(n, np.int64)
    by = np.argsort(np.where(root, -1, parent), kind="stable")
    fresh = np.concatenate([[True], np.where(root, -1, parent)[by][1:] != np.where(root, -1, parent)[by][:-1]])
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    place[by] = np.arange(n) - start
    sibling_chars = np.bincount(parent[~root], all_chars[~root], n)
    same = np.bincount((parent * len(KINDS) + kind)[~root], minlength=n * len(KINDS))[parent * len(KINDS) + kind]
    total = np.maximum(1, all_chars[base])
    div = lambda a, b: a / np.maximum(b, 1)
    columns = [
        np.log1p(all_chars), np.log1p(chars), div(all_linked, all_chars), div(all_marks * 100, all_chars), np.log1p(div(all_chars, tags)), np.log1p(blocks), all_chars / total,
        depth, np.log1p(siblings), div(place, siblings), np.log1p(same), np.log1p(div(np.where(root, 0, sibling_chars[parent]), siblings)), div(all_chars, np.where(root, all_chars, sibling_chars[parent])),
        (row - base) / np.repeat(sizes, sizes),
    ]
    columns += [kind == k for k in range(len(KINDS))]
    columns += [(above_kind >> k) & 1 for k in (4, 5, 6, 7, 8, 9, 10, 11, 14)]
    columns += [(groups >> g) & 1 for g in range(len(GROUPS))]
    columns += [(above_groups >> g) & 1 for g in range(len(GROUPS))]
    columns += [(places >> k) & 1 for k in range(TOKEN_PLACES)]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1), np.where(root, -1, parent), ends


def decode(margin: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The set of blocks with the greatest sum of log-odds in which no block is kept under one
    that goes. Children stand behind their parents; a page's root always stays."""
    best = margin.copy()
    for i in range(len(best) - 1, -1, -1):
        if parent[i] >= 0 and best[i] > 0:
            best[parent[i]] += best[i]
    kept = np.zeros(len(best), bool)
    for i, p in enumerate(parent.tolist()):
        kept[i] = p < 0 or (kept[p] and best[i] > 0)
    return kept


def blocks_of_text(page: Page, kept: np.ndarray) -> list[str]:
    """The kept blocks' texts in page order, white space as one space."""
    out = [" ".join("".join(pieces).split()) for node, pieces in page.runs if kept[node]]
    return [t for t in out if t]


class Teacher:
    """Invented pages whose main text is known: the article, among boilerplate of all kinds, in
    markup from semantic tags to bare divisions. In titles and texts, @ marks main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.known = True  # whether attributes say what they hold, or a page's names mean nothing

    def words(self, low: int, high: int) -> str:
        r = self.r
        ends = r.choice((("",), ("", "", "", ",", "."), (".",), ("", "", "!!", "***")))  # any text may hold any punctuation
        out = ["".join(r.choice("aeioubcdlmnprst") for _ in range(r.randint(1, 12))) + r.choice(ends) for _ in range(r.randint(low, high))]
        return " ".join(w.capitalize() if r.random() < 0.2 else w for w in out)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))

    def attribute(self, *names: str) -> str:
        name = self.r.choice(names) if self.known else "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 9)))
        return self.r.choice((f' class="{name}"', f' id="{name}"', f' class="{self.r.choice(("l", "col", "x1", "wrap"))} {name}"', f' class="{name}-{self.r.choice(("box", "inner", "area"))}"'))

    def links(self, low: int, high: int) -> str:
        item = lambda: f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>'
        n = self.r.randint(low, high)
        return self.r.choice((lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(item() for _ in range(n)), lambda: "<ul>" + "".join(f"<li>{item()}" for _ in range(n)) + "</ul>"))()

    def noise(self, inside: bool = False) -> str:
        r, kind = self.r, self.r.randrange(8)
        line = lambda: self.r.choice((self.sentences(1, 2), self.words(2, 14), f"<p>{self.sentences(1, 3)}</p>"))
        if kind == 0:
            return r.choice((f"<nav>{self.links(2, 9)}</nav>", f"<div{self.attribute('nav', 'menu', 'breadcrumb', 'navbar', 'pagination')}>{self.links(2, 9)}</div>"))
        if kind == 1 and not inside:
            return r.choice((f"<header>{r.choice((f'<h1>{self.words(1, 4)}</h1>', line()))}{r.choice(('', self.links(2, 5)))}</header>", f"<div{self.attribute('header', 'masthead', 'topbar', 'site-header')}>{line()}{r.choice(('', self.links(2, 5)))}</div>"))
        if kind == 2:
            body = r.choice((self.links(3, 9), f"<h3>{self.words(1, 4)}</h3>{self.links(2, 6)}", f"<h3>{self.words(1, 4)}</h3>{line()}"))
            return r.choice((f"<aside>{body}</aside>", f"<div{self.attribute('sidebar', 'widget', 'related', 'recommended', 'popular')}>{body}</div>"))
        if kind == 3:
            return f"<{(t := r.choice(('div', 'section', 'p')))}{self.attribute('notice', 'cookie', 'cookie-notice', 'alert', 'consent', 'popup', 'paywall')}>{line() if t != 'p' else self.sentences(1, 2)}</{t}>"
        if kind == 4:
            return f"<{(t := r.choice(('div', 'section', 'aside', 'p')))}{self.attribute('ad', 'ads', 'advert', 'sponsored', 'promo', 'advertisement')}>{line() if t != 'p' else self.sentences(1, 2)}</{t}>"
        if kind == 5:
            form = f"<form{r.choice(('', self.attribute('search', 'newsletter', 'subscribe', 'login')))}><label>{self.words(1, 5)}</label><input name=q>{r.choice(('', line()))}<button>{self.words(1, 2)}</button></form>"
            return r.choice((form, f"<div{self.attribute('newsletter', 'subscribe', 'signup', 'contact')}>{line()}{form}</div>"))
        if kind == 6:
            each = lambda: f"<{(t := r.choice(('div', 'li', 'article')))}{self.attribute('comment', 'reply')}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 6)}</p></{t}>"
            return f"<{(t := r.choice(('div', 'section', 'ol')))}{self.attribute('comments', 'commentlist', 'discussion', 'reader-comments')}>{r.choice(('', f'<h3>{self.words(1, 3)}</h3>'))}{''.join(each() for _ in range(r.randint(1, 6)))}</{t}>"
        return f"<div{self.attribute('share', 'social', 'tools', 'meta')}>{self.links(2, 5)}</div>"

    def body(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>@{self.words(1, 12)}</h1>")
        for _ in range(r.choice((0, 1, 1, 1, 2, 3, 5, 10, 25))):
            x = r.random()
            if x < 0.72:
                text = r.choice((self.sentences(1, 1), self.sentences(1, 8), self.words(1, 2) + ".", self.words(1, 30)))
                if r.random() < 0.15:
                    text += f' <a href="/x">@{self.words(1, 5)}</a> {self.words(1, 4)}.'
                out.append(r.choice((f"<p>@{text}</p>", f"<p>@{text}", f"<p><b>@{text}<br>", f"<p>@<b>{text}</b></p>")))
            elif x < 0.8:
                out.append(f"<h{(h := r.randint(2, 4))}>@{self.words(1, 7)}</h{h}>")
            elif x < 0.87:
                out.append("<ul>" + "".join(f"<li>@{self.words(1, 15)}</li>" for _ in range(r.randint(1, 7))) + "</ul>")
            elif x < 0.91:
                out.append(f"<blockquote><p>@{self.sentences(1, 4)}</p></blockquote>")
            elif x < 0.94:
                out.append("<table>" + "".join(f"<tr><td>@{self.words(1, 3)}</td><td>@{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.96:
                out.append(f"<figure><img src=x><figcaption>@{self.words(2, 10)}</figcaption></figure>")
            else:
                out.append(self.noise(inside=True))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        self.known = r.random() >= 0.2
        body = self.body()
        if r.random() < 0.3:
            body += self.noise(inside=True)
        main = r.choice((
            lambda: f"<article>{body}</article>", lambda: f"<article>{body}</article>", lambda: f"<main>{body}</main>", lambda: f"<main><article>{body}</article></main>",
            lambda: f"<div{self.attribute('content', 'post', 'entry', 'story', 'article')}>{body}</div>", lambda: f'<div id="main"><div{self.attribute("content", "text", "entry-content")}>{body}</div>{self.noise()}</div>',
            lambda: f"<section>{body}</section>", lambda: f"<div>{body}</div>",
        ))()
        top, bottom = ("".join(self.noise() for _ in range(r.randint(0, 3))) for _ in range(2))
        if r.random() < 0.7:
            top = r.choice((f"<nav>{self.links(2, 9)}</nav>", f"<header>{self.words(1, 4)}{self.links(2, 6)}</header>")) + top
        if r.random() < 0.8:
            foot = r.choice((f"&copy; {self.words(1, 12)}", f"<p>{self.words(2, 12)}</p>{self.links(1, 4)}"))
            bottom += r.choice((f"<footer>{foot}</footer>", f"<div{self.attribute('footer', 'copyright', 'site-footer')}>{foot}</div>"))
        whole = top + main + bottom
        if r.random() < 0.3:
            whole = f"<div{r.choice(('', ' class=wrapper', ' id=page'))}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>{whole}</body></html>"

    def lesson(self, pages: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of all blocks: whether main text is in or under them."""
        parsed = [parse(self.page()) for _ in range(pages)]
        labels = []
        for p in parsed:
            mine = np.zeros(len(p.kind), bool)
            for node, pieces in p.runs:
                if any("@" in x for x in pieces):
                    while node >= 0 and not mine[node]:
                        mine[node] = True
                        node = p.parent[node]
            labels.append(mine)
        return features(parsed)[0], np.concatenate(labels).astype(np.float64)
