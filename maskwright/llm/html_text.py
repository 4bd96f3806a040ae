"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements; inline elements count for the block they stand in. Boosted trees give each
node the odds of being main content, from its tag and attribute words, its ancestors', its subtree's text and link
density, its depth and its siblings. The decoding picks the likeliest consistent states: a node passes (not main itself,
may hold main nodes), is main (children are main or dropped), or is dropped, and with it all that is in it. So nothing
is kept inside a dropped node, and nothing is main by itself inside what is main but through it.

The trees are trained on pages that this module writes itself, from varied layouts with known main parts; PAGES bounds
them and SEED fixes them. Nothing of the corpus is learned.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table
from .words import parts

PAGES, TREES, DEPTH, BINS, RATE, SEED, SWITCH = 1000, 60, 5, 32, 0.25, 3, 0.4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed".split())
UNSEEN = frozenset("script style title head template svg math iframe object textarea select option datalist noscript xmp noembed canvas audio video".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav aside header footer form fieldset table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address details summary hgroup center menu dialog search legend button label head noscript template svg select option object".split()
)
#: an open element of the first kind ends where one of the second begins
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
IN_P = BLOCKS - {"button", "label", "option", "noscript", "template", "svg", "select", "object", "legend"}

TAGS = {t: i for i, group in enumerate(("article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "aside", "header hgroup", "footer", "form fieldset button label search legend dialog", "table thead tbody tfoot tr", "td th", "blockquote pre figure figcaption", "body html")) for t in group.split()}
WORDS = [
    re.compile(p)
    for p in (
        r"article|story|entry|post(?!er)|content|main|body|text|prose",
        r"nav|menu|breadcrumb|crumb|pager|pagination|toc",
        r"side|aside|rail|widget|related|recommend|trending|popular",
        r"head|masthead|topbar|logo|brand",
        r"foot|copyright|legal|bottom",
        r"(?:^|\W|_)ads?(?:\W|_|\d|$)|advert|banner|promo|sponsor|dfp|affiliate",
        r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|toast|paywall",
        r"comment|repl(?:y|ies)|disqus|discussion|respond|review",
        r"form|login|signup|subscribe|newsletter|search|register",
        r"share|social|follow|tweet|like|tag|meta|byline",
        r"hidden|display:\s*none|sr-only|print",
    )
]
_NAME_END = re.compile(r"[\s/>]")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:class|id|role|style|aria-label|itemprop|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)


class Markup:
    """Tags, comments and declarations of a source, found in time linear in its length, whatever stands open in it.

    A tag ends at the first '>' outside quotes; where there is none, its '<' is text. What was learned about where marks
    lie is kept: the next mark after a place, and for each mark looked at from outside quotes the end it leads to.
    """

    def __init__(self, source: str):
        self.source, self.last, self.ends = source, source.rfind(">"), {}
        self.near = {_NAME_END: (0, -1), _MARK: (0, -1)}

    def _next(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern's next match begins, or the length; places must not go back."""
        a, b = self.near[pattern]
        if not a <= at <= b:
            m = pattern.search(self.source, at)
            b = m.start() if m else len(self.source)
            self.near[pattern] = (at, b)
        return b

    def _end(self, at: int) -> int:
        """Where the '>' that ends a tag stands, seen from `at` outside quotes; -1 if none does."""
        source, ends, seen = self.source, self.ends, []
        k = self._next(_MARK, at)
        while True:
            if k >= len(source):
                end = -1
            elif source[k] == ">":
                end = k
            elif k in ends:
                end = ends[k]
            else:
                seen.append(k)
                closing = source.find(source[k], k + 1)
                if closing >= 0:
                    m = _MARK.search(source, closing + 1)
                    k = m.start() if m else len(source)
                    continue
                end = -1
            for q in seen:
                ends[q] = end
            return end

    def after(self, at: int):
        """(start, end, closing, name, attributes) of the next markup from `at`; name None for comments and declarations; None if there is none."""
        source = self.source
        while (lt := source.find("<", at)) >= 0:
            at = lt + 1
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                return lt, len(source) if end < 0 else end + 3, False, None, ""
            if lt > self.last:
                continue
            c = source[lt + 1 : lt + 2]
            if c in ("!", "?") and c:
                return lt, source.find(">", lt) + 1, False, None, ""
            first = lt + 1 + (c == "/")
            letter = source[first : first + 1]
            if letter.isascii() and letter.isalpha():
                name_end = self._next(_NAME_END, first)
                end = self._end(name_end) if name_end < len(source) else -1
                if end >= 0:
                    return lt, end + 1, c == "/", source[first:name_end], source[name_end:end]
        return None


#: where a script or the like ends, by its place in the source as it is: lower-casing may change a text's length
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}


class Page:
    """Block elements in page order (a parent before its children), and runs of text with the element each stands in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs, self.links, self.unseen = ["html"], [-1], [""], [0], [False]
        self.raw_attrs: list[str] = [""]
        self.runs: list[tuple[int, str]] = []
        stack, at, buffer, linked = [0], 0, [], False
        markup, opened, has_body = Markup(source), Counter(), False

        def end_run():
            nonlocal buffer
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                if text and not self.unseen[stack[-1]]:
                    self.runs.append((stack[-1], text))
                buffer = []

        n = len(source)
        while at < n:
            m = markup.after(at)
            end = m[0] if m else n
            if end > at:
                piece = source[at:end]
                buffer.append(piece)
                if linked:
                    self.links[stack[-1]] += len(piece)
            if not m:
                break
            _, at, closing, tag, attrs = m
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag == "a":
                    linked = False
                elif tag in BLOCKS and opened[tag]:
                    end_run()
                    linked = False
                    while True:
                        gone = self.tags[stack.pop()]
                        opened[gone] -= 1
                        if gone == tag:
                            break
                continue
            if tag in RAW:
                found = _RAW_ENDS[tag].search(source, at)
                at = found.start() if found else n
                continue
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                end_run()
            elif tag == "a":
                linked = True
            elif tag in BLOCKS and tag not in VOID:
                end_run()
                linked = False
                if tag in IN_P and self.tags[stack[-1]] == "p":
                    stack.pop()
                    opened["p"] -= 1
                elif tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
                    for k in range(len(stack) - 1, 0, -1):
                        t = self.tags[stack[k]]
                        if t in CLOSES[tag]:
                            opened.subtract(self.tags[i] for i in stack[k:])
                            del stack[k:]
                            break
                        if t in SCOPES.get(tag, ()):
                            break
                if tag in ("html",) or tag == "body" and has_body:
                    continue
                has_body = has_body or tag == "body"
                if attrs.endswith("/") and tag == "svg":
                    continue
                words = " ".join(x for g in _ATTR.findall(attrs) for x in g if x).lower() if attrs else ""
                self.tags.append(tag)
                self.parents.append(stack[-1])
                self.attrs.append(words)
                self.raw_attrs.append(attrs)
                self.links.append(0)
                self.unseen.append(self.unseen[stack[-1]] or tag in UNSEEN)
                stack.append(len(self.tags) - 1)
                opened[tag] += 1
            elif tag == "img":
                buffer.append("")
        end_run()


N_FEATURES = len(set(TAGS.values())) + 2 * len(WORDS) + 22
_WORD_CACHE: dict[str, tuple] = {}


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parent = page.parents
    own, runs, marks = [0] * n, [0] * n, [0] * n
    for i, t in page.runs:
        own[i] += len(t)
        runs[i] += 1
        marks[i] += t.count(".") + t.count(",")
    total, links, nodes, paras, sub_runs, sub_marks = list(own), list(page.links), [1] * n, [0] * n, list(runs), list(marks)
    kids: list[list[int]] = [[] for _ in range(n)]
    depth = [0] * n
    for i in range(1, n):
        kids[parent[i]].append(i)
        depth[i] = depth[parent[i]] + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        nodes[p] += nodes[i]
        sub_runs[p] += sub_runs[i]
        sub_marks[p] += sub_marks[i]
        paras[p] += page.tags[i] == "p"
    all_text = max(1, total[0])
    place, fam = [0] * n, [1] * n
    for k in kids:
        for j, i in enumerate(k):
            place[i], fam[i] = j, len(k)
    n_tags, n_words = len(set(TAGS.values())), len(WORDS)
    x = np.zeros((n, N_FEATURES), np.float32)
    flags: list[tuple] = []
    up: list[tuple] = []
    log = [float(v) for v in np.log1p(np.array([own, total], float)).ravel()]
    article = [False] * n
    most = [max((total[s] for s in k), default=0) for k in kids]
    before = 0
    for i in range(n):
        p, t = parent[i], page.tags[i]
        a = page.attrs[i]
        f = _WORD_CACHE.get(a)
        if f is None:
            if len(_WORD_CACHE) > 50_000:
                _WORD_CACHE.clear()
            f = _WORD_CACHE[a] = tuple(float(bool(w.search(a))) for w in WORDS) if a else (0.0,) * n_words
        flags.append(f)
        k = TAGS.get(t)
        mine = tuple(max(u, v) for u, v in zip(up[p], flags[p])) if i and any(flags[p]) else up[p] if i else (0.0,) * n_words
        up.append(mine)
        bad = bool(i) and (article[p] or page.tags[p] in ("nav", "aside", "header", "footer", "form", "button"))
        article[i] = bad
        row = [0.0] * n_tags
        if k is not None:
            row[k] = 1.0
        row += f
        row += mine
        sib = kids[p] if i else [0]
        j = place[i]
        prev, nxt = (sib[j - 1] if j else None), (sib[j + 1] if j + 1 < len(sib) else None)
        share = total[i] / all_text
        row += [
            log[i], log[n + i], min(1.0, links[i] / max(1, total[i])), total[i] / nodes[i], total[i] / max(1, sub_runs[i]), sub_marks[i] / max(1, total[i]) * 100,
            depth[i], j, fam[i], share, before / all_text, log[n + prev] if prev is not None else -1, log[n + nxt] if nxt is not None else -1, paras[i],
            float(bad), total[i] / max(1, total[p]) if i else 1.0, len(kids[i]), log[n + p] if i else 0.0, min(1.0, links[p] / max(1, total[p])) if i else 0.0, paras[p] if i else 0,
            1 - share - before / all_text, (most[p] if i else total[0]) / all_text,
        ]
        x[i] = row
        before += own[i]
    return x


class Boosted:
    """Complete trees of fixed depth over binned features, for the logistic loss."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float):
        self.trees, self.base = trees, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Boosted:
        n, nf = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(nf)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        p = float((weight * y).sum() / weight.sum())
        base, out = float(np.log(p / (1 - p))), []
        z = np.full(n, base)
        cols = np.arange(nf) * bins
        for _ in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = weight * (y - q), weight * q * (1 - q)
            feat, thr, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
            for level in range(depth):
                first, k = 2**level - 1, 2**level
                at = ((node - first)[:, None] * nf * bins + cols + binned).ravel()
                sg = np.bincount(at, np.repeat(g, nf), k * nf * bins).reshape(k, nf, bins).cumsum(2)
                sh = np.bincount(at, np.repeat(h, nf), k * nf * bins).reshape(k, nf, bins).cumsum(2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 2) | (th - sh < 2)] = 0
                best = gain.reshape(k, -1).argmax(1)
                for j in range(k):
                    f, b = divmod(int(best[j]), bins)
                    if gain[j, f, b] > 1e-6 and b < len(edges[f]):
                        feat[first + j], thr[first + j] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            z = z + value[leaf]
            out.append((feat, thr.astype(np.float32), value))
        return cls(out, base)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feat, thr, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (x[rows, feat[node]] > thr[node])
                if not len(node) or node[0] >= len(feat):
                    break
            z += value[node - len(feat)] if len(node) else 0
        return z


def decoded(page: Page, odds: np.ndarray, switch: float = SWITCH) -> list[bool]:
    """Which nodes are main: the likeliest states in which nothing is kept inside a dropped node."""
    n = len(page.tags)
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    weight = np.ones(n)
    for i, t in page.runs:
        weight[i] += min(3.0, len(t) / 80)
    yes, no = (yes * weight).tolist(), (no * weight).tolist()
    pas, main, drop = list(no), list(yes), list(no)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        pas[p] += max(pas[i], main[i] - switch, drop[i])
        main[p] += max(main[i], drop[i] - switch)
        drop[p] += drop[i]
    state = [""] * n
    for i in range(n):
        up = state[page.parents[i]] if i else "pass"
        if up == "drop":
            state[i] = "drop"
        elif up == "main":
            state[i] = "main" if main[i] >= drop[i] - switch else "drop"
        else:
            best = max(pas[i], main[i] - switch, drop[i])
            state[i] = "main" if main[i] - switch >= best else "pass" if pas[i] >= best else "drop"
    return [s == "main" for s in state]


def _words(r: random.Random, n: int) -> str:
    parts = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(max(1, n))]
    text = " ".join(w + r.choice([","] + [""] * 9 + ["."] * 1) for w in parts)
    return text[:1].upper() + text[1:] + r.choice([".", ".", "", "!"])


def made_page(r: random.Random) -> str:
    """A page whose main part is marked by data-main="1", and what is not main inside it by data-main="0"."""
    rename, plain = r.random() < 0.3, False  # class names that say nothing; plain: names must tell, as nothing else does

    def cls(*names):
        if not plain and r.random() < 0.15:
            return ""
        name = r.choice(names) if plain or not rename or r.random() < 0.2 else "c" + "".join(r.choice("abcdefxyz0123456789") for _ in range(5))
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(k):
        items = [f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a>' for _ in range(k)]
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def junk(kind):
        t = lambda a, b: _words(r, r.randint(a, b))
        p = lambda a, b: f"<p>{t(a, b)}</p>" if r.random() < 0.5 else t(a, b)
        if kind == "nav":
            return f'<{(g := r.choice(["nav", "nav", "div", "ul"]))}{cls("nav", "menu", "main-menu", "navbar", "breadcrumbs", "toc")}>{links(r.randint(3, 12))}</{g}>'
        if kind == "ad":
            return f'<{(g := r.choice(["div", "div", "aside", "section"] + ["p"] * plain))}{cls("ad", "ads", "advert", "ad-slot", "sponsored", "banner", "promo-box")}>{t(3, 30) if g == "p" else p(3, 30)}</{g}>'
        if kind == "notice":
            return f'<div{cls("cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "paywall")}>{p(5, 40)}<button>{t(1, 2)}</button></div>'
        if kind == "form":
            return f'<form{cls("search", "newsletter", "subscribe", "login-form", "contact")}><label>{t(1, 5)}</label><input name="q">{p(2, 15)}<button>{t(1, 2)}</button></form>'
        if kind == "side":
            inner = "".join(f"<h3>{t(1, 4)}</h3>" + (links(r.randint(2, 8)) if r.random() < 0.6 else f"<p>{t(5, 60)}</p>") for _ in range(r.randint(1, 4)))
            return f'<{(g := r.choice(["aside", "aside", "div", "section"]))}{cls("sidebar", "side", "widget", "related", "right-rail", "recommended")}>{inner}</{g}>'
        if kind == "comments":
            one = lambda: f'<{(g := r.choice(["div", "li", "article"]))}{cls("comment", "comment-body", "reply")}><b>{t(1, 2)}</b><p>{t(4, 70)}</p></{g}>'
            return f'<{(g := r.choice(["section", "div", "ol"]))}{cls("comments", "comment-list", "discussion", "disqus", "responses", "reader-comments")}><h3>{t(1, 3)}</h3>{"".join(one() for _ in range(r.randint(1, 7)))}</{g}>'
        if kind == "share":
            return f'<div{cls("share", "social", "share-buttons", "tags")}>{links(r.randint(2, 5))}</div>'
        if kind == "header":
            return f'<{(g := r.choice(["header", "header", "div"]))}{cls("header", "masthead", "site-header", "topbar")}>{r.choice(["", f"<h1>{t(1, 3)}</h1>", f"<div>{t(1, 4)}</div>"])}{junk("nav") if r.random() < 0.6 else p(1, 12)}</{g}>'
        return f'<{(g := r.choice(["footer", "footer", "div"]))}{cls("footer", "site-footer", "bottom", "copyright", "legal")}>{links(r.randint(1, 6)) if r.random() < 0.5 else ""}{p(3, 40)}</{g}>'

    def body():
        nonlocal plain
        out = [f"<h1>{_words(r, r.randint(2, 12))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            text = _words(r, r.choice([1, 3, 8, 20, 50, 90, 150]))
            if kind < 0.7:
                inline = f"<b>{text}" if r.random() < 0.1 else text.replace(" ", ' <a href="#">', 1) + "</a>" if r.random() < 0.15 and " " in text else text
                out.append(f"<p>{inline}" + r.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                out.append(f"<h{(k := r.randint(2, 4))}>{_words(r, r.randint(1, 7))}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{_words(r, r.randint(1, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<pre>{text}</pre>" if r.random() < 0.5 else f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div>{text}</div>")
            if r.random() < 0.12:
                plain = True
                one = junk(r.choice(["ad", "ad", "side", "share", "form", "notice", "nav"]))
                plain = False
                out.append(re.sub(r"^<(\w+)", r'<\1 data-main="0"', one))
        if r.random() < 0.15:
            plain = True
            out.append(re.sub(r"^<(\w+)", r'<\1 data-main="0"', junk(r.choice(["comments", "comments", "share"]))))
            plain = False
        return "".join(out)

    holder = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    main = f'<{holder}{cls("article", "content", "post", "entry-content", "story", "main", "article-body") if r.random() < 0.7 else ""} data-main="1">{body()}</{holder}>'
    if holder == "td":
        main = f'<table><tr><td>{links(4)}</td>{main}</tr></table>'
    elif r.random() < 0.4:
        main = f'<{(g := r.choice(["div", "main", "section"]))}{cls("wrap", "container", "page", "layout", "main")}>{junk("side") if r.random() < 0.3 else ""}{main}{junk(r.choice(["side", "ad", "comments"])) if r.random() < 0.5 else ""}</{g}>'
    top = [junk(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.45]
    tail = [junk(k) for k in ("share", "comments", "side", "ad", "form", "notice") if r.random() < 0.3] + ([junk("footer")] if r.random() < 0.85 else [])
    r.shuffle(top)
    return f"<html><head><title>{_words(r, 4)}</title></head><body>{''.join(top)}{main}{''.join(tail)}</body></html>"


def node_labels(page: Page) -> np.ndarray:
    y = np.zeros(len(page.tags))
    for i in range(1, len(y)):
        a = page.raw_attrs[i]
        y[i] = 1.0 if 'data-main="1"' in a else 0.0 if 'data-main="0"' in a else y[page.parents[i]]
    return y


_MODELS: dict = {}


def model(pages: int = PAGES, seed: int = SEED) -> Boosted:
    if (pages, seed) not in _MODELS:
        r = random.Random(seed)
        made = [Page(made_page(r)) for _ in range(pages)]
        x, y = np.concatenate([features(p) for p in made]), np.concatenate([node_labels(p) for p in made])
        w = np.concatenate([1 + np.log1p(np.bincount([i for i, _ in p.runs], [len(t) for _, t in p.runs], len(p.tags))) for p in made])
        _MODELS[pages, seed] = Boosted.fit(x, y, w / w.mean())
    return _MODELS[pages, seed]


def main_texts(sources: list[str | None], boosted: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    odds = boosted.log_odds(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        keep = decoded(p, odds[at : at + len(p.tags)])
        at += len(p.tags)
        out.append("\n".join(t for i, t in p.runs if keep[i]))
    return out


def extracted(pages: DataFrame, boosted: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; null and empty html, and pages without main text, give an empty text.

    Repeated rows give a row each, and null ids stay. The work on a page is linear in its length.
    """
    boosted = boosted or model()
    bounded(pages.sparkSession)

    def run(it):
        for b in it:
            for some in parts(b, 2, 1_000_000):
                texts = main_texts(some.column(2).to_pylist(), boosted)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_boosted_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
