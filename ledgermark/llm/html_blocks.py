"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. A bidirectional LSTM (numpy) reads each block's tag path and words,
both hashed, and labels every block in the context of all others. It is trained on pages of a generator
that knows which of its blocks are the article; nothing is learned from the pages that are labelled.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import bound_batches

PATH_DIMS, WORD_DIMS, SCALARS, HIDDEN = 160, 48, 6, 24
DIMS = PATH_DIMS + WORD_DIMS + SCALARS
#: Share of telling elements of generated pages whose names say nothing.
NOISE = 0.1
#: Pages that are generated for training, epochs over them, pages of a step.
TRAIN_PAGES, EPOCHS, STEP = 2400, 8, 16
#: Fixed values of HTML: elements without content, elements whose content is no text, elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg math iframe object canvas textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An element that opens closes these open ones, if nothing of the second set stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARAGRAPH = frozenset({"p"})
SCOPES = frozenset("ul ol dl table html body div article section main aside nav header footer form".split())
#: An attribute as browsers read it: a quoted value ends at its quote, any other at white space or >; quotes elsewhere are
#: part of names. (A quote that never closes opens no value, so that it costs its tag and not the rest of the page.)
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"(?:[^\s/>=]|=)[^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(rf"((?:[^\s/>=]|=)[^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
#: Levels of nesting that names are noted of; an element below them has the path of the last such level.
DEPTH = 512
#: Blocks of a page that the network reads at a time; states are carried from stretch to stretch.
STRETCH = 4096
_WORD = re.compile(r"\w+")


class Block:
    """A leaf: its text, the names on its path (tags, and words of class, id and role), its own tag, and its share of link text."""

    __slots__ = ("text", "path", "tag", "linked")

    def __init__(self, text: str, path: tuple[str, ...], tag: str, linked: float):
        self.text, self.path, self.tag, self.linked = text, path, tag, linked


@functools.lru_cache(4096)
def _names(attributes: str) -> tuple[str, ...]:
    out, seen = [], set()
    for key, value in _ATTR.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role") and key not in seen:  # of an attribute given twice the first counts
            seen.add(key)
            out += [f"{key[0]}:{w.lower()}" for w in _NAME.findall(html.unescape(value.strip("\"'")))]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order. Character references are decoded, white space is one space, comments and what
    is no text are left out; elements that are never closed end with what holds them. Blocks share their paths."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements: tag, and the names on the path down to it
    open_: Counter[str] = Counter()  # how many of each tag are open
    known: dict[tuple[str, ...], tuple[str, ...]] = {}
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            own = next((tag for tag, _ in reversed(stack) if tag not in INLINE), "")
            out.append(Block(text, stack[-1][1] if stack else (), own, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())

    def end(i: int) -> None:
        """End the open elements from number ``i`` on."""
        for tag, _ in stack[i:]:
            open_[tag] -= 1
        del stack[i:]

    def close(tags: frozenset[str] | set[str]) -> None:
        """End the innermost open element of these, with all in it, unless a list, table or part of the page stands between."""
        if not any(open_[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                end(i)
                return
            if stack[i][0] in SCOPES:
                return

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # within what was skipped
            continue
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    end(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            if tag not in ("svg", "math") or not m[3].endswith("/"):
                closing = re.compile(rf"</{tag}(?![^\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            close(_PARAGRAPH)  # a block ends an open paragraph
            close(CLOSES.get(tag, frozenset()))
            while stack and stack[-1][0] in INLINE and stack[-1][0] != "a":
                end(len(stack) - 1)
        if tag not in VOID:
            above = stack[-1][1] if stack else ()
            path = (*above, tag, *_names(m[3])) if len(stack) < DEPTH else above
            stack.append((tag, known.setdefault(path, path)))
            open_[tag] += 1
    if at < n:
        add(page[at:])
    flush()
    return out


def _slot(name: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % dims, 1.0 if h >> 31 else -1.0


#: Words met so far, with twice their dimension plus the sign (and a multiple that keeps it from being 0); emptied when large.
_WORDS: dict[str, int] = {}


def _word(w: str) -> int:
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    j, s = _slot(w, WORD_DIMS)
    _WORDS[w] = 2 * (j + WORD_DIMS) + (s < 0)
    return _WORDS[w]


@functools.lru_cache(50_000)
def _path_vector(path: tuple[str, ...], tag: str) -> np.ndarray:
    x = np.zeros(PATH_DIMS, np.float32)
    for name in (*set(path), f"own:{tag}"):
        j, s = _slot(name, PATH_DIMS)
        x[j] += s
    return x


def vectors(blocks: list[Block], first: int = 0, of: int = 0) -> np.ndarray:
    """A row for each block: hashed tag path and own tag, hashed words (a bag, of unit length), and scalars. The blocks
    stand in their page from number ``first``; the page has ``of`` (0: just these)."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    of = of or len(blocks)
    codes: list[int] = []
    counts = []
    for i, b in enumerate(blocks):
        x[i, :PATH_DIMS] = _path_vector(b.path, b.tag)
        n = len(b.text)
        words = _WORD.findall(b.text.lower())
        codes += [_WORDS.get(w) or _word(w) for w in words]
        counts.append(len(words))
        x[i, PATH_DIMS + WORD_DIMS :] = (math.log1p(n) / 6, math.log1p(b.text.count(" ") + 1) / 4, b.linked, (b.text.count(".") + b.text.count(",")) / n * 10, (first + i) / of, b.text[-1] in ".!?")
    code = np.array(codes, np.int64)
    bag = np.bincount(np.repeat(np.arange(len(blocks)), counts) * WORD_DIMS + code // 2 % WORD_DIMS, 1.0 - 2 * (code % 2), len(blocks) * WORD_DIMS).reshape(len(blocks), -1)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag / np.maximum(np.sqrt((bag * bag).sum(1, keepdims=True)), 1e-9)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = r.normal(0, 0.15, (DIMS, 4 * HIDDEN))
            self.p[f"wh{d}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"b{d}"] = b
        self.p["wo"], self.p["bo"] = r.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple]:
        """States of one direction (time, batch, HIDDEN), what the way back needs if it is to be kept, and the last state."""
        steps, batch, _ = x.shape
        z = x.reshape(-1, DIMS) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        z = z.reshape(steps, batch, -1)
        h, c = state or (np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN)))
        hs, kept = np.zeros((steps, batch, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"wh{d}"]
            i, f, o = (self._sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                kept.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, c2, c), np.where(m, o * th, h)
            hs[t] = h
        return hs, kept, (h, c)

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch) of blocks padded to (time, batch, DIMS)."""
        both = np.concatenate([self._run(x, mask, d, keep=False)[0] for d in "fb"], 2)
        return self._sigmoid(both @ self.p["wo"] + self.p["bo"])

    def predict_page(self, blocks: list[Block], stretch: int = STRETCH) -> np.ndarray:
        """Probabilities of one page's blocks, a stretch at a time: forwards from the first, backwards from the last.
        Memory holds one stretch's vectors and a number for each block, however long the page is."""
        n = len(blocks)
        z = np.full(n, float(self.p["bo"][0]))
        for d, w in zip("fb", np.split(self.p["wo"], 2), strict=True):
            state = None
            for a in range(0, n, stretch)[:: 1 if d == "f" else -1]:
                x = vectors(blocks[a : a + stretch], a, n)[:, None]
                hs, _, state = self._run(x, np.ones(x.shape[:2], bool), d, state, keep=False)
                z[a : a + stretch] += hs[:, 0] @ w
        return self._sigmoid(z)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        p = self._sigmoid(both @ self.p["wo"] + self.p["bo"])
        n = mask.sum()
        dz = np.where(mask, p - y, 0) / n
        g = {"wo": np.einsum("tb,tbh->h", dz, both), "bo": np.array([dz.sum()])}
        loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / n
        dboth = dz[:, :, None] * self.p["wo"]
        for j, d in enumerate("fb"):
            dhs = dboth[:, :, j * HIDDEN : (j + 1) * HIDDEN]
            w = self.p[f"wh{d}"]
            da = np.zeros((*mask.shape, 4 * HIDDEN))
            dw = np.zeros_like(w)
            dh, dc = np.zeros(dhs.shape[1:]), np.zeros(dhs.shape[1:])
            for t, i, f, o, c_in, c, th, h, m in reversed(runs[d][1]):
                dh = dh + dhs[t]
                dh_in, dc_in = np.where(m, dh, 0), np.where(m, dc, 0)
                dct = dc_in + dh_in * o * (1 - th * th)
                a = np.concatenate([dct * c_in * i * (1 - i), dct * c * f * (1 - f), dh_in * th * o * (1 - o), dct * i * (1 - c_in * c_in)], 1)
                da[t] = a
                dw += h.T @ a
                dh, dc = np.where(m, a @ w.T, dh), np.where(m, dct * f, dc)
            g[f"wh{d}"] = dw
            g[f"wx{d}"] = x.reshape(-1, DIMS).T @ da.reshape(-1, 4 * HIDDEN)
            g[f"b{d}"] = da.sum((0, 1))
        return float(loss), g


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), DIMS), np.float32), np.zeros((steps, len(rows)), bool)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, True
    return x, mask


#: Words that sites use in names of their parts.
ARTICLE_NAMES = "article content post entry story body text main page post-content entry-content article-body story-body main-content single blog-post prose markdown hentry post-body article-text news-text rich-text page-content reader beitrag artikel contenu".split()
PARTS = {
    "menu": "nav menu navbar navigation main-menu top-nav topbar site-nav breadcrumb breadcrumbs tabs links toolbar skip pagination pager toc primary-menu nav-primary main-navigation crumbs sitemap mega-menu hamburger".split(),
    "header": "header masthead site-header top banner-top branding logo page-header hero site-title tagline site-description page-header topline".split(),
    "footer": "footer site-footer bottom copyright legal colophon foot credits imprint site-info subfooter footnav".split(),
    "sidebar": "sidebar aside widget rail right-rail left-col secondary related recommended popular trending most-read tags archive categories more widget-area recent-entries related-stories teaser".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert banner popup modal overlay message toast warning disclaimer paywall cookiebar cookie-consent privacy-notice dialog".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adbox ad-slot banner-ad commercial partner adunit ad-slot--mpu skyscraper leaderboard billboard".split(),
    "form": "form search newsletter subscribe signup login contact-form search-box register newsletter-box signup-form".split(),
    "comments": "comments comment comment-list replies reply discussion responses disqus comment-body thread reader-comments feedback comments-area comments-title comment-reply respond thoughts".split(),
    "share": "share social sharing follow author-box byline-links buttons tools actions print social-share share-bar".split(),
}
TAGS = {"menu": "nav div ul section", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section aside p", "advert": "div aside section ins", "form": "form", "comments": "section div ol", "share": "div ul"}
SAYINGS = {
    "menu": "Home|About|Contact|News|Sports|Next page|Previous|Skip to content|Login|Sign in|Products|Blog|Archive", "header": "Welcome|The daily|Site name|Menu", "sidebar": "Related articles|Most read|You may also like|Popular posts|Tags|Recent",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Copyright|Powered by", "notice": "We use cookies to improve your experience. Accept|This site uses cookies|Please enable JavaScript|Your trial ends soon", "advert": "Advertisement|Sponsored|Buy now|Sale ends today",
    "form": "Subscribe to our newsletter|Your email|Send|Search|Sign up|Password", "comments": "Reply|3 comments|Leave a comment|says:|Posted by|I agree with this|Great article, thanks", "share": "Share on|Tweet|Follow us|Print|Email this",
}


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and whether each of its leaf blocks is article text. Blocks carry marks ``qz<number>qz`` that tell which is which."""
    syllables = ["".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouäéó") for _ in range(1)) for _ in range(40)]
    truth: list[bool] = []

    def words(n: int) -> str:
        out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(len(out)):
            if r.random() < 0.12:
                out[i] += r.choice([".", ",", ".", "!", "&amp;", "%%%", " &middot;", " –"])
        return " ".join(out).capitalize()

    def mark(good: bool) -> str:
        truth.append(good)
        return f"qz{len(truth) - 1}qz "

    def attributes(names: list[str], telling: bool = True) -> str:
        """Names of a part; an element that tells what it is (not ``telling``) may have none, or one that says nothing."""
        k = r.random()
        if k < 0.2:
            return ""
        name = r.choice(names) if telling or k > 0.2 + NOISE else f"{r.choice(['css', 'sc', 'x', 'jsx'])}-{r.randrange(1 << 24):06x}"
        if k < 0.3:
            name += f" {r.choice(['clearfix', 'row', 'col-8', 'wrap', 'inner', 'x12', 'box', 'container'])}"
        return f' {r.choice(["class", "class", "id"])}="{name}"' + (f' data-x="{r.randint(1, 9)}"' if r.random() < 0.1 else "")

    def inline(text: str) -> str:
        k = r.random()
        if k < 0.15:
            return f"<b>{text}</b>"
        if k < 0.25:
            a, _, b = text.partition(" ")
            return f"{a} <a href='/x'>{b[:12]}</a>{b[12:]}"
        if k < 0.3:
            return f"<b>{text}<br>"
        return text

    def paragraph(good: bool, n: int) -> str:
        tag = r.choice(["p", "p", "p", "p", "div", "blockquote", "li"]) if good else r.choice(["p", "div", "span", "li", "p"])
        text = mark(good) + inline(words(n))
        if tag == "li":
            return f"<ul><li>{text}</li></ul>"
        return f"<{tag}>{text}" + (f"</{tag}>" if tag == "div" or tag == "blockquote" or r.random() < 0.8 else "") + ("<br>" if r.random() < 0.05 else "")

    def part(kind: str) -> str:
        tag = r.choice(TAGS[kind].split())
        speaks = tag in ("nav", "header", "footer", "aside", "form")
        head = f"<{tag}{attributes(PARTS[kind], not speaks) if tag in ('div', 'p', 'ins') or r.random() < 0.6 else ''}>"
        if tag in ("div", "section", "p", "ins", "ul", "ol") and "=" not in head:  # a plain element must be told by its name
            head = f'<{tag} class="{r.choice(PARTS[kind])}">'
        say = lambda: r.choice(SAYINGS[kind].split("|")) if r.random() < 0.5 else words(r.randint(1, 6))
        if kind in ("menu", "share") or kind in ("sidebar", "footer") and r.random() < 0.4:
            items = "".join(f"<li><a href='/{i}'>{mark(False)}{say()}</a></li>" for i in range(r.randint(2, 7)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{mark(False)}{say()}</label><div><input name='q'>{mark(False)}{say()}</div><p>{mark(False)}{words(r.randint(3, 25))}</p>"
        elif kind in ("comments", "sidebar"):
            inner = f"<h3>{mark(False)}{say()}</h3>" if r.random() < 0.7 and tag != "ol" else ""
            wrap = "li" if tag == "ol" else "div"
            for _ in range(r.randint(1, 5)):
                inner += f"<{wrap}{attributes(PARTS[kind])}>" + "".join(paragraph(False, r.randint(2, 60)).replace("<ul>", "").replace("</ul>", "").replace("<li>", "<p>").replace("</li>", "</p>") for _ in range(r.randint(1, 2))) + f"</{wrap}>"
        elif tag == "p":
            inner = mark(False) + words(r.randint(3, 30))
        else:
            inner = mark(False) + (say() if r.random() < 0.5 else words(r.randint(2, 40)))
            if r.random() < 0.4:
                inner = f"<{(wrap := r.choice(['p', 'div', 'p', 'span']))}>{inner}</{wrap}>"
        return f"{head}{inner}</{tag}>"

    def body() -> str:
        out = [f"<{h}>{mark(True)}{words(r.randint(2, 12))}</{h}>" for h in r.choices(["h1", "h2", "h1"], k=1) if r.random() < 0.85]
        for i in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            if r.random() < 0.1:
                out.append(f"<h{r.choice('23')}>{mark(True)}{words(r.randint(1, 6))}</h2>")
            out.append(paragraph(True, r.choice([1, 3, 8, 20, 40, 80, 150])))
            if r.random() < 0.08:
                out.append(f"<table><tr><td>{mark(True)}{words(2)}</td><td>{mark(True)}{words(3)}</td></tr></table>")
            if i and r.random() < 0.12:
                out.append(part(r.choice(["advert", "share", "sidebar", "notice", "form"])))
        if r.random() < 0.15:
            out.append(part(r.choice(["share", "sidebar", "comments"])))
        return "".join(out)

    top = [part(k) for k in r.sample(["menu", "header", "notice", "advert", "menu", "form"], r.randint(1, 4))]
    name = r.choice(["article", "article", "main", "div", "section"])
    attrs = attributes(ARTICLE_NAMES, False) if name in ("article", "main") else f' {r.choice(["class", "id"])}="{r.choice(ARTICLE_NAMES)}"'
    article = f"<{name}{attrs}>{body()}</{name}>"
    if r.random() < 0.3:
        article = f"<{r.choice(['main', 'div'])}{attributes(ARTICLE_NAMES + ['wrapper', 'container', 'layout'])}>{article}" + "".join(part(k) for k in ("comments", "sidebar", "share") if r.random() < 0.3) + "</div></main>"
    low = [part(k) for k in r.sample(["sidebar", "footer", "comments", "advert", "share", "footer", "form", "notice"], r.randint(1, 4))]
    if r.random() < 0.5:
        top = [f"<header>{''.join(top)}</header>"] if r.random() < 0.3 else top
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{x:y}}</style></head><body>{''.join(top)}<!-- c -->{article}{''.join(low)}</body></html>"
    return (page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page), truth


@functools.lru_cache(2)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 12) -> Labeller:
    """Labeller trained on generated pages by Adam; the same for the same arguments. Takes some seconds, once a process."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, truth = training_page(r)
        blocks, labels = [], []
        for b in leaf_blocks(page):
            marks = re.findall(r"qz(\d+)qz", b.text)
            if marks:
                labels.append(truth[int(marks[0])])
                b.text = re.sub(r"qz\d+qz ?", "", b.text) or "x"
                blocks.append(b)
        if blocks:
            data.append((vectors(blocks), np.array(labels, float)))
    data.sort(key=lambda d: len(d[1]))
    net = Labeller()
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps = 0
    for epoch in range(epochs):
        batches = [data[i : i + STEP] for i in range(0, len(data), STEP)]
        r.shuffle(batches)
        for batch in batches:
            x, mask = padded([d[0] for d in batch])
            y = np.zeros(mask.shape)
            for j, (_, own) in enumerate(batch):
                y[: len(own), j] = own
            _, g = net.gradients(x, mask, y)
            steps += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= 0.02 * 0.65**epoch * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return net


def main_texts(net: Labeller, pages: list[str]) -> list[tuple[str, int, int]]:
    """Of each page: text of the blocks labelled as article, joined by spaces; how many they are, and of how many."""
    blocks = [leaf_blocks(p) for p in pages]
    out = [("", 0, 0)] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))

    def give(i: int, p: np.ndarray) -> None:
        good = [b.text for b, q in zip(blocks[i], p, strict=True) if q >= 0.5]
        out[i] = (" ".join(good), len(good), len(blocks[i]))

    at = 0
    while at < len(order):
        if len(blocks[order[at]]) > STRETCH:
            give(order[at], net.predict_page(blocks[order[at]]))
            at += 1
            continue
        end = at + 1
        while end < len(order) and end - at < 256 and (end - at + 1) * len(blocks[order[end]]) <= 2 * STRETCH:
            end += 1
        x, mask = padded([vectors(blocks[i]) for i in order[at:end]])
        p = net.predict(x, mask)
        for j, i in enumerate(order[at:end]):
            give(i, p[: len(blocks[i]), j])
        at = end
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_kept and n_blocks of every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without text, has an empty text and 0 characters; cut-off pages are read as far as
    they go; repeated rows get the same answer each; an empty table gives no rows. Other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    net = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in tx.blocks(batch, "html"):
                found = main_texts(net.value, texts)
                text, kept, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(kept, pa.int64()), pa.array(n, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"],
                )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_kept long, n_blocks long")
