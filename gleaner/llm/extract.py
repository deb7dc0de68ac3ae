"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with its
path of open tags (names, classes, ids and roles). A bidirectional LSTM in numpy
reads the blocks of a page in order, each as a vector of hashed path parts, hashed
words and a few figures, and labels every block as main text or not, with both
directions' view of the page. Nothing but the labeller decides (scripts, styles,
markup and what a page's head holds are no blocks). It is trained here, on pages
made by `synthetic`: articles with menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments, under telling names, names that say
nothing and no names at all, in nests of containers of any depth, with headers,
footers and junk inside articles too, tidy and sloppy.

Main blocks are joined by one line end in page order; white space inside a block is
one space; character references are decoded once. Null and empty pages, and pages
without main text, give an empty text. Broken or unclosed markup is read to its end;
very long pages are read whole, in batches of their own. Ties and repeated rows get
equal results; other columns pass through `extract`, clashing ones (text, n_chars)
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..oracle_sql import HTML_BLOCKS
from .common import batches, texts

# ---- blocks ------------------------------------------------------------------

#: Comments, declarations and tags. A quote in a tag begins a quoted value only after =.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br acronym button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that closes an open one of the same group first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("head title".split())
#: Elements whose content is no text of the page. Scripts and styles reach to the end
#: of the page if they aren't closed; other ones without an end are empty.
RAW = frozenset("script style noscript template textarea select iframe svg math".split())
ENDLESS = frozenset("script style".split())
SELF_CLOSED = frozenset("svg math".split())
#: Tags that may stand in a head; any other one closes it.
HEAD_ONLY = HEAD | frozenset("html base basefont bgsound link meta noframes".split())


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters inside links) of every leaf block with text but titles."""
    page = page or ""
    out: list = []
    stack: list[tuple[str, tuple]] = []  # open block-level tags and their path parts
    text: list[str] = []
    linked, link = 0, 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t and not any(name == "title" for name, _ in stack):
                out.append((t, tuple(x for name, parts in stack if name != "head" for x in parts), linked))
            text.clear()
        linked = 0

    endless: set[str] = set()  # raw elements that no end tag follows
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1] and tag in RAW:
            if tag in SELF_CLOSED and (m[3] or "").endswith("/"):
                continue
            end = None if tag in endless else re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif tag in ENDLESS:
                at = len(page)
            else:
                endless.add(tag)
            continue
        if not m[1] and tag not in HEAD_ONLY:
            head = next((k for k, (name, _) in enumerate(stack) if name in HEAD), None)
            if head is not None:
                flush()
                del stack[head:]
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = 0 if m[1] else 1
            continue
        flush()
        link = 0
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or (tag in HEADINGS and stack[k][0] in HEADINGS):
                    del stack[k:]
                    break
            continue
        if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
            stack.pop()
        if tag in BLOCKS_CLOSE_P and stack and stack[-1][0] == "p":
            stack.pop()
        group = CLOSES.get(tag)
        if group and stack and stack[-1][0] in group:
            stack.pop()
        if tag not in VOID and not (m[3] or "").endswith("/"):
            parts = [f"<{tag}"]
            for a in ATTR.finditer(m[3] or ""):
                parts += (w.lower() for w in PART.findall(a[2] or a[3] or a[4] or ""))
            stack.append((tag, tuple(parts)))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


# ---- features ----------------------------------------------------------------

PATH_DIM, WORD_DIM, FIGURES = 256, 64, 17
DIM = PATH_DIM + WORD_DIM + FIGURES


@lru_cache(maxsize=1 << 16)
def _path_slots(path: tuple[str, ...]) -> tuple[tuple[int, float], ...]:
    out = []
    for x, n in Counter(path).items():  # every part of the path; repeats count by their logarithm
        h = zlib.crc32(x.encode())
        weight = 1.0 + 0.3 * float(np.log(n))
        out.append((h % PATH_DIM, weight if h & (1 << 20) else -weight))
    return tuple(out)


@lru_cache(maxsize=1 << 17)
def _word_slot(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return PATH_DIM + h % WORD_DIM, 1.0 if h & (1 << 20) else -1.0


def _shared(a: tuple, b: tuple) -> int:
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


TEXTUAL = frozenset("<p <li <blockquote <pre <td <dd <dt <figcaption".split())


def vectors(page: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    before: tuple = ()
    for k, (text, path, linked) in enumerate(page):
        row = out[k]
        for at, sign in _path_slots(path):
            row[at] += sign
        words = text.lower().split()
        weight = 0.7 / len(words) ** 0.5
        for w in set(words):
            at, sign = _word_slot(w)
            row[at] += sign * weight
        n, own = len(text), next((x for x in reversed(path) if x[0] == "<"), "")
        last, shared = text[-1], _shared(path, before)  # how far the block before is left
        row[-FIGURES:] = (
            np.log1p(len(words)) / 5, min(1.0, linked / n), min(1.0, 4 * text.count(".") / len(words)), min(1.0, 4 * text.count(",") / len(words)), min(len(path), 20) / 15,
            (k + 1) / len(page), np.log1p(k) / 4, np.log1p(len(page) - k - 1) / 4, own in TEXTUAL, own[:2] == "<h" and own[2:].isdigit(),
            last in ".!?:;\"'”»", n / len(words) / 10, path == before,
            min(shared, 20) / 15, min(len(before) - shared, 20) / 10, shared / max(1, len(before)), 1.0,
        )
        before = path
    return out


# ---- recurrent labeller --------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over padded batches (time, page, feature)."""

    def __init__(self, rng, dim: int, hidden: int):
        self.h = hidden
        self.w = (rng.standard_normal((dim + hidden, 4 * hidden)) / np.sqrt(dim / 4 + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t, n, d = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        pre = x.reshape(t * n, d) @ self.w[:d] + self.b
        pre = pre.reshape(t, n, -1)
        out, tape = np.zeros((t, n, self.h), np.float32), []
        for k in range(t):
            z = pre[k] + h @ self.w[d:]
            i, f, o = (_sigmoid(z[:, a * self.h : (a + 1) * self.h]) for a in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            c2 = f * c + i * g
            th = np.tanh(c2)
            h2 = o * th
            m = mask[k][:, None]
            if keep:
                tape.append((h, c, i, f, o, g, th, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[k] = h
        return out, tape

    def back(self, x: np.ndarray, tape, dout: np.ndarray):
        t, n, d = x.shape
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        for k in range(t - 1, -1, -1):
            h, c, i, f, o, g, th, m = tape[k]
            dh = dh + dout[k]
            dhm, dcm = dh * m, dc * m
            do = dhm * th
            dct = dcm + dhm * o * (1 - th * th)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], 1)
            dw[:d] += x[k].T @ dz
            dw[d:] += h.T @ dz
            db += dz.sum(0)
            dh = dz @ self.w[d:].T + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        return dw, db


@dataclass
class Labeller:
    ahead: Lstm
    behind: Lstm
    w: np.ndarray
    b: float

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of each block to be main text; pages of like length share a batch."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest = len(pages[order[min(at + 63, len(order) - 1)]])
            some = order[at : at + max(1, min(64, 200_000 // max(1, longest)))]
            at += len(some)
            x, mask, lengths = pad([pages[k] for k in some])
            if not x.shape[0]:
                for k in some:
                    out[k] = np.zeros(0)
                continue
            y = _sigmoid(self.hidden(x, mask)[0] @ self.w + self.b)
            for col, k in enumerate(some):
                out[k] = y[: lengths[col], col]
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, tape_a = self.ahead.run(x, mask, keep)
        z, tape_z = self.behind.run(x[::-1], mask[::-1], keep)
        return np.concatenate([a, z[::-1]], 2), tape_a, tape_z


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    lengths = [len(p) for p in pages]
    x = np.zeros((max(lengths, default=0), len(pages), DIM), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask, lengths


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 24, epochs: int = 6, batch: int = 24, rate: float = 8e-3, seed: int = 5) -> Labeller:
    """Stochastic gradient descent (Adam) by back-propagation through time."""
    rng = np.random.default_rng(seed)
    m = Labeller(Lstm(rng, DIM, hidden), Lstm(rng, DIM, hidden), (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32), 0.0)
    bias = np.zeros(1, np.float32)
    params = [m.ahead.w, m.ahead.b, m.behind.w, m.behind.b, m.w, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), batch):
            some = [pages[k] for k in order[at : at + batch]]
            x, mask, lengths = pad([p for p, _ in some])
            y = np.zeros(x.shape[:2], np.float32)
            for k, (_, label) in enumerate(some):
                y[: lengths[k], k] = label
            h, ta, tz = m.hidden(x, mask, True)
            d = (_sigmoid(h @ m.w + bias[0]) - y) * mask / mask.sum()
            dh = d[..., None] * m.w
            ga = m.ahead.back(x, ta, dh[..., :hidden])
            gz = m.behind.back(x[::-1], tz, dh[::-1, :, hidden:])
            grads = [*ga, *gz, (h * d[..., None]).sum((0, 1)), np.array([d.sum()])]
            step += 1
            lr = rate * (1 - epoch / epochs * 0.8)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m.b = float(bias[0])
    return m


# ---- made-up training pages ------------------------------------------------------

_SYLLABLES = "an be ch de en er fi ga ha is ko la mi na or pa qu re st th ur vo wi xe yo zu é ö ñ ß tion ment lich ado".split()
#: A character that the writer puts into every piece of main text.
MARK = "\x01"
#: Words that name containers of main text and of what isn't.
MAIN = "article post entry story content text body prose main news blog single markdown reader document essay chapter lesson recipe".split()
NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar pagination pager links tabs sitemap skip".split(),
    "header": "header masthead branding logo top hero site title bar".split(),
    "footer": "footer bottom colophon copyright legal imprint credits site".split(),
    "side": "sidebar aside widget rail related recommended trending popular teaser promo more latest secondary".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay banner message privacy warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot commercial advertorial".split(),
    "form": "form search newsletter subscribe signup login register contact optin mailing".split(),
    "comments": "comments comment discussion replies respond disqus responses feedback thread reactions".split(),
    "share": "share social sharing follow tags tagged toolbar buttons actions meta".split(),
}
NOTHING = "row col wrap wrapper inner outer box grid flex container block unit item left right center clear group holder section layout page cell stack".split()
#: What such parts of pages say.
SAYS = {
    "nav": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Shop|Sports|World|Archive|Next|Previous|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Noticias|FAQ|Help|Careers|Menu|Skip to content",
    "footer": "All rights reserved|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Contact us|Copyright 2021|Alle Rechte vorbehalten|Tous droits réservés",
    "side": "Related articles|Read more|You may also like|Most popular|Recent posts|Trending now|More from us|Auch interessant|À lire aussi|Lo más leído|Categories|Archives|About the author",
    "notice": "We use cookies to improve your experience|This site uses cookies|Accept all|Your browser is out of date|Diese Website verwendet Cookies|Ce site utilise des cookies|Please enable JavaScript|By continuing you agree to our policy",
    "ad": "Advertisement|Sponsored|Ad|Anzeige|Publicité|Publicidad|Buy now and save|Limited offer|Special offer|Shop the sale|Promoted",
    "form": "Subscribe to our newsletter|Enter your email|Sign up|Search|Your name|Password|Send|Abonnieren|S'inscrire|Suscríbete|Get updates in your inbox|Submit|Log in to your account",
    "comments": "Comments|Leave a reply|Reply|3 comments|Log in to comment|Post a comment|Kommentare|Antworten|Commentaires|Répondre|Comentarios|Report|Join the discussion|Like",
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Follow us|Tags:|Filed under|Teilen|Partager|Compartir|Save|Bookmark",
}
SAYS = {kind: text.split("|") for kind, text in SAYS.items()}


class _Writer:
    """One page. Whether a container has a telling name, one that says nothing, or
    none, how deep it lies and how tidy the markup is are drawn for each page."""

    def __init__(self, rng: random.Random):
        self.r = r = rng
        self.telling, self.tags, self.noise = r.choice((0.3, 0.7, 0.95)), r.choice((0.2, 0.7, 1.0)), r.choice((0.0, 0.0, 0.3))
        self.paragraph = "div" if r.random() < 0.1 else "p"
        self.classy, self.deep = r.choice((0.0, 0.2, 0.6, 1.0)), r.choice((0.0, 0.3, 0.8))

    def pick(self, *x):
        return self.r.choice(x)

    # -- text

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 18) -> str:
        words = self.words(a, b).capitalize().split()
        words = [w + "," if self.r.random() < 0.07 else w for w in words]
        return " ".join(words).rstrip(",") + self.pick(".", ".", ".", ".", "!", "?", "")

    def prose(self) -> str:
        """Sentences; on noisy pages also shouted, broken by symbols or repeated, as
        what a block says needn't tell whether it is main text."""
        text, r = " ".join(self.sentence() for _ in range(self.pick(1, 1, 2, 3, 5, 8))), self.r
        if r.random() < self.noise:
            kind, sign = r.randrange(4), "".join(r.choices("!?.,:;#*+-=~|/_%$&@^", k=r.randint(1, 3)))
            text = (text.upper(), " ".join(w + sign for w in text.split()), f" {sign} ".join(text.split()), " ".join([self.word()] * r.randint(3, 40)))[kind].replace("&", "&amp;")
        if r.random() < 0.15:
            words = text.split()
            k = r.randrange(len(words))
            words[k] = self.pick("<b>{}</b>", "<em>{}</em>", "<a href='/x'>{}</a>", "<b>{}", "{}<br>", "<code>{}</code>", "<span class=x>{}</span>").format(words[k])
            text = " ".join(words)
        return text

    def says(self, kind: str) -> str:
        return self.r.choice(SAYS[kind]) if self.r.random() < 0.6 else self.words(1, 3).capitalize()

    # -- containers

    def plain_name(self) -> str:
        r = self.r
        return r.choice(NOTHING) if r.random() < 0.6 else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 7)))

    def attr(self, names: list[str] | None) -> str:
        """A class or an id: one of the names, alone or among others, or nothing that tells."""
        r = self.r
        if names is None or r.random() > self.telling:
            if r.random() < 0.4:
                return ""
            return f' class="{" ".join(self.plain_name() for _ in range(r.randint(1, 3)))}"'
        name = r.choice(names)
        shape = r.random()
        if shape < 0.25:
            name += r.choice("-_") + r.choice((*NOTHING, *names, "list", "1", "area", "title"))
        elif shape < 0.5:
            name = r.choice((*NOTHING, "site", "page", "main", "block", "js", "the", "c")) + r.choice(("-", "_", "__", " ")) + name
        return self.pick(f' class="{name}"', f' class="{name}"', f" class='{name} {self.plain_name()}'", f' id="{name}"', f" class={name.split()[0]}")

    def small(self) -> str:
        """Now and then a class on a paragraph or heading, of any kind."""
        r = self.r
        return f' class="{r.choice((self.plain_name(), "title", "lead", "text", "intro", "head", "entry-title", "first"))}"' if r.random() < self.classy else ""

    def nest(self, html: str) -> str:
        """html in containers whose names say nothing."""
        for _ in range(0 if self.r.random() > self.deep else self.r.choice((1, 1, 2, 3, 5, 8, 12, 16))):
            html = f"<div{self.attr(None)}>{html}</div>"
        return html

    def box(self, kind: str, tags: str, html: str, bare: float = 0.0) -> str:
        """A container of a kind: with its own tag or a div, a telling name or not
        (never neither, but for `bare` of them)."""
        r = self.r
        tag = r.choice(tags.split()) if r.random() < self.tags else "div"
        name = self.attr(NAMES[kind])
        if tag in ("div", "section", "ul") and r.random() >= bare and not any(w in name for w in NAMES[kind]):
            name = f' class="{r.choice(NAMES[kind])}"'
        return f"<{tag}{name}>{self.nest(html)}</{tag}>"

    def links(self, n: int, kind: str = "nav") -> str:
        wrap = self.pick("li", "li", "li", "", "p", "span", "div")
        each = [f'<a href="/{self.word()}">{self.says(kind) if self.r.random() < 0.5 else self.words(1, 8)}</a>' for _ in range(n)]
        out = "".join(f"<{wrap}>{x}</{wrap}>" if wrap else x + self.pick(" ", " | ", " &middot; ") for x in each)
        return f"<ul{self.small()}>{out}</ul>" if wrap == "li" else out

    # -- what isn't main text

    def nav(self) -> str:
        return self.box("nav", "nav nav ul div", self.links(self.r.randint(1, 9)), bare=0.5)

    def header(self) -> str:
        r = self.r
        name = self.pick("<h1{}>{}</h1>", "<p{}>{}</p>", "<div{}>{}</div>", "<h2{}>{}</h2>", "<a href=/{}>{}</a>").format(self.small(), self.words(1, 4))
        return self.box("header", "header", name + self.pick("", f"<p>{self.words(2, 7)}</p>", self.nav(), self.form()))

    def footer(self) -> str:
        r = self.r
        parts = [f"&copy; {r.randint(1999, 2024)} {self.words(1, 3)}", self.says("footer"), self.sentence(), self.links(r.randint(1, 6), "footer"), f"<p>{self.sentence()}</p>", f"<address>{self.words(1, 6)}</address>"]
        return self.box("footer", "footer", self.pick("", "<p>", "<div>") + self.pick(" ", " &middot; ", " | ").join(r.sample(parts, r.randint(1, 3))), bare=0.1)

    def side(self) -> str:
        r = self.r
        title = self.pick("", f"<h3>{self.says('side')}</h3>", f"<h2{self.small()}>{self.says('side')}</h2>", f"<p><b>{self.says('side')}</b></p>")
        items = lambda: f"<h3><a href=/{self.word()}>{self.words(2, 9)}</a></h3><p>{self.sentence()}</p>"
        body = self.pick(self.links(r.randint(1, 6), "side"), f"<p>{self.prose()}</p>", "".join(items() for _ in range(r.randint(1, 4))))
        return self.box("side", "aside aside section", title + body)

    def notice(self) -> str:
        r = self.r
        says = " ".join([self.says("notice"), *(self.sentence() for _ in range(r.randint(0, 3)))])
        return self.box("notice", "div", self.pick("", "<p>") + says + self.pick("", f" <button>{self.says('notice')}</button>", f" <a href=/x>{self.words(1, 2)}</a>"))

    def ad(self) -> str:
        return self.box("ad", "div aside", self.pick("", "", f"<span>{self.says('ad')}</span> ", f"<p>{self.says('ad')}</p>") + self.pick("", "<p>", "<h3>") + self.prose())

    def form(self) -> str:
        field = self.pick(f"<label>{self.says('form')}</label><input name=q>", "<input type=text placeholder=x>", f"<textarea>{self.words(0, 3)}</textarea>", f"<select><option>{self.words(1, 2)}</select>")
        html = self.pick("", f"<p>{self.says('form')}. {self.sentence()}</p>", f"<h3>{self.says('form')}</h3>", f"<h3>{self.says('form')}</h3><p>{self.sentence()}</p>") + field + self.pick("", f"<button>{self.says('form')}</button>", "<input type=submit>")
        return self.box("form", "form div", self.pick(html, f"<form>{html}</form>"))

    def comments(self) -> str:
        r = self.r
        tag, name = self.pick("li", "div", "article", "p", "section"), self.pick("", self.attr(NAMES["comments"]), ' class="comment"')
        def one() -> str:
            who = self.pick("", f"<b>{self.words(1, 2).title()}</b> ", f"<h4>{self.words(1, 2).title()}</h4>", f"<span>{self.words(1, 2)} {r.randint(1, 23)} hours ago</span>")
            return f"<{tag}{name}>{who}{self.pick('', '<p>', '<div>')}{self.prose()}{self.pick('', '', f'<a href=#r>{self.says("comments")}</a>')}</{tag}>"
        title = self.pick("", f"<h3>{self.says('comments')}</h3>", f"<h2>{self.says('comments')}</h2>", f"<p>{self.says('comments')}</p>")
        return self.box("comments", "section div ul", title + "".join(one() for _ in range(r.randint(1, 6))) + self.pick("", "", self.form()))

    def share(self) -> str:
        return self.box("share", "div ul p", self.pick(self.links(self.r.randint(1, 5), "share"), f"{self.says('share')} {self.words(1, 4)}"))

    def script(self) -> str:
        return self.pick(f"<script>var {self.word()}='<p>{self.words(1, 3)}</p>';</script>", f"<style>.{self.word()}{{color:red}}</style>", f"<!-- {self.words(1, 5)} -->", "<svg><path d='M0'/></svg>", f"<noscript>{self.sentence()}</noscript>", "<img src=x alt='a>b'>", "<hr>")

    def junk(self) -> str:
        return self.pick(self.nav, self.nav, self.header, self.footer, self.side, self.side, self.notice, self.ad, self.ad, self.form, self.share, self.script)()

    # -- main text

    def own(self, html: str) -> str:
        """html whose text is main."""
        return MARK + html

    def heading(self, a: int = 2, b: int = 10) -> str:
        return self.own(self.sentence(a, b).rstrip(".") if self.r.random() < 0.7 else self.sentence(a, b))

    def opening(self) -> str:
        """The title of an article, in a header of its own or not."""
        tag = self.pick("h1", "h1", "h1", "h2")
        title = f"<{tag}{self.small()}>{self.heading()}</{tag}>"
        kind = self.r.random()
        if kind < 0.1:
            return ""
        if kind < 0.5:
            return title
        under = self.pick("", f"<p{self.small()}>{self.own(self.sentence())}</p>", f"<p class=byline>{self.own(self.words(2, 4))}</p>", f"<h2>{self.heading()}</h2>")
        if kind < 0.85:
            return f"<header{self.pick('', self.attr(MAIN), ' class="entry-header"', ' class="article-head"', ' class="post-header"')}>{title}{under}</header>"
        return f"<div{self.attr(None)}>{title}{under}</div>"

    def part(self) -> str:
        r, own = self.r, self.own
        kind = r.random()
        if kind < 0.62:
            return f"<{self.paragraph}{self.small()}>{own(self.prose())}</{self.paragraph}>"
        if kind < 0.72:
            tag = self.pick("h2", "h2", "h3", "h4")
            return f"<{tag}{self.small()}>{self.heading(1, 7)}</{tag}>"
        if kind < 0.8:
            tag = self.pick("ul", "ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{own(self.sentence())}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.85:
            return f"<blockquote>{self.pick('', '<p>')}{own(self.prose())}</blockquote>"
        if kind < 0.88:
            return f"<pre>{self.pick('', '<code>')}{own(self.words(2, 14))}</pre>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><{c}>{own(self.words(1, 3))}</{c}><{c}>{own(self.words(1, 4))}</{c}></tr>" for c in self.r.choices(("td", "td", "th"), k=r.randint(1, 4))) + "</table>"
        if kind < 0.95:
            return f"<figure{self.small()}><img src=x.png>{f'<figcaption>{own(self.sentence())}</figcaption>'}</figure>"
        if kind < 0.97:
            return "<dl>" + "".join(f"<dt>{own(self.words(1, 3))}</dt><dd>{own(self.sentence())}</dd>" for _ in range(r.randint(1, 3))) + "</dl>"
        return f"<section{self.attr(None)}><h2>{self.heading(1, 6)}</h2><p>{own(self.prose())}</p></section>" if kind < 0.985 else f"<div{self.small()}>{own(self.prose())}</div>"

    def article(self) -> str:
        r = self.r
        parts = [self.part() for _ in range(self.pick(1, 1, 2, 2, 3, 4, 6, 9, 14))]
        if not any("<p" in x or "<div" in x for x in parts):
            parts.append(f"<p>{self.own(self.prose())}</p>")
        for _ in range(self.pick(0, 0, 1, 1, 2)):  # junk between paragraphs
            parts.insert(r.randint(0, len(parts)), self.pick(self.ad, self.form, self.share, self.side, self.script, self.script)())
        if r.random() < 0.2:
            parts.append(self.pick(self.share, self.side, self.footer)())
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{self.attr(MAIN)}>{self.nest(body)}</div>"
        top = self.opening()
        above = top if r.random() < 0.15 else ""
        if not above:
            body = top + body
        tag = self.pick("article", "article", "main") if r.random() < self.tags else self.pick("div", "div", "section", "td")
        name = self.attr(MAIN)
        html = f"<{tag}{name}>{self.nest(body)}</{tag}>"
        if tag == "td":
            html = f"<table{self.attr(None)}><tr>{self.pick('', f'<td>{self.links(r.randint(2, 6))}</td>')}{html}</tr></table>"
        return self.nest(above + html)

    def page(self) -> str:
        r = self.r
        before = [self.pick(self.nav, self.header)() for _ in range(self.pick(0, 1, 1, 2))] + [self.junk() for _ in range(self.pick(0, 0, 1, 1, 2))]
        r.shuffle(before)
        body = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.25:
            near = self.side()
            body = self.pick(body + near, near + body)
        if r.random() < 0.3:
            body += self.comments()
        after = [self.junk() for _ in range(self.pick(0, 0, 1, 2))] + ([self.footer()] if r.random() < 0.75 else [])
        if r.random() < 0.4:
            tag = self.pick("main", "div", "div", "section")
            body = f"<{tag}{self.pick('', self.attr(None), ' id="content"', ' class="container"', ' id="main"', ' class="site"', ' class="page"')}>{body}</{tag}>"
        html = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            html = self.nest(f"<div{self.attr(None)}>{html}</div>")
        for tag in ("p", "li", "td", "tr"):  # sloppy pages leave out what HTML lets them
            if r.random() < 0.15:
                html = html.replace(f"</{tag}>", "")
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title>{self.pick('', '<meta charset=utf-8>', '<style>p{color:red}</style>')}{self.pick('</head>', '</head>', '')}"
        return self.pick(head, head, "") + f"<body{self.attr(None)}>" + html + self.pick("</body></html>", "")


def synthetic(n: int, seed: int = 3) -> list[tuple[list, np.ndarray]]:
    """Pages cut into blocks, with labels: the writer puts a mark into main text."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page = blocks(_Writer(rng).page())
        kept = [(" ".join(text.replace(MARK, " ").split()), path, linked) for text, path, linked in page]
        labels = [float(MARK in text) for text, _, _ in page]
        some = [k for k, (text, _, _) in enumerate(kept) if text]
        out.append(([kept[k] for k in some], np.array([labels[k] for k in some], np.float32)))
    return out


@lru_cache(maxsize=2)
def model(pages: int = 6000, seed: int = 3) -> Labeller:
    return train([(vectors(p), y) for p, y in synthetic(pages, seed) if p])


# ---- operator --------------------------------------------------------------------


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    scores = labeller.scores([vectors(p) for p in cut])
    return ["\n".join(b[0] for b, s in zip(p, y, strict=True) if s >= 0.5) for p, y in zip(cut, scores, strict=True)]


def extract(df: DataFrame, page: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """df with its html replaced by text and n_chars."""
    df = df.drop("text", "n_chars")
    sent, at = df.sparkSession.sparkContext.broadcast(labeller or model()), df.columns.index(page)
    fields = [f for f in df.schema.fields if f.name != page] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(it):
        for b in it:
            texts = main_texts(b.column(at).to_pylist(), sent.value)
            rest = [k for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark, 512)
    return extract(texts(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars"))


#: What should come out on these pages, whose main text is what the article holds: its
#: heading and paragraphs, read by expressions on the markup.
SQL = f"""
WITH {HTML_BLOCKS},
main AS (SELECT doc_id AS page_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM html_blocks WHERE tag IN ('h1', 'p') GROUP BY doc_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN main USING (page_id)"""

QUERIES = {"op7_extract": op7_extract}
ORACLES = {"op7_extract": SQL}
