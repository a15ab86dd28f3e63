"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (text between block-level tags). Each block
becomes a vector of its hashed tag path, its hashed words, a few shares and what
its containers' names say of it; a bidirectional LSTM in numpy reads the page's
blocks in order, both ways, and labels each one as article or not.

A container's name counts for what it holds. Names of ``html`` and ``body``, of
page shells (a form around the whole page, a layout that holds most of the text
and in it an article) and negated names (``no-sidebar``, ``has-comments``) say
nothing and are left out of the path; a ``header`` inside an article is part of it.

The network is trained here, on the driver, from at most ``TRAIN_PAGES`` pages
(the first by a hash of their html, of each at most ``TRAIN_CHARS`` characters,
``TRAIN_BLOCKS`` blocks and, in variants, ``TRAIN_ARTICLE`` article blocks): their
own markup says which blocks are surely article or surely not. Variants of them,
with the same texts under other containers, named and unnamed, in other shells and
with other surroundings, teach it pages that mark up less. These bounds are on
training alone; every page is read whole.

Defined results: a null or empty html gives the empty text; a page without
article blocks likewise; equal pages get equal texts; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS, TRAIN_ARTICLE = 192, 100_000, 400, 40
HIDDEN = 16
EPOCHS = 16
PATH_DIMS, WORD_DIMS = 96, 16
#: Pages that a task labels at a time.
PAGES = 256
SEED = 7

# Kinds of elements.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. All else (formulas, drawings, fallbacks) is read as inline text.
RAW = frozenset("script style textarea".split())
#: Of these, one without its end tag takes the rest of the page, as in a browser; of the others only the tag goes.
UNSEEN = frozenset({"script", "style"})
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "select"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
#: An open element of these keeps an inner one from closing what lies outside it.
SCOPES = frozenset("table ul ol dl body html article section div td th select form aside nav main".split())

# Containers that name what they hold, as elements and as words of a class or id.
ARTICLE_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"nav", "header", "footer", "aside", "form", "head", "title", "menu", "select", "dialog", "button", "label"})
ARTICLE_WORDS = ["article", "content", "post", "entry", "story", "body", "main", "text"]
OTHER_WORDS = ["ad", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "side", "comment", "reply", "discussion",
               "cookie", "notice", "consent", "gdpr", "menu", "nav", "navbar", "breadcrumb", "footer", "header", "masthead", "share",
               "social", "related", "recommend", "newsletter", "subscribe", "signup", "login", "search", "widget", "popup", "modal",
               "disclaimer", "copyright", "pagination", "toolbar", "alert", "feedback", "topbar", "bottom"]
#: Of these, an article element may be one too.
READER_WORDS = frozenset("comment reply discussion related recommend ad advert advertisement sponsor promo".split())
#: First words of a name that tells of something elsewhere.
NEGATIONS = frozenset("has no not with without is hide show enable disable js can".split())
#: Element that wraps whole pages by habit.
WRAPPER = "form"


def _name(word: str) -> str:
    """A word of a class, id or role as a token of a path, in the singular."""
    return "." + (word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word)


_OTHER_NAMES = frozenset(map(_name, OTHER_WORDS))
#: Slots of their own: however many classes share the hashed ones, these are seen.
MARKS = {t: k for k, t in enumerate(sorted(ARTICLE_TAGS | OTHER_TAGS | _OTHER_NAMES | set(map(_name, ARTICLE_WORDS))))}
DIMS = PATH_DIMS + WORD_DIMS + len(MARKS) + 7

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0              # characters of the text inside links
    mark: float | None = None    # what its containers' names say: 1 article, 0 not, None nothing


@dataclass(eq=False)
class _Open:
    tag: str
    names: tuple[tuple[str, ...], ...] = ()   # words of each class, id or role
    parent: _Open | None = None
    chars: int = 0       # of text inside
    inner: int = 0       # of text inside the largest article container in it, itself included
    says: float | None = None
    shell: bool = False

    def words(self) -> tuple[str, ...]:
        return () if self.shell else tuple(_name(w) for name in self.names if name[0] not in NEGATIONS for w in name)


def _names(attributes: str) -> tuple[tuple[str, ...], ...]:
    if "=" not in attributes:
        return ()
    return tuple(tuple(words) for groups in _NAMES.findall(attributes) for name in "".join(groups).split()
                 if (words := _WORD.findall(_CAMEL.sub(r"\1-\2", name).lower())))


def _says(e: _Open) -> float | None:
    """What an element's tag and names say of its content."""
    named = [n for n in e.names if n[0] not in NEGATIONS]
    other = [n for n in named if any(_name(w) in _OTHER_NAMES for w in n)]
    article = [n for n in named if n not in other and any(w in ARTICLE_WORDS for w in n)]
    if e.tag in ("html", "body"):
        return None
    if e.tag in ARTICLE_TAGS:
        return 0.0 if any(w.rstrip("s") in READER_WORDS for n in other for w in n) else 1.0
    if e.tag in OTHER_TAGS or other and not article:
        return 0.0
    return 1.0 if article and not other else None


def _settle(found: list[tuple[str, _Open, int]]) -> list[Block]:
    """Blocks of (text, innermost element, linked): what elements say is decided by how much of the page they hold."""
    total = sum(len(t) for t, _, _ in found)
    lines: dict[_Open, list[_Open]] = {}     # elements from the outermost in
    for text, e, _ in found:
        if e not in lines:
            line, up = [], e
            while up is not None:
                line.append(up)
                up = up.parent
            lines[e] = line[::-1]
        for x in lines[e]:
            x.chars += len(text)
    seen = {x for line in lines.values() for x in line}
    for x in seen:
        x.says = _says(x)
    for x in seen:
        if x.says == 1.0 or any(w in ARTICLE_WORDS for n in x.names if n[0] not in NEGATIONS for w in n) and x.tag not in ("html", "body"):
            up = x
            while up is not None:
                up.inner = max(up.inner, x.chars)
                up = up.parent
    for x in seen:
        if x.tag in ("html", "body") or x.says == 0.0 and 2 * x.chars >= total and (x.tag == WRAPPER or 2 * x.inner >= x.chars):
            x.shell = True
    out = []
    for text, e, linked in found:
        mark: float | None = None
        for x in lines[e]:
            if x.says is None or x.shell and x.says == 0.0:
                continue
            if x.says == 0.0 and not (mark == 1.0 and x.tag == "header"):
                mark = 0.0
            elif x.says == 1.0 and mark is None:
                mark = 1.0
        out.append(Block(text, tuple(t for x in lines[e] for t in (x.tag, *x.words())), linked, mark))
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[tuple[str, _Open, int]] = []
    root = _Open("html")
    stack: list[_Open] = []
    pieces: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, stack[-1] if stack else root, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            linked += len(raw) * (in_link > 0)

    def close(tags: set[str]) -> None:
        """Close the innermost open element of these, unless a scope lies in between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in SCOPES:
                return

    at = 0
    unclosed: set[str] = set()   # elements without an end tag further on
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        attributes = m[3] or m[6] or ""
        # The title and the labels of a drawing stand apart from each other, but cut no paragraph.
        label = tag in ("text", "title", "desc") and any(o.tag == "svg" for o in stack)
        if label:
            pieces.append(" ")
        if m[1] or m[4]:
            if (tag in BLOCKS or tag in ("p", "br")) and not label:
                flush()
            if tag == "a":
                in_link = max(in_link - 1, 0)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW or tag == "xmp":
            if not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                if end:
                    if tag == "xmp":   # its marks are text
                        pieces.append(page[at:end.start()])
                        linked += (end.start() - at) * (in_link > 0)
                    at = end.end()
                elif tag in UNSEEN:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag in BLOCKS and not label:
            flush()
            if tag in CLOSES_P:
                close({"p"})
            if tag in SELF_CLOSING:
                close(SELF_CLOSING[tag])
            in_link = 0
        if tag == "a":
            in_link += 1
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            stack.append(_Open(tag, _names(attributes), stack[-1] if stack else None))
    flush()
    return _settle(out)


def _slots(token: str) -> tuple[int, ...]:
    h = zlib.crc32(token.encode())
    own = (PATH_DIMS + WORD_DIMS + MARKS[token],) if token in MARKS else ()
    return h % PATH_DIMS, (h >> 16) % PATH_DIMS, *own


_SLOTS: dict[str, tuple[int, ...]] = {}


def vectors(page: list[Block]) -> np.ndarray:
    """(blocks, DIMS) of a page."""
    x = np.zeros((len(page), DIMS), np.float32)
    for k, b in enumerate(page):
        for token in b.path:
            if token not in _SLOTS:
                if len(_SLOTS) > 50_000:
                    _SLOTS.clear()
                _SLOTS[token] = _slots(token)
            for s in _SLOTS[token]:
                x[k, s] = 1
        if b.path:
            x[k, _SLOTS[b.path[-1]][0]] = 2
        words = b.text.encode("utf-8", "surrogatepass").split()
        x[k, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.bincount(
            [zlib.crc32(w) % WORD_DIMS for w in words], minlength=WORD_DIMS) / max(len(words), 1)
        x[k, -7:] = (b.mark == 1.0, b.mark == 0.0, np.log1p(len(words)) / 5, b.linked / len(b.text), b.text[-1] in ".!?\"':;", k / len(page), 1)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of small matrices without a BLAS call, whose threads cost more than they save here."""
    return np.einsum("ij,jk->ik", a, b)


class BiLstm:
    """One layer each way and a logistic output; float32 numpy."""

    def __init__(self, dims: int = DIMS, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.wx = [rng.normal(0, dims ** -0.5, (dims, 4 * hidden)).astype(np.float32) for _ in range(2)]
        self.wh = [rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden)).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32) for _ in range(2)]
        self.wo = rng.normal(0, hidden ** -0.5, 2 * hidden).astype(np.float32)
        self.bo = np.zeros(1, np.float32)

    def _way(self, x: np.ndarray, mask: np.ndarray, way: int, keep: list | None) -> np.ndarray:
        steps, batch, _ = x.shape
        n = self.hidden
        zx = x.reshape(-1, x.shape[2]) @ self.wx[way] + self.b[way]
        zx = zx.reshape(steps, batch, 4 * n)
        h = np.zeros((batch, n), np.float32)
        c = np.zeros((batch, n), np.float32)
        out = np.zeros((steps, batch, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            z = zx[t] + _times(h, self.wh[way])
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * n], -30, 30)))
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            g = np.tanh(z[:, 3 * n:])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c = m * c_new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, batch) probabilities; ``keep`` gets what the gradient needs."""
        kept: list[list] = [[], []]
        both = [self._way(x, mask, w, kept[w] if keep is not None else None) for w in (0, 1)]
        hidden = np.concatenate(both, axis=2)
        if keep is not None:
            keep.extend((hidden, kept))
        return 1 / (1 + np.exp(-np.clip(hidden @ self.wo + self.bo, -30, 30)))

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over blocks with a known label, and its gradient in the order of ``parameters``."""
        keep: list = []
        p = self.scores(x, mask, keep)
        hidden, kept = keep
        n = max(float(known.sum()), 1.0)
        loss = -float((known * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / n
        d = (known * (p - y) / n).astype(np.float32)
        d_hidden = d[:, :, None] * self.wo
        grads = [np.einsum("tb,tbh->h", d, hidden), np.array([d.sum()], np.float32)]
        size = self.hidden
        for way in (0, 1):
            dwh = np.zeros_like(self.wh[way])
            dz_all = np.zeros((*x.shape[:2], 4 * size), np.float32)
            dh = np.zeros((x.shape[1], size), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tc, m in reversed(kept[way]):
                dh = dh + d_hidden[t, :, way * size:(way + 1) * size]
                dn = m * dh
                dcn = m * dc + dn * o * (1 - tc * tc)
                dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dn * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
                dwh += _times(h.T, dz)
                dz_all[t] = dz
                dh = (1 - m) * dh + _times(dz, self.wh[way].T)
                dc = (1 - m) * dc + dcn * f
            flat = dz_all.reshape(-1, 4 * size)
            grads += [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)]
        return loss, grads

    def parameters(self) -> list[np.ndarray]:
        return [self.wo, self.bo, *(p for w in (0, 1) for p in (self.wx[w], self.wh[w], self.b[w]))]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), DIMS), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[:len(p), k] = p
        mask[:len(p), k] = 1
    return x, mask


def labels(pages: list[list[Block]], model: BiLstm) -> list[list[bool]]:
    """Whether each block is article; pages of like length are read together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        # A batch holds a bounded number of blocks, padding included; one page may exceed it alone.
        longest = len(pages[order[-1]])
        take = max(1, min(len(order), 8192 // longest))
        batch, order = order[-take:], order[:-take]
        x, mask = _padded([vectors(pages[k]) for k in batch])
        p = model.scores(x, mask)
        for j, k in enumerate(batch):
            out[k] = (p[:len(pages[k]), j] > 0.5).tolist()
    return out


# ---- training ----

def _variant(rng: np.random.Generator, article: list[Block], spare: list[str]) -> tuple[list[Block], list[float]]:
    """The texts of an article in another shell and under other containers, with other surroundings made of spare texts.

    In some variants no container has a name: then only lists of links and short lines surround the article."""
    out: list[tuple[Block, float]] = []
    unnamed = rng.random() < 0.35

    def words(least: int, most: int) -> str:
        source = spare[rng.integers(len(spare))].split()
        n = int(rng.integers(least, most + 1))
        at = int(rng.integers(max(len(source) - n, 0) + 1))
        return " ".join(source[at:at + n]) or "-"

    def around(outer: tuple[str, ...]) -> None:
        style = rng.integers(3)
        name = "." + OTHER_WORDS[rng.integers(len(OTHER_WORDS))]
        tag = ("nav", "header", "footer", "aside", "form")[rng.integers(5)]
        wrap = (tag,) if style == 0 else (("div", "section", "ul", "p", "td")[rng.integers(5)], name) if style == 1 else (tag, name)
        if unnamed:
            wrap = (("div", "section", "ul", "td")[rng.integers(4)],)
        leaf = (("ul", "li", "a"), ("p",), ("div",), ("label",), ("h3",), ())[rng.integers(2 if unnamed else 6)]
        links = leaf[-1:] == ("a",)
        for _ in range(int(rng.integers(1, 7))):
            t = words(1, 4) if links or unnamed else words(1, 40)
            t = t.rstrip(".!?") or "-" if unnamed else t
            out.append((Block(t, (*outer, *wrap, *leaf), len(t) if links else 0, None if unnamed else 0.0), 0.0))

    base = ("html", "body", *((), (), ("form",), ("div",), ("div", "div"), ("table", "tr"), ("form", "div"), ("div", ".page", "div", ".wrap"))[rng.integers(8)])
    holder = [("article",), ("main",), ("main", "article"), ("div", "." + ARTICLE_WORDS[rng.integers(len(ARTICLE_WORDS))]),
              ("section", "." + ARTICLE_WORDS[rng.integers(len(ARTICLE_WORDS))]), ("td", ".content"), ("div", ".page", "div", ".text"),
              ("article", "div", "." + ARTICLE_WORDS[rng.integers(len(ARTICLE_WORDS))]),
              ("div", ".main", "div", ".inner", "div", "." + ARTICLE_WORDS[rng.integers(len(ARTICLE_WORDS))])][rng.integers(9)]
    if unnamed:
        holder = [("div",), ("section",), ("div", "div"), ("td",), ()][rng.integers(5)]
    mark = None if unnamed else 1.0
    if rng.random() < 0.7:
        out.append((Block(words(2, 8), ("html", "head", "title"), 0, 0.0), 0.0))
    for _ in range(int(rng.integers(0, 4))):
        around(base)
    inside = [("section",), ("header",), ("div", ".row")][rng.integers(3)] if rng.random() < 0.3 else ()
    for k, b in enumerate(article):
        leaf = b.path[-1] if b.path and b.path[-1] in ("h1", "h2", "h3", "p", "b", "li", "blockquote") else "p"
        wrap = ("ul",) if leaf == "li" else ("p",) if leaf == "b" else ()
        extra = inside if inside != ("header",) or (k == 0 and not unnamed) else ()
        out.append((Block(b.text, (*base, *holder, *extra, *wrap, leaf), b.linked, mark), 1.0))
        if rng.random() < 0.04 and not unnamed:
            around((*base, *holder))
    if rng.random() < 0.3 and not unnamed:
        around((*base, *holder))
    for _ in range(int(rng.integers(0, 4))):
        around(base)
    return [b for b, _ in out], [v for _, v in out]


def train(pages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    """Fit a labeller on these pages and variants of them."""
    rng = np.random.default_rng(seed)
    model = BiLstm()
    cut = [p for p in map(blocks, pages) if p]
    if not cut:
        return model
    spare = [b.text for p in cut for b in p]
    samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for page in cut:
        page = page[:TRAIN_BLOCKS]
        marks = [b.mark for b in page]
        samples.append((vectors(page), np.array([m or 0.0 for m in marks], np.float32),
                        np.array([m is not None for m in marks], np.float32)))
        article = [b for b in page if b.mark == 1.0][:TRAIN_ARTICLE]
        for _ in range(3 if article else 0):
            made, y = _variant(rng, article, spare)
            samples.append((vectors(made), np.array(y, np.float32), np.ones(len(y), np.float32)))
    samples.sort(key=lambda s: len(s[0]))
    batches = [samples[k:k + 24] for k in range(0, len(samples), 24)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(batches)):
            x, mask = _padded([s[0] for s in batches[k]])
            y, known = np.zeros_like(mask), np.zeros_like(mask)
            for j, s in enumerate(batches[k]):
                y[:len(s[1]), j], known[:len(s[2]), j] = s[1], s[2]
            _, grads = model.gradient(x, mask, y, known)
            step += 1
            for p, g, (m, v) in zip(model.parameters(), grads, state):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def training_pages(pages: DataFrame, html_col: str = "html", most: int = TRAIN_PAGES) -> list[str]:
    """At most ``most`` distinct pages, the first by a hash; only they come to the driver, and hashes go first."""
    text = F.col(f"`{html_col}`")
    hashes = pages.select(F.xxhash64(text).alias("h")).filter(text.isNotNull()).distinct().orderBy("h").limit(most)
    hs = [r["h"] for r in hashes.collect()]
    found = pages.select(text.alias("html"), F.xxhash64(text).alias("h")).filter(F.col("h").isin(hs)).filter(
        F.col("html").isNotNull()).dropDuplicates(["h"]).select("h", F.substring("html", 1, TRAIN_CHARS).alias("html")).collect()
    return [r["html"] for r in sorted(found, key=lambda r: r["h"])]


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """``keep`` columns with the main ``text``, n_blocks and n_article of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(training_pages(pages, html_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, PAGES):
                rows = whole_batch.slice(lo, PAGES)
                cut = [blocks(h.as_py() or "") for h in rows.column(len(keep))]
                marks = labels(cut, shared.value)
                texts = ["\n\n".join([b.text for b, m in zip(p, mark) if m]) for p, mark in zip(cut, marks)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, cut), pa.int64()),
                     pa.array(map(sum, marks), pa.int64())], names=[*keep, "text", "n_blocks", "n_article"])

    chosen = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep])
    return chosen.mapInArrow(run, f"{schema}, text string, n_blocks long, n_article long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, ["page_id", "url"]).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_article")


QUERIES = {"op10_html": op10_html}
