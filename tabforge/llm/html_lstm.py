"""Main-text extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level
tags, with the path of open elements (tag names, classes, ids).  A
bidirectional LSTM in numpy reads a vector per block (hashed path names,
hashed words, and some measures of length, links and punctuation) and decides
for each block, with the whole page as context, whether it is article text.

The labeller is trained here, once per process, on pages that a generator
lays out from a seed: articles between menus, headers, sidebars, notices,
adverts, forms, related links, reader comments and footers, in many element
and class names, with invented words.  No row of any table is used.

Scripts, styles, titles, comments and other unseen content are not blocks.
Character references are decoded, white space inside a block becomes one
space, and the article's blocks are joined by one space.

Null or empty html: empty text.  Broken markup is read as far as it goes: an
unclosed element ends with its parent, a stray end tag is ignored.  Very long
pages are sequences like others, and reading one takes time linear in its
length whatever its markup.  Repeated rows get the same text.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH_DIM, WORD_DIM, MEASURES = 96, 32, 8
HIDDEN = 16
STEPS, BATCH, RATE, SEED = 320, 16, 0.02, 7
PAGES_PER_BATCH = 128
BLOCKS_PER_BATCH = 16_384

# HTML element groups.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark
q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
_HIDDEN = frozenset("script style title noscript template svg math iframe textarea select object head".split())
_RAW = frozenset("script style title textarea noscript iframe".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
           "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("""address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr
main menu nav ol p pre section table ul""".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*))")
_PLAIN = re.compile(r"[^'\">]*>")       # rest of a tag without quotes
_MARKS = re.compile(r"['\">]")
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PIECE = re.compile(r"[a-z]+")


class Path:
    """The open elements around a block, as a chain: each element knows the
    one around it, so blocks share what they have in common."""
    __slots__ = ("outer", "tag", "names", "depth", "slots")

    def __init__(self, outer, tag, names):
        self.outer, self.tag, self.names = outer, tag, names
        self.depth = outer.depth + 1 if outer else 1
        self.slots = None       # of the vector, once it is asked for


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


class _TagEnds:
    """Where the tag that is open at a place of a page ends, if it does: at
    the first ``>`` outside quotes.  The answer for each quote or ``>`` follows
    from the ones behind it, so all of them take one pass over the page,
    which is made when the first tag with quotes is met."""

    def __init__(self, page: str):
        self.page, self.last, self.marks = page, page.rfind(">"), None

    def _index(self):
        self.marks = [m.start() for m in _MARKS.finditer(self.page)]
        n = len(self.marks)
        self.ends, ahead = [-1] * (n + 1), {"'": -1, '"': -1}
        for i in range(n - 1, -1, -1):
            c = self.page[self.marks[i]]
            if c == ">":
                self.ends[i] = self.marks[i]
            else:
                close = ahead[c]
                self.ends[i] = self.ends[close + 1] if close >= 0 else -1
                ahead[c] = i

    def end(self, at: int) -> int:
        """Place behind the tag, -1 if it does not end."""
        if at > self.last:
            return -1
        if self.marks is None:
            m = _PLAIN.match(self.page, at)
            if m:
                return m.end()
            self._index()
        return self.ends[bisect_left(self.marks, at)] + 1 or -1


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in page order: the open elements around each
    (tag, names), its text, and the number of its characters inside links.
    The time is linear in the page, also where tags, quotes and elements are
    never closed."""
    out: list[Block] = []
    stack: list[Path] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, hidden, in_link, at = 0, 0, False, 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, linked))
        parts, linked = [], 0

    def close(to: int):
        nonlocal hidden
        while len(stack) > to:
            tag = stack.pop().tag
            opened[tag] -= 1
            hidden -= tag in _HIDDEN

    ends, end, raw_ends = _TagEnds(page), len(page), {}

    def next_tag(at: int):
        """(start, end, match) of the next comment, declaration or tag."""
        while True:
            m = _OPEN.search(page, at)
            if m is None or m.start() > ends.last and not m[1]:
                # only a comment may lack its end
                k = page.find("<!--", at) if m is not None else -1
                return (k, end, None) if k >= 0 else (end, end, None)
            if m[1]:
                k = page.find("-->", m.end())
                return m.start(), k + 3 if k >= 0 else end, None
            if m[2]:
                return m.start(), page.find(">", m.end()) + 1, None
            to = ends.end(m.end())
            if to >= 0:
                return m.start(), to, m
            at = m.start() + 1

    while at < end:
        start, to, m = next_tag(at)
        if not hidden:
            text = page[at:start]
            if text:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text)
        at = to
        if m is None:
            continue
        closing, tag, attrs = m[3], m[4].lower(), page[m.end():to - 1]
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "wbr", "img"):
                parts.append(" " if tag != "wbr" else "")
            continue
        flush()
        in_link = False
        if closing:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _VOID:
            continue
        shut = _CLOSES.get(tag, ())
        if tag in _ENDS_P:
            shut = (*shut, "p")
        while stack and stack[-1].tag in shut:
            close(len(stack) - 1)
        names = tuple(x for v in _NAME.findall(attrs) for x in _PIECE.findall(v.lower())) if "=" in attrs else ()
        if attrs.endswith("/") and tag not in _RAW:
            continue
        if tag == "body":
            close(0)
        stack.append(Path(stack[-1] if stack else None, tag, names))
        opened[tag] = opened.get(tag, 0) + 1
        hidden += tag in _HIDDEN
        if tag in _RAW:
            # the next end tag of this name, remembered while it lies ahead
            if raw_ends.get(tag, -1) < at:
                k = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                raw_ends[tag] = k.start() if k else end
            at = raw_ends[tag]
    flush()
    return out


# --- vectors -------------------------------------------------------------

class _Slots(dict):
    """Name to slot, remembered."""

    def __init__(self, dim, salt):
        super().__init__()
        self.dim, self.salt = dim, salt

    def __missing__(self, name):
        if len(self) > 200_000:
            self.clear()
        v = self[name] = zlib.crc32((self.salt + name).encode("utf-8", "replace")) % self.dim
        return v


class Vectors:
    def __init__(self):
        self.path, self.word = _Slots(PATH_DIM, "path:"), _Slots(WORD_DIM, "word:")

    def _of_path(self, path: Path | None) -> list[int]:
        """Slots of a path: those of the path around it, and its own."""
        todo = []
        while path is not None and path.slots is None:
            todo.append(path)
            path = path.outer
        slots = path.slots if path is not None else frozenset()
        for p in reversed(todo):
            own = {self.path[x] for x in (p.tag, *("." + n for n in p.names))}
            slots = p.slots = slots if own <= slots else slots | own
        return list(slots)

    def __call__(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        out = np.zeros((n, PATH_DIM + WORD_DIM + MEASURES), np.float32)
        words = [b.text.lower().split() for b in blocks]
        count = np.array([len(w) for w in words])
        slots = np.fromiter(map(self.word.__getitem__, chain.from_iterable(words)), np.int64, count.sum())
        place = np.repeat(np.arange(n) * WORD_DIM, count) + slots
        out[:, PATH_DIM:-MEASURES] = np.bincount(place, minlength=n * WORD_DIM).reshape(n, -1) / count[:, None] / 2
        for i, b in enumerate(blocks):
            out[i, self._of_path(b.path)] = 1
        size = np.array([len(b.text) for b in blocks])
        ends = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in blocks])
        out[:, -8] = np.minimum(3.0, np.log1p(count) / 2)
        out[:, -7] = np.minimum(1.0, np.array([b.linked for b in blocks]) / size)
        out[:, -6] = np.minimum(1.0, 4 * ends / count)
        out[:, -5] = np.minimum(1.0, 4 * np.array([b.text.count(",") for b in blocks]) / count)
        out[:, -4] = [b.text[-1] in ".!?" for b in blocks]
        out[:, -3] = np.arange(n) / n
        out[:, -2] = np.array([b.path.depth if b.path else 0 for b in blocks]) / 8
        out[:, -1] = 1.0
        return out


# --- the network ---------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x, mask, p):
    """States of one direction over (time, page, dim), with what the backward
    pass needs."""
    steps, pages, _ = x.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    xw = x @ p["x"] + p["b"]
    hs, tape = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = xw[t] + h @ p["h"]
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        nc = f * c + i * u
        tc = np.tanh(nc)
        tape.append((h, c, i, f, o, u, tc))
        h, c = np.where(m, o * tc, h), np.where(m, nc, c)
        hs[t] = h
    return hs, tape


def _backward(x, mask, p, tape, dhs):
    steps, pages, _ = x.shape
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, u, tc = tape[t]
        m = mask[t][:, None]
        dh = dh + dhs[t]
        dnh, dnc = np.where(m, dh, 0), np.where(m, dc, 0)
        dnc = dnc + dnh * o * (1 - tc * tc)
        dz = np.concatenate([dnc * u * i * (1 - i), dnc * c0 * f * (1 - f), dnh * tc * o * (1 - o),
                             dnc * i * (1 - u * u)], axis=1)
        dz_all[t] = dz
        grad["h"] += h0.T @ dz
        dh = np.where(m, 0, dh) + dz @ p["h"].T
        dc = np.where(m, 0, dc) + dnc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad["x"] = x.reshape(-1, x.shape[2]).T @ flat
    grad["b"] = flat.sum(0)
    return grad


def logits(x, mask, net):
    """Scores of (time, page) blocks, and the tapes of both directions."""
    a, ta = _forward(x, mask, net["fore"])
    b, tb = _forward(x[::-1], mask[::-1], net["back"])
    both = np.concatenate([a, b[::-1]], axis=2)
    return both @ net["out"]["w"] + net["out"]["b"], both, ta, tb


def _pad(vectors: list[np.ndarray]):
    steps = max(len(v) for v in vectors)
    x = np.zeros((steps, len(vectors), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    mask = np.zeros((steps, len(vectors)), bool)
    for k, v in enumerate(vectors):
        x[:len(v), k], mask[:len(v), k] = v, True
    return x, mask


def _new_net(rng):
    dim = PATH_DIM + WORD_DIM + MEASURES
    side = lambda: {"x": rng.normal(0, 0.1, (dim, 4 * HIDDEN)).astype(np.float32),
                    "h": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32),
                    "b": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}
    return {"fore": side(), "back": side(),
            "out": {"w": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "b": np.zeros(1, np.float32)}}


_TRAINED: dict = {}


def train(steps: int = STEPS, seed: int = SEED) -> dict:
    """The labeller's weights; Adam on generated pages."""
    if (steps, seed) in _TRAINED:
        return _TRAINED[steps, seed]
    net, vec, rng = _new_net(np.random.default_rng(seed)), Vectors(), random.Random(seed)
    flat = lambda n: [(a, b) for a in n for b in n[a]]
    mean = {k: 0.0 for k in flat(net)}
    var = dict(mean)
    for step in range(1, steps + 1):
        pages = [generate_page(rng) for _ in range(BATCH)]
        x, mask = _pad([vec(blocks_of(p)) for p, _ in pages])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, labels) in enumerate(pages):
            y[:len(labels), k] = labels
        s, both, ta, tb = logits(x, mask, net)
        ds = np.where(mask, _sigmoid(s) - y, 0).astype(np.float32) / BATCH
        dboth = ds[..., None] * net["out"]["w"]
        grads = {"fore": _backward(x, mask, net["fore"], ta, dboth[..., :HIDDEN]),
                 "back": _backward(x[::-1], mask[::-1], net["back"], tb, dboth[::-1, :, HIDDEN:]),
                 "out": {"w": np.einsum("tb,tbh->h", ds, both), "b": ds.sum(keepdims=True).reshape(1)}}
        rate = RATE * (1 - 0.9 * step / steps)
        for a, b in mean:
            g = grads[a][b]
            mean[a, b] = 0.9 * mean[a, b] + 0.1 * g
            var[a, b] = 0.999 * var[a, b] + 0.001 * g * g
            net[a][b] -= (rate * (mean[a, b] / (1 - 0.9 ** step))
                          / (np.sqrt(var[a, b] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    _TRAINED[steps, seed] = net
    return net


# --- generated pages -----------------------------------------------------

_MAIN = "content article post entry story main body text page blog news".split()
_SIDE = {
    "nav": "nav navigation menu navbar topnav breadcrumb breadcrumbs pagination pager tabs toc sitemap".split(),
    "header": "header masthead banner top branding logo topbar".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "aside": "sidebar aside side widget related recommended popular trending tags archive secondary".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay subscribe newsletter paywall promo message".split(),
    "ad": "ad ads advert advertisement sponsored sponsor banner adbox promo".split(),
    "form": "form search login signup contact feedback".split(),
    "comments": "comments comment replies discussion responses thread disqus reply".split(),
    "share": "share social follow byline meta author".split(),
}
_SYLLABLES = "an ba ce do er fi go ha in jo ka le mi no or pe qu re sa ti un ve wo xa yr zu é ö ñ ch st th".split()


def generate_page(rng) -> tuple[str, list[int]]:
    """A page from the seed's generator and the label of each of its blocks
    (1: article)."""
    labels: list[int] = []
    pick, some = rng.choice, rng.randrange
    coin = lambda p=0.5: rng.random() < p

    def word():
        return pick(_SYLLABLES) + pick(_SYLLABLES) * some(2) + pick(_SYLLABLES) * some(2)

    def sentence(n):
        return " ".join(word() for _ in range(n)).capitalize() + pick([".", ".", ".", "", "!", "?"])

    def prose(top):
        if coin(0.08):          # junk: each word again and again
            return " ".join(" ".join([word()] * some(3, 12)) for _ in range(some(1, top)))
        return " ".join(sentence(some(2, 14)) for _ in range(some(1, top)))

    def leaf(tag, text, label, attrs=""):
        labels.append(label)
        if label and coin(0.2):
            text = f"<b>{text}<br>"
        elif coin(0.2):
            first, _, rest = text.partition(" ")
            text = f"<{'em' if label else 'a href=x'}>{first}</{'em' if label else 'a'}> {rest}" if rest else text
        ends = f"</{tag}>" if tag not in ("p", "li") or coin(0.85) else ""
        return f"<{tag}{attrs}>{text}{ends}"

    def named(kind_names, chance=0.9):
        if not coin(chance):
            return ""
        name = pick(kind_names)
        if coin(0.3):
            name = f"{pick(['site', 'page', 'main', 'block', 'box', 'c'])}-{name}"
        return f' {pick(["class", "class", "id"])}="{name}"'

    def links(n, label=0):
        items = "".join(leaf("li", f'<a href="/{word()}">{word()}</a>', label) for _ in range(n))
        return f"<{'ul' if coin(0.8) else 'ol'}>{items}</ul>"

    def side(kind):
        names = _SIDE[kind]
        real = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = real if real and coin(0.6) else pick(["div", "section"])
        attrs = named(names, 0.3 if tag == real else 1.0)
        if kind in ("nav", "share"):
            inner = links(some(2, 8))
        elif kind == "aside":
            inner = leaf("h3", sentence(3), 0) + (links(some(2, 7)) if coin() else
                                                  leaf("p", prose(4), 0))
        elif kind == "form":
            inner = leaf("p", sentence(4), 0) + "<input name=q>" + (leaf("button", word(), 0) if coin() else "")
        elif kind == "comments":
            inner = "".join(leaf("h4", word(), 0) + leaf("p", prose(5), 0)
                            for _ in range(some(1, 6)))
            if coin(0.4):
                inner = leaf("h3", sentence(2), 0) + inner
        elif kind == "footer":
            labels.append(0)
            inner = f"&copy; www.{word()}.example.com &middot; " + sentence(6)
            if coin(0.4):
                inner += links(some(1, 6))
        else:
            if coin(0.6):
                labels.append(0)
                inner = prose(4)
            else:
                inner = leaf("p", prose(4), 0)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def article():
        tag = pick(["article", "article", "main", "div", "section"])
        attrs = named(_MAIN, 0.3 if tag in ("article", "main") else 1.0)
        n = some(1, 12)
        inner = leaf("h1", sentence(some(2, 12)), 1) if coin(0.85) else ""
        for k in range(n):
            r = rng.random()
            if r < 0.08:
                inner += leaf(pick(["h2", "h3"]), sentence(4), 1)
            elif r < 0.14:
                inner += "<ul>" + "".join(leaf("li", sentence(6), 1) for _ in range(some(1, 4))) + "</ul>"
            elif r < 0.18:
                inner += leaf("blockquote", prose(3), 1)
            elif r < 0.21:
                inner += side(pick(["ad", "share", "aside"]))
            else:
                inner += leaf("p", prose(8), 1)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    before = [k for k in ("header", "nav", "notice", "ad", "form") if coin(0.45)]
    after = [k for k in ("ad", "aside", "share", "form", "comments", "notice") if coin(0.4)]
    rng.shuffle(before)
    rng.shuffle(after)
    body = "".join(side(k) for k in before)
    wrap = coin(0.3)
    if wrap:
        body += f"<div{named(['wrapper', 'container', 'row', 'layout', 'page'], 1.0)}>"
    body += article() + "".join(side(k) for k in after) + ("</div>" if wrap else "")
    body += side("footer") if coin(0.8) else ""
    head = f"<head><title>{sentence(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>", labels


# --- extraction ----------------------------------------------------------

class Extractor:
    def __init__(self, net: dict):
        self.net, self.vectors = net, Vectors()

    def texts(self, pages: list[str]) -> list[str]:
        """Main text of each page."""
        out = [""] * len(pages)
        parsed = [blocks_of(p) for p in pages]
        order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
        k = 0
        while k < len(order):
            n = len(parsed[order[k]])
            group = order[k:k + max(1, min(PAGES_PER_BATCH, BLOCKS_PER_BATCH // (2 * n)))]
            k += len(group)
            x, mask = _pad([self.vectors(parsed[i]) for i in group])
            score = logits(x, mask, self.net)[0]
            for j, i in enumerate(group):
                out[i] = " ".join(b.text for b, s in zip(parsed[i], score[:, j]) if s > 0)
        return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every row."""
    net = pages.sparkSession.sparkContext.broadcast(train())
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        ex = Extractor(net.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = ex.texts([p or "" for p in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
