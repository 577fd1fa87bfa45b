"""Main text of pages, by a recurrent labeller of text blocks.

Method. A page is the sequence of its leaf blocks. A block's input is its tag path (names, classes and ids of the elements around
it, hashed), its words, hashed, and a few numbers; a bidirectional LSTM in numpy reads the sequence both ways and labels
every block as main text or not, so a block is judged in the context of its whole page.

Fitting. Pages carry no labels. The labeller is fitted on pages made up from the block texts of a bounded sample of the given ones
(``SAMPLE_ROWS``, each of at most ``SAMPLE_BYTES``): the texts are laid out anew with known roles, as articles with headings in
usual containers, among menus, headers, footers, sidebars, notices, adverts, forms and comments under usual names. This
happens on the driver and costs the same for any table.

Scale. Reading a page is one pass without a shuffle, whole pages at a time; the network's parameters are sent along.

Rows. Null and empty pages, and pages without main text, have an empty text. Very long pages are read whole. Rows are kept one to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import append_columns, joined_bytes, thinned
from feedlake.llm.html_blocks import PATH_BINS, Block, blocks
from feedlake.llm.shingles import word_hashes

WORD_BINS, HIDDEN = 64, 16
INPUTS = PATH_BINS + WORD_BINS + 4
SAMPLE_ROWS, SAMPLE_BYTES = 200, 1 << 16
PAGES, EPOCHS, BATCH, RATE = 1500, 10, 32, 0.01
#: Blocks labelled at once, padding included; a longer page is labelled alone.
TOGETHER = 16384
#: Begins main blocks of made-up pages, until they are read.
MARK = "\ue000"


def inputs(found: list[Block]) -> np.ndarray:
    """The input vectors of blocks."""
    x = np.zeros((len(found), INPUTS), np.float32)
    if not found:
        return x
    packed = np.frombuffer(b"".join(b.path.to_bytes(PATH_BINS // 8, "little") for b in found), np.uint8)
    x[:, :PATH_BINS] = np.unpackbits(packed.reshape(len(found), -1), axis=1, bitorder="little")
    data, bounds = joined_bytes(pa.array([b.text for b in found], pa.string()))
    hashes, _, _, first = word_hashes(data, bounds)
    owner = np.repeat(np.arange(len(found)), np.diff(first))
    words = np.bincount(owner * WORD_BINS + (hashes % np.uint64(WORD_BINS)).astype(np.int64), minlength=len(found) * WORD_BINS).reshape(-1, WORD_BINS)
    sizes = np.asarray([len(b.text) for b in found])
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = words / np.maximum(1, words.sum(axis=1, keepdims=True))
    x[:, -4] = np.log1p(sizes) / 8
    x[:, -3] = np.asarray([b.linked for b in found]) / np.maximum(1, sizes)
    x[:, -2] = np.log1p(words.sum(axis=1)) / 8
    x[:, -1] = np.asarray([b.text[-1:] in ".!?…" for b in found])
    return x


def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
    s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -60, 60)))
    return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])


class Labeller:
    """Parameters for both directions: input, state, shift; and the output weights."""

    NAMES = ("input0", "state0", "shift0", "input1", "state1", "shift1", "weights", "bias")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        for k in "01":
            setattr(self, "input" + k, rng.normal(0, 0.1, (INPUTS, 4 * HIDDEN)).astype(np.float32))
            setattr(self, "state" + k, rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32))
            shift = np.zeros(4 * HIDDEN, np.float32)
            shift[HIDDEN : 2 * HIDDEN] = 1  # remember, to begin with
            setattr(self, "shift" + k, shift)
        self.weights = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _run(self, k: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of one direction; where ``live`` is false the state stays."""
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        given = x @ getattr(self, "input" + k) + getattr(self, "shift" + k)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps):
            i, f, o, g = _gates(given[:, t] + h @ getattr(self, "state" + k))
            m = live[:, t, None]
            new_c = np.where(m, f * c + i * g, c)
            new_h = np.where(m, o * np.tanh(new_c), h)
            if keep is not None:
                keep.append((i, f, o, g, c, new_c, h))
            h, c = new_h, new_c
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, ...]:
        """(page, block) logits for padded inputs, and what the backward pass needs."""
        live = np.arange(x.shape[1]) < lengths[:, None]
        turn = np.where(live, lengths[:, None] - 1 - np.arange(x.shape[1]), np.arange(x.shape[1]))
        backwards = np.take_along_axis(x, turn[:, :, None], axis=1)
        forth = self._run("0", x, live, keep and keep[0])
        back = np.take_along_axis(self._run("1", backwards, live, keep and keep[1]), turn[:, :, None], axis=1)
        both = np.concatenate([forth, back], axis=2)
        return both @ self.weights + self.bias, both, live, turn, backwards

    def _back(self, k: str, x: np.ndarray, live: np.ndarray, kept: list, down: np.ndarray) -> dict:
        """Gradients of one direction, from the gradient of its states."""
        state = getattr(self, "state" + k)
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_state = np.zeros_like(state)
        dh, dc = np.zeros_like(down[:, 0]), np.zeros_like(down[:, 0])
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, c, new_c, h = kept[t]
            m = live[:, t, None]
            dh = dh + down[:, t]
            tanh = np.tanh(new_c)
            own_dc = dc + dh * o * (1 - tanh**2)
            z = np.concatenate([own_dc * g * i * (1 - i), own_dc * c * f * (1 - f), dh * tanh * o * (1 - o), own_dc * i * (1 - g**2)], axis=1) * m
            dz[:, t] = z
            d_state += h.T @ z
            dh = np.where(m, z @ state.T, dh)
            dc = np.where(m, own_dc * f, dc)
        flat = dz.reshape(-1, 4 * HIDDEN)
        return {"input" + k: x.reshape(-1, INPUTS).T @ flat, "state" + k: d_state, "shift" + k: flat.sum(axis=0)}

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> Labeller:
        """Adam on the cross-entropy of all blocks of (inputs, labels)."""
        rng = np.random.default_rng(17)
        moment = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            for low in range(0, len(order), BATCH):
                own = [pages[i] for i in order[low : low + BATCH]]
                x, lengths = padded([p[0] for p in own])
                y = np.zeros(x.shape[:2], np.float32)
                for i, (_, labels) in enumerate(own):
                    y[i, : len(labels)] = labels
                keep: tuple[list, list] = ([], [])
                logit, both, live, turn, backwards = self.logits(x, lengths, keep)
                error = np.where(live, 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y, 0) / live.sum()
                grad = {"weights": np.einsum("bt,bth->h", error, both), "bias": error.sum().reshape(1)}
                down = error[:, :, None] * self.weights
                grad |= self._back("0", x, live, keep[0], down[:, :, :HIDDEN])
                grad |= self._back("1", backwards, live, keep[1], np.take_along_axis(down[:, :, HIDDEN:], turn[:, :, None], axis=1))
                step += 1
                for n in self.NAMES:
                    first, second = moment[n]
                    first += 0.1 * (grad[n] - first)
                    second += 0.01 * (grad[n] ** 2 - second)
                    rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                    getattr(self, n)[...] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the flags of its main blocks."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        low = 0
        while low < len(order):
            high = low + 1  # shortest first, so the last of a group is the longest
            while high < len(order) and (high + 1 - low) * len(pages[order[high]]) <= TOGETHER:
                high += 1
            own, low = order[low:high], high
            flat = inputs([b for i in own for b in pages[i]])
            lengths = np.asarray([len(pages[i]) for i in own])
            cuts = np.cumsum(lengths)[:-1]
            x, lengths = padded(np.split(flat, cuts))
            logit = self.logits(x, lengths)[0]
            for i, row, n in zip(own, logit, lengths, strict=True):
                out[i] = row[:n] > 0
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray([len(r) for r in rows])
    x = np.zeros((len(rows), max(1, int(lengths.max(initial=0))), INPUTS), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, lengths


class Layouts:
    """Made-up pages with known roles, from given texts."""

    MAIN = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', "main><article", 'div class="page"><div class="article"')
    SIDE = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'section class="related-posts"', 'div class="share"', 'div class="social"', 'div class="newsletter"')
    ADVERT = ('div class="ad"', 'div class="advert"', 'div class="ads"', 'div class="banner"', 'div class="sponsored"', 'div class="promo"', 'aside class="advertisement"', 'div id="ad-top"')
    NOTICE = ('div class="cookie-notice"', 'div class="cookie-banner"', 'div class="notice"', 'div id="cookies"', 'div class="consent"', 'div role="alert"', 'div class="popup"')
    COMMENTS = ('div class="comments"', 'section id="comments"', 'section class="comments"', 'ol class="comment-list"', 'div class="comment-thread"', 'div id="disqus_thread"')
    HEADER = ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="top"')
    FOOTER = ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"')
    MENU = ("nav", 'ul class="menu"', 'div class="navbar"', 'nav class="breadcrumbs"', 'div id="nav"', 'div class="navigation"')

    def __init__(self, texts: list[str], seed: int = 23):
        self.rng = np.random.default_rng(seed)
        self.texts = [t.replace(MARK, "") for t in texts] or [" ".join("".join(chr(97 + c) for c in self.rng.integers(0, 26, 5)) for _ in range(n)) + "." for n in self.rng.integers(1, 60, 200)]
        self.words = [w for t in self.texts[:500] for w in t.split()[:40]] or ["word"]

    def one(self, options: tuple[str, ...]) -> str:
        return options[self.rng.integers(len(options))]

    def text(self) -> str:
        return self.texts[self.rng.integers(len(self.texts))]

    def short(self, most: int = 5) -> str:
        return " ".join(self.words[i] for i in self.rng.integers(0, len(self.words), self.rng.integers(1, most + 1)))

    @staticmethod
    def wrap(opening: str, inner: str) -> str:
        tags = [o.split()[0] for o in opening.split("><")]
        return f"<{opening}>{inner}" + "".join(f"</{t}>" for t in reversed(tags))

    def paragraphs(self, mark: str, least: int, most: int) -> str:
        out = ""
        for _ in range(self.rng.integers(least, most + 1)):
            kind = self.rng.integers(16)
            text = f"{mark}{_escaped(self.text() if self.rng.random() < 0.8 else self.short(12))}"
            if kind == 0:
                out += f"<p><b>{text}<br>"
            elif kind == 1:
                out += f"<ul><li>{text}</li><li>{mark}{_escaped(self.short(8))}</li></ul>"
            elif kind == 2:
                out += f"<h2>{mark}{_escaped(self.short())}</h2><p>{text}</p>"
            elif kind == 3:
                out += f"<blockquote>{text}</blockquote>"
            elif kind == 5:
                cells = "".join(f"<td>{mark}{_escaped(self.short(4))}</td>" for _ in range(self.rng.integers(1, 4)))
                out += f"<table><tr>{cells}</tr><tr><td>{text}</td></tr></table>"
            elif kind == 6:
                out += f"<figure><img src='x'><figcaption>{text}</figcaption></figure>"
            elif kind == 7:
                out += self.one((f"<div><p>{text}</p></div>", f"<section><h3>{mark}{_escaped(self.short())}</h3><p>{text}</p></section>", f"<pre>{text}</pre>", f"<ol><li>{text}</li></ol>"))
            elif kind == 4:
                out += f"<p>{text} <a href='#'>{_escaped(self.short())}</a> {_escaped(self.short())}</p>"
            else:
                out += f"<p>{text}</p>"
        return out

    def links(self) -> str:
        return "".join(f'<li><a href="/x">{_escaped(self.short(2))}</a></li>' for _ in range(self.rng.integers(2, 8)))

    def side(self, options: tuple[str, ...]) -> str:
        return self.wrap(self.one(options), self.one((f"<ul>{self.links()}</ul>", f"<p>{_escaped(self.text())}</p>", f"{_escaped(self.text())}", f"<h3>{_escaped(self.short())}</h3><p>{_escaped(self.short(12))}</p>")))

    def page(self) -> str:
        """A page whose main blocks begin with the mark U+E000."""
        r = self.rng.random
        mark = MARK
        body = f"<h1>{mark}{_escaped(self.short(12))}</h1>" if r() < 0.85 else ""
        if body and r() < 0.15:
            body = f"<header>{body}</header>"
        body += self.paragraphs(mark, 1, 9)
        inside = [self.side(self.ADVERT) for _ in range(self.rng.integers(2) if r() < 0.3 else 0)]
        inside += [self.side(self.SIDE)] * (r() < 0.15)
        inside += [self.form()] * (r() < 0.1)
        for extra in inside:
            body = body + extra + (self.paragraphs(mark, 1, 3) if r() < 0.5 else "")
        comments = self.comments()
        talk = r()
        if talk < 0.2:
            body += comments
        main = self.wrap(self.one(self.MAIN) if r() < 0.6 else "article", body)
        before, after = [], []
        for chance, place, make in (
            (0.4, before, lambda: self.wrap(self.one(self.HEADER), self.one((_escaped(self.short()), f"<p>{_escaped(self.text())}</p>", f"<h1>{_escaped(self.short())}</h1><ul>{self.links()}</ul>")))),
            (0.8, before, lambda: self.wrap(self.one(self.MENU), f"<ul>{self.links()}</ul>" if r() < 0.7 else self.links())),
            (0.3, before, lambda: self.side(self.NOTICE)),
            (0.5, before, lambda: self.side(self.ADVERT)),
            (0.3, before if r() < 0.4 else after, lambda: self.side(self.SIDE)),
            (0.2, after, lambda: self.side(self.ADVERT)),
            (0.2, before if r() < 0.5 else after, self.form),
            (0.3 if talk >= 0.2 else 0, after, lambda: comments),
            (0.15, after, lambda: self.side(self.NOTICE)),
            (0.85, after, lambda: self.wrap(self.one(self.FOOTER), self.one((f"&copy; {_escaped(self.short())} &middot; {_escaped(self.text())}", f"<p>{_escaped(self.text())}</p>", f"<ul>{self.links()}</ul>")))),
        ):
            if r() < chance:
                place.append(make())
        title = f"<title>{_escaped(self.short(12))}</title>" if r() < 0.9 else ""
        return f"<html><head>{title}</head><body>{''.join(before)}{main}{''.join(after)}</body></html>"

    def comments(self) -> str:
        r = self.rng.random
        said = [f"<b>{_escaped(self.short(2))}</b>" * (r() < 0.3) + f"<p>{_escaped(self.text() if r() < 0.7 else self.short(10))}</p>" for _ in range(self.rng.integers(1, 5))]
        kind = self.rng.integers(3)
        if kind == 0:
            inner = "".join(f'<div class="comment">{c}</div>' for c in said)
        elif kind == 1:
            inner = f'<ol class="comment-list">{"".join(f"<li>{c}</li>" for c in said)}</ol>'
        else:
            inner = "".join(f"<li>{c}</li>" for c in said)
        inner = f"<h3>{_escaped(self.short(3))}</h3>" * (r() < 0.4) + inner + (self.form() if r() < 0.25 else "")
        return self.wrap(self.one(self.COMMENTS), inner)

    def form(self) -> str:
        return f"<form action='/x'><label>{_escaped(self.short())}</label><input><p>{_escaped(self.short(12))}</p><button>{_escaped(self.short())}</button></form>"


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def training_pages(texts: list[str], count: int = PAGES, seed: int = 23) -> list[tuple[np.ndarray, np.ndarray]]:
    layouts = Layouts(texts, seed)
    out = []
    for _ in range(count):
        found = blocks(layouts.page())
        labels = np.asarray([b.text.startswith(MARK) for b in found], np.float32)
        for b in found:
            b.text = b.text.removeprefix(MARK) or "x"
        if found:
            out.append((inputs(found), labels))
    return out


def fitted(pages: DataFrame) -> Labeller:
    """A labeller for pages like those of the bounded sample."""
    html = F.col("html").cast("string")
    able = pages.select("page_id", html.alias("html")).where(F.octet_length("html").between(1, SAMPLE_BYTES))
    sample = thinned(able, SAMPLE_ROWS).orderBy(F.xxhash64("html"), "html").limit(SAMPLE_ROWS)
    texts = [b.text for row in sample.collect() for b in blocks(row["html"])]
    return Labeller().fit(training_pages(texts))


def extracted(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``pages`` with ``text``, the main blocks of ``html`` joined by two line feeds, and its length ``n_chars``."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [blocks(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        texts = ["\n\n".join(b.text for b, is_main in zip(page, flags, strict=True) if is_main) for page, flags in zip(found, labeller.label(found), strict=True)]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return append_columns(pages, run, "text string, n_chars bigint", column="html")
