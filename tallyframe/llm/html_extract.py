"""Operator 1: main-text extraction with a recurrent block labeller.

A page is a sequence of leaf blocks (``blocks``). A bidirectional LSTM in numpy reads one
vector per block (tag path, hashed words, layout) over the whole page and labels
every block as main text or not, so a block is judged in the context of the document.

The network is trained here, on the driver, on a bounded sample: ``SAMPLE`` pages with the
smallest hash of their id. Labels come from markup that states its purpose (``nav``,
``footer``, class names such as ``comments``). The sampled pages are also shown in
``VARIANTS`` altered forms (menus, notices, forms, adverts and comments added in various
markups, containers renamed), so that the labeller knows more layouts than one site uses.
Training is seeded and takes a few seconds; its cost does not depend on the table's size.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.blocks import ASIDE, DIM, Block, Vectors, blocks

SAMPLE, SAMPLE_CHARS, VARIANTS = 96, 200_000, 4
HIDDEN, EPOCHS, BATCH, RATE, CROP = 16, 24, 24, 0.012, 60
THRESHOLD = 0.5

#: Element around added regions whose own markup states nothing; seen by the teacher only.
UNSTATED = "x-aside"


def stated_label(b: Block) -> bool:
    """Main text, as far as the markup around the block states it (kept with each element)."""
    chain, node = [], b.node
    while node is not None and node.stated is None:
        chain.append(node)
        node = node.parent
    label = node is None or node.stated
    for node in reversed(chain):
        label = node.stated = label and node.tag != UNSTATED and not ASIDE.intersection(node.tokens)
    return label


# Fixed values: (opening, closing) markup and block element of added regions.
REGIONS = [("<header>", "</header>", "div"), ('<div class="header">', "</div>", "p"), ("<aside>", "</aside>", "p"),
           ('<div class="sidebar">', "</div>", "p"), ('<div id="sidebar" class="widget">', "</div>", "li"),
           ('<div class="cookie-notice">', "</div>", "p"), ('<div class="notice">', "</div>", "div"),
           ('<div class="consent" role="dialog">', "</div>", "p"), ("<form>", "</form>", "label"),
           ('<form class="newsletter">', "</form>", "p"), ('<div class="ad">', "</div>", "p"),
           ('<div class="advertisement">', "</div>", "div"), ('<div class="sponsored promo">', "</div>", "p"),
           ('<div class="banner">', "</div>", "p"), ('<section class="comments">', "</section>", "p"),
           ('<div id="comments">', "</div>", "div"), ('<ol class="comment-list">', "</ol>", "li"),
           ('<ul class="menu">', "</ul>", "li"), ('<div class="navigation">', "</div>", "a"), ("<nav>", "</nav>", "a"),
           ('<div class="breadcrumbs">', "</div>", "a"), ('<div class="related">', "</div>", "li"),
           ('<div class="share social">', "</div>", "a"), ("<footer>", "</footer>", "p"),
           ('<div id="footer">', "</div>", "p"), ('<div class="copyright">', "</div>", "p"),
           ("<button>", "</button>", "span"), ("<select>", "</select>", "option"), ('<div class="login">', "</div>", "p")]
HOLDERS = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
           ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post">', "</div>"),
           ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"),
           ("", ""), ('<div class="site no-sidebar">', "</div>"), ('<div class="wrap has-header-image">', "</div>"),
           ('<div class="page is-menu-closed without-comments"><article class="post">', "</article></div>"),
           ('<main><article class="post type-post"><div class="entry-content">', "</div></article></main>")]
# Menus and notes whose markup states nothing: cells, lists or paragraphs of short links.
PLAIN_REGIONS = [("<table><tr>", "</tr></table>", "td"), ("<ul>", "</ul>", "li"), ("<div>", "</div>", "p"), ("<div>", "</div>", "span")]
INNER = ["p", "p", "p", "h2", "h3", "li", "blockquote", "div", "pre", "td", "section", "span"]


def altered(found: list[Block], rnd: random.Random) -> str:
    """A page made of the main blocks of another one, in another holder and element each, with
    added regions around and between them."""
    main = [b.text for b in found if stated_label(b)] or ["Some text."]
    other = [b.text for b in found if not stated_label(b)] or ["Menu"]

    def text(t: str) -> str:
        return t.replace("&", "&amp;").replace("<", "&lt;")

    def region() -> str:
        begin, end, element = rnd.choice(REGIONS)
        lines = [text(rnd.choice(rnd.choice([main, other]))) for _ in range(rnd.choice([1, 1, 2, 4]))]
        return begin + "".join(f"<{element}>{x}</{element}>" for x in lines) + end

    def links() -> str:
        begin, end, element = rnd.choice(PLAIN_REGIONS)
        shown = [" ".join(rnd.choice(other).split()[:3]) for _ in range(rnd.choice([3, 4, 6]))]
        lines = [f"<a href='/x'>{text(x)}</a>" for x in shown]
        if rnd.random() < 0.5:
            lines = [rnd.choice([" / ", " | ", " "]).join(lines)]
        return f"<{UNSTATED}>{begin}" + "".join(f"<{element}>{x}</{element}>" for x in lines) + f"{end}</{UNSTATED}>"

    def some(most: int) -> str:
        return "".join(links() if rnd.random() < 0.15 else region() for _ in range(rnd.randrange(most + 1)))

    begin, end = rnd.choice(HOLDERS)
    kind = rnd.choice([None, "p", "p"])
    inside = [f"<h1>{text(main[0][:60])}</h1>"] if rnd.random() < 0.7 else []
    for t in main:
        e = kind or rnd.choice(INNER)
        words = text(t)
        if rnd.random() < 0.1:
            words = f'<a href="/x">{words}</a>'
        inside.append(f"<{e}>{words}</{e}>" if e != "span" else f"<p><span>{words}</span></p>")
        if rnd.random() < 0.06:
            inside.append(region())
    return f"<html><body>{some(3)}{begin}{''.join(inside)}{end}{some(4)}</body></html>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTMs over padded batches (batch, time, DIM), read in both directions; a logistic unit
    per block. Padding is masked: it neither changes the state nor gets a gradient."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {"out": rng.normal(0, 0.3, 2 * h).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.1, (DIM, 4 * h)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p[f"b{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction (time order of ``x``), and what the way back needs."""
        n, time, _ = x.shape
        h = self.h
        wide = x.reshape(n * time, -1) @ self.p[f"x{d}"] + self.p[f"b{d}"]
        wide = wide.reshape(n, time, 4 * h)
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, trace = np.zeros((n, time, h), np.float32), []
        for t in (range(time) if d == "f" else reversed(range(time))):
            g = wide[:, t] + s @ self.p[f"h{d}"]
            gates = _sigmoid(g[:, :3 * h])
            i, f, o, a = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(g[:, 3 * h:])
            new = f * c + i * a
            tc, m = np.tanh(new), mask[:, t, None]
            if keep:
                trace.append((t, s, c, i, f, o, a, tc, m))
            s, c = np.where(m, o * tc, s), np.where(m, new, c)
            out[:, t] = s
        return out, trace

    def _back(self, x: np.ndarray, trace: list, d: str, dout: np.ndarray) -> dict[str, np.ndarray]:
        h = self.h
        dwide = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
        ds = np.zeros((x.shape[0], h), np.float32)
        dc, dh = np.zeros_like(ds), np.zeros_like(self.p[f"h{d}"])
        for t, s, c, i, f, o, a, tc, m in reversed(trace):
            ds = ds + dout[:, t]
            live = np.where(m, ds, 0)
            dn = np.where(m, dc, 0) + live * o * (1 - tc * tc)
            g = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), live * tc * o * (1 - o), dn * i * (1 - a * a)], 1)
            dwide[:, t] = g
            dh += s.T @ g
            ds, dc = np.where(m, 0, ds) + g @ self.p[f"h{d}"].T, np.where(m, dn * f, dc)
        flat = dwide.reshape(-1, 4 * h)
        return {f"x{d}": x.reshape(len(flat), -1).T @ flat, f"h{d}": dh, f"b{d}": flat.sum(0)}

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over the blocks, and its gradients."""
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        p = _sigmoid(both @ self.p["out"] + self.p["bias"])
        dz = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / mask.sum()
        g = {"out": np.einsum("nt,nth->h", dz, both), "bias": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.p["out"]
        for k, d in enumerate("fb"):
            g |= self._back(x, runs[d][1], d, dboth[:, :, k * self.h:(k + 1) * self.h])
        return float(loss), g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    time = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), time, DIM), np.float32), np.zeros((len(pages), time), bool)
    for k, p in enumerate(pages):
        x[k, :len(p)], mask[k, :len(p)] = p, True
    return x, mask


def train(pages: list[str], seed: int = 7, epochs: int = EPOCHS) -> BiLSTM:
    """Fits the labeller with Adam on the pages and their altered forms; seeded."""
    rnd, vectors, seen = random.Random(seed), Vectors(), []
    for found in [blocks(p) for p in pages] or [[]]:
        for variant in [found, *(blocks(altered(found, rnd)) for _ in range(VARIANTS))]:
            if variant:
                x, y = vectors.page(variant), np.array([stated_label(b) for b in variant], np.float32)
                at = rnd.randrange(max(len(variant) - CROP, 0) + 1)
                seen.append((x[at:at + CROP], y[at:at + CROP]))
    model, step = BiLSTM(seed=seed), 0
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for epoch in range(epochs):
        rnd.shuffle(seen)
        # Batches of pages alike in length waste little on padding.
        order = sorted(seen, key=lambda s: len(s[0]) + rnd.random() * 8)
        batches = [order[k:k + BATCH] for k in range(0, len(order), BATCH)]
        rnd.shuffle(batches)
        for batch in batches:
            x, mask = padded([s[0] for s in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batch):
                y[k, :len(labels)] = labels
            _, g = model.gradients(x, mask, y)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k in model.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                model.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def label(model: BiLSTM, pages: list[list[Block]], vectors: Vectors, cells: int = 6000) -> list[list[bool]]:
    """Main text or not, for every block of every page. Pages are batched by length, at most
    ``cells`` blocks (padding included) at once, or one longer page alone."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(pages[order[n]]) <= cells:
            n += 1
        now, order = order[:n], order[n:]
        x, mask = padded([vectors.page(pages[k]) for k in now])
        scores = model.scores(x, mask)
        for row, k in enumerate(now):
            out[k] = (scores[row, :len(pages[k])] >= THRESHOLD).tolist()
    return out


def _extract_task(model: BiLSTM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [blocks(h.as_py()) for h in part.column(2)]
                kept = label(model, pages, vectors)
                texts = ["\n".join(b.text for b, k in zip(p, keep) if k) for p, keep in zip(pages, kept)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int32()),
                     pa.array([sum(k) for k in kept], pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return run


def training_pages(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, by the hash of their id;
    of pages that share an id one.

    Only hashes below a threshold that about ``8 * sample`` pages pass are looked at, so what
    is sorted and sent stays the same size however many pages and partitions there are."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    share = min(1.0, 8 * sample / max(pages.count(), 1))
    top = min(int((share - 0.5) * 2.0 ** 64), (1 << 63) - 1)
    near = pages.select(key.alias("key"), F.col(html_col).alias("html")).where(
        (F.col("key") <= F.lit(top).cast("long")) & (F.length("html") <= SAMPLE_CHARS))
    first = near.groupBy("key").agg(F.min("html").alias("html")).orderBy("key").limit(sample)
    return [r["html"] for r in first.collect()]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      model: BiLSTM | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main): one row per row of ``pages``; main blocks in
    page order, joined by a line feed.

    Null and empty pages have no blocks and an empty text; plain text without markup is one
    block. Broken markup is read as far as it goes. Repeated rows give equal results; an
    empty table gives no rows. Without ``model`` one is trained on a sample of ``pages``."""
    model = model or train(training_pages(pages, id_col, html_col))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = (f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, "
              "n_blocks int, n_main int")
    return p.mapInArrow(_extract_task(model), schema)
