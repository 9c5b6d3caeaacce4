"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between two block-level tags, with
the path of open elements around it.  A bidirectional LSTM, written and trained
in numpy, reads for each block the hashed tags, class and id words of its path,
its hashed words and a few measures, in page order, and labels every block in
the context of the whole page.  The main text is the blocks labelled so.

Scripts, styles, comments and what is only for browsers without scripts are no
blocks.  Character references are decoded,
white space within a block (``<br>`` included) becomes one blank, blocks are
trimmed, empty ones vanish, and the rest is joined by two line feeds.

The network learns from the invented pages of ``html_pages``; training is
seeded, so every run has the same model.

Defined results: null or empty html gives an empty text; html without tags is
one block; unclosed tags, comments and scripts run to the end of the page; a
page may have any number of blocks, all of which are labelled and kept or left
out as labelled; repeated rows get equal texts.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import tune
from .html_pages import Pages

#: Elements that begin and end blocks, that have no end, that an equal sibling or a block closes.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": frozenset(BLOCK_TAGS - {"button", "label", "option"}), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Inline elements do not matter to the path, but links to the share of linked text.

_INSIDE = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|template|noscript){_INSIDE}(?<=/)>"  # closed in itself
    rf"|<(?P<out>script|style){_INSIDE}>.*?(?:</(?P=out)\s*>|\Z)"
    rf"|<(?P<gone>template|noscript|svg){_INSIDE}>"
    r"""|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<marks>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-z][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
#: The ends of elements that are left out whole; without an end the tag alone is.
_GONE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("template", "noscript", "svg")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")

PATHS, WORDS = 1024, 512
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 14, 4, 7, 14
PAGES, EPOCHS = 3_000, 12
#: Pages of more blocks are read so many at a time.
CHUNK = 4_096
#: The innermost elements of a block's path, and the names of an element, that count.
DEPTH, NAMES = 32, 24


@functools.lru_cache(8192)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed tag, and class, id and role words, of an element."""
    names = (w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower()))
    return (crc32(tag.encode()) % PATHS, *(crc32(b"." + w.encode()) % PATHS for w in itertools.islice(names, NAMES)))


class Block:
    __slots__ = ("text", "path", "leaf", "linked")

    def __init__(self, text: str, path: tuple[int, ...], leaf: tuple[int, ...], linked: float):
        self.text, self.path, self.leaf, self.linked = text, path, leaf, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, in time linear in the page whatever its markup."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    opened: dict[str, int] = {}
    endless: set[str] = set()
    parts: list[str] = []
    links, linked, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(m for _, marks in stack[-DEPTH:] for m in marks)
                out.append(Block(text, path, stack[-1][1] if stack else (), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        gone = (m["gone"] or "").lower()
        if gone and gone not in endless:
            if end := _GONE[gone].search(page, at):
                at = end.end()
            else:
                endless.add(gone)
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                close()
                if opened.get(tag):
                    while leave() != tag:
                        pass
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            close()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                leave()
            if tag not in VOID_TAGS:
                stack.append((tag, _marks(tag, m["marks"])))
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        add(page[at:])
    close()
    return out


def measures(b: Block) -> list[float]:
    n = len(b.text)
    w = b.text.count(" ") + 1
    return [np.log1p(n) / 6, np.log1p(w) / 4, b.linked, b.text[-1] in ".!?", b.text[0].isupper(), min(1.0, 4 * sum(map(b.text.count, ".,;")) / w), len(b.path) / 10]


class Net:
    """Embeddings of path marks and words, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = 2 * PATH_DIM + WORD_DIM + MEASURES
        self.par = {"p": r.normal(0, 0.3, (PATHS, PATH_DIM)), "l": r.normal(0, 0.3, (PATHS, PATH_DIM)), "w": r.normal(0, 0.1, (WORDS, WORD_DIM)), "o": r.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
        for k in "fb":
            self.par[f"x{k}"] = r.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
            self.par[f"h{k}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.par[f"q{k}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def inputs(self, page: list[Block]):
        """Weighted embedding rows as flat (row, block, weight) lists, and the measures."""
        flat = []
        for of, power in ((lambda b: b.path, 0.5), (lambda b: b.leaf, 0.5), (lambda b: [crc32(w.encode()) % WORDS for w in b.text.split()], 1.0)):
            rows = [of(b) for b in page]
            size = np.array([len(r) for r in rows])
            flat.append((np.array([x for r in rows for x in r], np.int64), np.repeat(np.arange(len(rows)), size), np.repeat(np.maximum(size, 1) ** -power, size)))
        return flat, np.array([measures(b) for b in page], float)

    def vectors(self, inputs) -> np.ndarray:
        flat, m = inputs
        out = [np.zeros((len(m), self.par[k].shape[1])) for k in "plw"]
        for x, k, (row, at, weight) in zip(out, "plw", flat, strict=True):
            np.add.at(x, at, self.par[k][row] * weight[:, None])
        return np.hstack([*out, m])

    @staticmethod
    def cell(z, c):
        """Gates and new state of one step."""
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        return i, f, o, g, new, np.tanh(new)

    @classmethod
    def run(cls, x, mask, wx, wh, q, learning=True):
        """States (steps, pages, HIDDEN) of one direction and, in learning, what the gradient needs."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        z_in, hs, keep = x @ wx + q, np.empty((steps, n, HIDDEN)), []
        for t in range(steps):
            i, f, o, g, new, th = cls.cell(z_in[t] + h @ wh, c)
            if learning:
                keep.append((h, c, i, f, o, g, th))
            k = mask[t][:, None]
            c = np.where(k, new, c)
            h = np.where(k, o * th, h)
            hs[t] = h
        return hs, keep

    def streamed(self, page: list[Block]) -> np.ndarray:
        """Logits of one long page; vectors and states are held for CHUNK blocks at a time."""
        out = np.full(len(page), self.par["c"][0])
        starts = list(range(0, len(page), CHUNK))
        for k, order, weight in (("f", starts, self.par["o"][:HIDDEN]), ("b", starts[::-1], self.par["o"][HIDDEN:])):
            h = c = np.zeros((1, HIDDEN))
            for start in order:
                v = self.vectors(self.inputs(page[start : start + CHUNK])) @ self.par[f"x{k}"] + self.par[f"q{k}"]
                for t in range(len(v)) if k == "f" else range(len(v) - 1, -1, -1):
                    _, _, o, _, c, th = self.cell(v[t] + h @ self.par[f"h{k}"], c)
                    h = o * th
                    out[start + t] += float(h[0] @ weight)
        return out

    @staticmethod
    def back(x, mask, wx, wh, dh_out, keep):
        dwx, dwh, dq, dx = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1]), np.zeros_like(x)
        dh = dc = np.zeros(keep[0][0].shape)
        for t in range(len(x) - 1, -1, -1):
            h0, c0, i, f, o, g, th = keep[t]
            k = mask[t][:, None]
            dh = dh + dh_out[t]
            dn = np.where(k, dh * o * (1 - th * th) + dc, 0)
            dz = np.hstack([dn * g * i * (1 - i), dn * c0 * f * (1 - f), np.where(k, dh * th, 0) * o * (1 - o), dn * i * (1 - g * g)])
            dwx += x[t].T @ dz
            dwh += h0.T @ dz
            dq += dz.sum(0)
            dx[t] = dz @ wx.T
            dh = np.where(k, 0, dh) + dz @ wh.T
            dc = np.where(k, dn * f, dc)
        return dx, dwx, dwh, dq

    def batch(self, pages: list):
        """Padded vectors (steps, pages, d) and mask; and the same with each page reversed."""
        vecs = [self.vectors(p) for p in pages]
        steps = max(map(len, vecs))
        x = np.zeros((2, steps, len(vecs), vecs[0].shape[1]))
        mask = np.zeros((steps, len(vecs)), bool)
        for j, v in enumerate(vecs):
            x[0, : len(v), j], x[1, : len(v), j] = v, v[::-1]
            mask[: len(v), j] = True
        return x, mask

    def logits(self, x, mask, learning=True):
        f, kf = self.run(x[0], mask, self.par["xf"], self.par["hf"], self.par["qf"], learning)
        b, kb = self.run(x[1], mask, self.par["xb"], self.par["hb"], self.par["qb"], learning)
        size = mask.sum(0)
        turned = np.zeros_like(b)
        for j, n in enumerate(size):
            turned[:n, j] = b[:n, j][::-1]
        both = np.concatenate([f, turned], axis=2)
        return both @ self.par["o"] + self.par["c"][0], both, kf, kb

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out = [np.zeros(0)] * len(pages)
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for i, p in enumerate(pages):
            if len(p) > CHUNK:
                out[i] = chance(self.streamed(p))
        order = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= CHUNK), key=lambda i: len(pages[i]))
        while order:
            # pages of like length together, so that padding stays small
            n = max(1, min(64, 4 * CHUNK // max(1, len(pages[order[min(63, len(order) - 1)]]))))
            group, order = order[:n], order[n:]
            x, mask = self.batch([self.inputs(pages[i]) for i in group])
            z = self.logits(x, mask, learning=False)[0]
            for j, i in enumerate(group):
                out[i] = chance(z[: len(pages[i]), j])
        return out

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        ready = [self.inputs(p) for p in pages]
        first, second = ({k: np.zeros_like(v) for k, v in self.par.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for group in np.array_split(r.permutation(len(pages)), max(1, len(pages) // 24)):
                x, mask = self.batch([ready[i] for i in group])
                z, both, kf, kb = self.logits(x, mask)
                y = np.zeros(mask.shape)
                for j, i in enumerate(group):
                    y[: len(labels[i]), j] = labels[i]
                dz = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / mask.sum()
                grad = {"o": np.einsum("tn,tnh->h", dz, both), "c": np.array([dz.sum()])}
                dh = dz[:, :, None] * self.par["o"]
                df, db = dh[:, :, :HIDDEN], np.zeros(dh[:, :, HIDDEN:].shape)
                for j, n in enumerate(mask.sum(0)):
                    db[:n, j] = dh[:n, j, HIDDEN:][::-1]
                dx, grad["xf"], grad["hf"], grad["qf"] = self.back(x[0], mask, self.par["xf"], self.par["hf"], df, kf)
                dy, grad["xb"], grad["hb"], grad["qb"] = self.back(x[1], mask, self.par["xb"], self.par["hb"], db, kb)
                for k in "plw":
                    grad[k] = 1e-4 * self.par[k]
                for j, i in enumerate(group):
                    n = len(labels[i])
                    dv = dx[:n, j] + dy[:n, j][::-1]
                    at = 0
                    for k, (row, to, weight) in zip("plw", ready[i][0], strict=True):
                        np.add.at(grad[k], row, dv[to, at : at + self.par[k].shape[1]] * weight[:, None])
                        at += self.par[k].shape[1]
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.par[k] -= rate * fix * first[k] / (np.sqrt(second[k]) + 1e-8)


def examples(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels of n invented pages.

    Main text is wrapped in marks on its way through the parser, so that labels follow the blocks.
    """
    source, pages, labels = Pages(seed), [], []
    mark = ""
    for _ in range(n):
        page = blocks("".join(re.sub(r">([^<]+)", rf">{mark}\1", h) if main and "<" in h else mark + h if main else h for h, main in source.page()))
        if page:
            labels.append(np.array([mark in b.text for b in page], float))
            for b in page:
                b.text = b.text.replace(mark, "").strip() or "."
            pages.append(page)
    return pages, labels


@functools.lru_cache(1)
def trained(pages: int = PAGES, seed: int = 1) -> Net:
    """The network fitted on invented pages; the same for every call."""
    net = Net()
    net.fit(*examples(pages, seed))
    return net


def main_text(net: Net, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, p in zip(page, prob, strict=True) if p >= 0.5) for page, prob in zip(found, net.label(found), strict=True)]


def extract(html: Column, spark, net: Net | None = None) -> Column:
    """Main text of a column of html."""
    tune(spark)
    shared = spark.sparkContext.broadcast((net or trained()).par)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Net()
        own.par = shared.value
        for pages in batches:
            yield pd.Series(main_text(own, list(pages)), dtype=object)

    return run(F.coalesce(html, F.lit("")))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: ``page_id, url, text, n_chars``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col), pages.sparkSession).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
