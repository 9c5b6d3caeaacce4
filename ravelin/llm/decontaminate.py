"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document is contaminated by a benchmark item if some stretch of it can be
turned into the whole item with at most k edits (code points), k being
``ERRORS`` of the item's length.  By the q-gram lemma such a stretch shares at
least ``m - q + 1 - k * q`` of the item's m - q + 1 q-grams with it, at offsets
whose difference (the diagonal) varies by k at most.  So per document and item,
shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half,
each set of k + 1 neighbouring diagonals lying within one band; bands that meet
the bound are the candidate regions, and banded alignment decides them.

Texts are compared code point by code point after lower-casing letters below
U+0250 and turning each white-space character into a blank; offsets in results
are code points of the original text.  The benchmark is the query set: it is
read in blocks of ``BLOCK_CHARS``, one at a time, and each block passes over all
documents, so neither its size nor a document's is bounded; documents are scanned
in runs of about ``RUN_CHARS`` that overlap by the longest stretch an item can
match.  The tally holds only bands that are hit, the alignment only the band's
diagonals.

Defined results: null and empty texts match nothing, null, empty and blank items
neither; an item shorter than q is found where it stands exactly and not within a
word; k is lowered until the bound is at least one q-gram;
repeated rows give repeated hits; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import tune, work_path, written

Q, ERRORS = 8, 0.08
BLOCK_CHARS, RUN_CHARS = 400_000, 120_000
#: So many shared q-grams are tallied at once.
POSTINGS = 1_000_000
_BASE = 0x100000001B3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21

_LOWER = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    _l = chr(_c).lower()
    _LOWER[_c] = 32 if chr(_c).isspace() else ord(_l) if len(_l) == 1 else _c
_BLANKS = np.array([c for c in range(0x250, 0x3001) if chr(c).isspace()], dtype=np.uint32)


def plain(text: str) -> np.ndarray:
    """Normalised code points, one for each of the text's."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 0x250
    if low.all():
        return _LOWER[c]
    out = np.where(low, _LOWER[np.where(low, c, 0)], c)
    out[np.isin(out, _BLANKS)] = 32
    return out


def grams(c: np.ndarray) -> np.ndarray:
    """Hash of each run of Q code points."""
    if len(c) < Q:
        return np.empty(0, np.uint64)
    h, k = c.astype(np.uint64) + np.uint64(1), 1
    b = _BASE
    while k * 2 <= Q:  # runs double; Q is a power of two
        h = h[:-k] * np.uint64(b) + h[k:]
        b, k = b * b % (1 << 64), k * 2
    return h * _SPREAD


def edits_allowed(m: int, errors: float = ERRORS) -> int:
    return max(0, min(int(m * errors), (m - Q) // Q))


_FAR = np.iinfo(np.int64).max // 4


def align(item: np.ndarray, text: np.ndarray, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` closest to the whole item, if within ``most`` edits.

    Only the diagonals (place in the text less place in the item) from ``low`` to
    ``high`` are filled, all by default; row by row, one cell for each diagonal.
    The leftmost of the best ends and its latest start are taken.
    """
    m, n = len(item), len(text)
    low, high = -most if low is None else low, n if high is None else high
    first = max(0, low)
    whole, same, wanted = text[first : high + m].tobytes(), -1, item.astype(text.dtype).tobytes()
    while (same := whole.find(wanted, same + 1)) >= 0:
        if same % text.itemsize == 0:  # an exact match needs no table
            at = first + same // text.itemsize
            return 0, at, at + m
    diagonal = np.arange(low, high + 1)
    at = np.arange(len(diagonal))
    before = max(0, -low)
    beside = np.concatenate([np.full(before, -1), text.astype(np.int64), np.full(max(0, m + high - n), -1)])
    cost = np.where((diagonal >= 0) & (diagonal <= n), 0, _FAR)
    begin = diagonal.copy()
    for i, x in enumerate(item.tolist()):
        taken = cost + (beside[i + low + before : i + high + 1 + before] != x)
        left_out = np.append(cost[1:], _FAR) + 1  # the item's letter
        new = np.minimum(taken, left_out)
        start = np.where(taken <= left_out, begin, np.append(begin[1:], 0))
        # letters of the text between two of the item: the cheapest cell to the left plus the distance
        least = np.minimum.accumulate(new - at)
        source = np.maximum.accumulate(np.where(new - at == least, at, 0))
        cost, begin = least + at, start[source]
        if cost.min() > most:
            return None
    cost[diagonal + m > n] = _FAR
    end = int(cost.argmin())
    return None if cost[end] > most else (int(cost[end]), int(begin[end]), int(diagonal[end]) + m)


def _whole_words(short: np.ndarray, text: np.ndarray) -> int:
    """First place of a short item in the text, not within a word there; -1 if there is none."""
    found, t = -1, text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    one = short.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    while (found := t.find(one, found + 1)) >= 0:
        end = found + len(one)
        if not (found and t[found - 1].isalnum() and one[0].isalnum()) and not (end < len(t) and t[end].isalnum() and one[-1].isalnum()):
            return found
    return -1


class Block:
    """A bounded part of the benchmark, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        self.ids, self.texts, hashes, owner, offset = [], [], [], [], []
        self.short: dict[bytes, tuple[np.ndarray, list]] = {}
        for i, text in items:
            c = plain(text)
            if len(c) < Q:
                if len(c) and not np.isin(c, 32).all():
                    self.short.setdefault(c.tobytes(), (c, []))[1].append(i)
                continue
            h = grams(c)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            offset.append(np.arange(len(h)))
            self.ids.append(i)
            self.texts.append(c)
        self.size = np.array([len(c) for c in self.texts], np.int64)
        self.most = np.array([edits_allowed(int(m), errors) for m in self.size], np.int64)
        self.bound = self.size - Q + 1 - self.most * Q
        self.longest = int((self.size + self.most).max()) if self.ids else 0
        self.length = dict(zip(self.ids, self.size.tolist(), strict=True)) | {i: len(c) for c, ids in self.short.values() for i in ids}
        if not self.ids:
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.owner, self.offset = np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): bands of diagonals that meet the bound in the code points ``c``."""
        h = grams(c)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        slot = np.searchsorted(self.hash, h[at])
        slot[slot == len(self.hash)] = 0
        hit = self.hash[slot] == h[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        # the postings of the hits, some at a time, tallied by cells of width diagonals of an item; only cells that are hit are kept
        width = self.most + 1
        cells = (len(c) + self.size) // width + 2
        base = np.cumsum(cells) - cells
        count = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(count)
        seen, times, done = [], [], 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + POSTINGS, side="right")))
            some, n = slice(done, upto), count[done:upto]
            post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slot[some]], n)
            item = self.owner[post]
            diagonal = np.repeat(at[some], n) - self.offset[post] + self.size[item]
            cell, often = np.unique(base[item] + diagonal // width[item], return_counts=True)
            seen.append(cell)
            times.append(often)
            done = upto
        cell, place = np.unique(np.concatenate(seen), return_inverse=True)
        tally = np.bincount(place, np.concatenate(times)).astype(np.int64)
        # two neighbouring cells make a band; it may begin one cell before the first that is hit
        start = np.unique(np.concatenate([cell, cell - 1]))
        own = lambda x: np.where(cell[y := np.minimum(np.searchsorted(cell, x), len(cell) - 1)] == x, tally[y], 0)
        both = own(start) + own(start + 1)
        start, both = start[both >= self.bound.min()], both[both >= self.bound.min()]
        j = np.searchsorted(base, start, side="right") - 1
        ok = (start >= 0) & (both >= self.bound[j]) & (start < base[j] + cells[j] - 1)
        j, start = j[ok], start[ok]
        return [(int(x), int(d), int(d + 2 * width[x] - 1)) for x, d in zip(j, (start - base[j]) * width[j] - self.size[j], strict=True)]

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits): the first best stretch of each item in one document."""
        c = plain(text)
        found: dict[int, tuple[int, int, int]] = {}
        step = max(RUN_CHARS - self.longest, RUN_CHARS // 2)
        for run in range(0, max(1, len(c) - self.longest + 1) if self.ids else 0, step):
            part = c[run : run + step + self.longest]
            for j, low, high in self.regions(part):
                got = align(self.texts[j], part, int(self.most[j]), low, high)
                if got:
                    new = (got[0], run + got[1], run + got[2])
                    found[j] = min(found.get(j, new), new)
        short = [(i, at, at + len(one), 0) for one, ids in self.short.values() if (at := _whole_words(one, c)) >= 0 for i in ids]
        return [(self.ids[j], s, e, d) for j, (d, s, e) in sorted(found.items())] + short


def blocks(benchmark: DataFrame, id_col: str, text_col: str, errors: float) -> Iterator[Block]:
    """The benchmark in id order, in parts of about BLOCK_CHARS."""
    rows, size = [], 0
    table = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct().orderBy("i", "t")
    for r in table.toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t)
        if size >= BLOCK_CHARS:
            yield Block(rows, errors)
            rows, size = [], 0
    if rows:
        yield Block(rows, errors)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row per document row and item found in it: ``doc_id, item_id, start, end, edits, similarity``.

    ``start`` and ``end`` delimit the stretch in code points; ``similarity`` is 1 - edits / item length.
    """
    spark = docs.sparkSession
    tune(spark)
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", item_kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)
    source = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col))
    path = work_path(spark, "hits")
    spark.createDataFrame([], shape).write.parquet(path)
    for block in blocks(benchmark, item_col, item_text, errors):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, x, s, e, d, 1 - d / b.length[x]) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True) for x, s, e, d in b.hits(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        source.mapInArrow(run, shape).write.mode("append").parquet(path)
        shared.destroy()  # one block at a time is held
    return spark.read.schema(shape).parquet(path)


def _holds(shared):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.hits(t)) for t in texts], dtype=bool)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """``docs`` without the rows whose text holds a stretch of any item; all columns as they are."""
    spark = docs.sparkSession
    tune(spark)
    shared = None
    for block in blocks(benchmark, item_col, item_text, errors):
        if shared is not None:  # another block follows: what the last one left is written first
            docs = written(docs, "clean")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        docs = docs.where(~_holds(shared)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs
