"""Packing of tokenised documents into sequences by minimum bin slack.

A document's tokens are the ids of its text and then END.  Whole windows of
``CAPACITY`` tokens are cut off its front; what remains, 1 to CAPACITY - 1
tokens or nothing, is packed with the remainders of other documents.

* ``plan`` sees the remainders as a multiset of lengths: how many there are of
  each length, at most CAPACITY - 1 numbers whatever the corpus.  It fills window
  after window.  The longest length left goes in; which multiset of the others
  comes closest to the capacity is a subset-sum problem, solved by dynamic
  programming over bit sets: bit s is set if the lengths so far, each as often as
  there are remainders of it, can sum to s.  One bit set a length is kept, and
  going back through them gives the counts, few long pieces before many short ones.
  The pattern is used as often as the counts allow, so every pattern uses up a
  length and there are about as many patterns as lengths.
* Where no multiset fills a window, the longest piece that does not fit is cut at
  the gap and its tail becomes a remainder of its own length.  The last tokens,
  less than a window, go to sequences of powers of two, which need no padding.
* A remainder finds its place by its length and its number among those of that
  length: the patterns hold ranges of these numbers.  Numbers are dealt out per
  task while the texts are tokenised, and shifted by the counts of the tasks
  before, so no length, however frequent, meets in one task.

Words are tokenised by the library once for each task and remembered (``Tokens``).
No text is cut.

Defined results: a null text counts as empty and has END alone; rows repeated
under one id are packed each for itself; a null id is carried along; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import tune, written

CAPACITY = 4096
END = 2
#: So many different pieces or ids are remembered at most.
REMEMBERED, MOST_IDS = 600_000, 8_000_000
#: The tokenizer's pieces, of letters, digits and others.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+"


# -- tokens


def pieces_of(last: int):
    """Finds the pieces of a lower-case text of characters up to ``last``."""
    kinds = {c: category(c)[0] for c in map(chr, range(last + 1))}
    letters, digits = ("".join(re.escape(c) for c, kind in kinds.items() if kind == k) for k in "LN")
    return re.compile(PIECES.format(letters=letters, digits=digits)).findall


class Numbers(dict):
    """Numbers of keys from 0, in the order in which they are first asked for; the new ones are listed."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Tokens:
    """Ids of texts, through a memory of pieces.

    A text of Latin letters (up to U+017F, where normal forms and classes of
    characters hold no surprise) is lower-cased and parted into the tokenizer's
    pieces here; new pieces are encoded together, and the ids that end a word tell
    them apart.  Of any other text, and of one that holds a special token, chunks
    between ASCII blanks are encoded by themselves: no token spans a blank.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ascii, self.latin = pieces_of(0x7F), pieces_of(0x17F)
        self.beyond = re.compile("[^\\x00-\u017f]").search
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.flat, self.starts, self.sizes = np.empty(1 << 20, np.int32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.end = 0

    def _parts(self, text: str) -> list:
        """What is remembered of a text, in its order: pieces (str) or chunks (bytes)."""
        if any(t in text for t in self.special) or not text.isascii() and self.beyond(text):
            return text.encode().split()
        return (self.ascii if text.isascii() else self.latin)(text.lower())

    def _learn(self) -> None:
        """Ids of what is new, under their numbers."""
        new, self.known.new = self.known.new, []
        pieces = [x for x in new if isinstance(x, str)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids if pieces else [], np.int32)
        sizes = np.empty(len(new), np.int64)
        of_piece = np.fromiter((isinstance(x, str) for x in new), bool, len(new))
        sizes[of_piece] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        starts = np.empty(len(new), np.int64)
        starts[of_piece] = np.cumsum(sizes[of_piece]) - sizes[of_piece]
        if not of_piece.all():
            got = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in new if isinstance(x, bytes)], add_special_tokens=False)]
            sizes[~of_piece] = [len(g) for g in got]
            starts[~of_piece] = len(ids) + np.cumsum(sizes[~of_piece]) - sizes[~of_piece]
            ids = np.concatenate([ids, np.array([i for g in got for i in g], np.int32)])
        n = len(self.known) - len(new)
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.known) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.end : self.end + len(ids)] = ids
        self.starts[n : len(self.known)] = starts + self.end
        self.sizes[n : len(self.known)] = sizes
        self.end += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, END added."""
        if len(self.known) > REMEMBERED or self.end > MOST_IDS:
            self._forget()
        found = []
        for text in texts:
            parts = self._parts(text)
            found.append(np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)))
        if self.known.new:
            self._learn()
        out = []
        for at in found:
            n = self.sizes[at]
            ids = np.empty(int(n.sum()) + 1, np.int32)
            ends = np.cumsum(n)
            ids[:-1] = self.flat[np.arange(len(ids) - 1) + np.repeat(self.starts[at] - ends + n, n)]
            ids[-1] = END
            out.append(ids)
        return out


@cache
def tokens(path: str) -> Tokens:
    """One memory for all tasks of a worker."""
    return Tokens(path)


# -- the plan


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is the largest up to ``room``."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((k for k in counts if k <= room), reverse=True):
        steps.append((length, reach))
        left, times = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # a length as often as counted, by doubling
            take = min(times, left)
            reach |= reach << (take * length) & full
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        if used:
            chosen[length] = used
    return chosen


class Plan:
    """Ranges of the remainders of each length, and where they go.

    ``ranges[length]``: parallel lists; a range begins at ``first`` and every
    ``each`` of its numbers share one sequence: ``sequence`` is the first's, they
    stand there from ``offset`` on, one after the other.  Cut pieces (``head`` > 0)
    put only so many tokens there; their tails are remainders of the rest of the
    length, numbered from ``tail``.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.sizes = capacity, 0, []
        self.ranges: dict[int, tuple[list[int], list[tuple[int, int, int, int, int]]]] = {}
        self.left = {length: n for length, n in counts.items() if n}
        self.made = dict(self.left)
        self._fill()

    def _place(self, length: int, times: int, each: int, offset: int, head: int = 0) -> None:
        firsts, rows = self.ranges.setdefault(length, ([], []))
        left = self.left[length] - times * each
        tail = self.made.get(length - head, 0) if head else 0
        firsts.append(self.made[length] - self.left[length])
        rows.append((each, self.sequences, offset, head, tail))
        if left:
            self.left[length] = left
        else:
            del self.left[length]
        if head:
            self.left[length - head] = self.left.get(length - head, 0) + times
            self.made[length - head] = tail + times

    def _use(self, pattern: dict[int, int], times: int, gap: int = 0, cut: int = 0) -> None:
        """A pattern in so many sequences; ``cut`` is the length of the piece that fills the gap with its head."""
        offset = 0
        for length in sorted(pattern, reverse=True):
            self._place(length, times, pattern[length], offset)
            offset += length * pattern[length]
        if gap:
            self._place(cut, times, 1, offset, gap)
        self.sequences += times
        self.sizes.append((offset + gap, times))

    def _fill(self) -> None:
        capacity = self.capacity
        while sum(length * n for length, n in self.left.items()) >= capacity:
            longest = max(self.left)
            rest = dict(self.left)
            rest[longest] -= 1
            pattern = closest({k: n for k, n in rest.items() if n}, capacity - longest)
            pattern[longest] = pattern.get(longest, 0) + 1
            gap = capacity - sum(k * n for k, n in pattern.items())
            times = min(self.left[k] // n for k, n in pattern.items())
            if not gap:
                self._use(pattern, times)
                continue
            # none fills the window: the longest piece that is still there gives its head; all fit not, so each is longer than the gap
            cut = max(k for k, n in self.left.items() if n > pattern.get(k, 0))
            self._use(pattern, min(times, self.left[cut] // (pattern.get(cut, 0) + 1)), gap, cut)
        # the rest by powers of two: the largest first, pieces in falling length, cut where a sequence is full
        total = sum(length * n for length, n in self.left.items())
        while total:
            room = size = 1 << (total.bit_length() - 1)
            while room:
                length = max(self.left)
                self._place(length, 1, 1, size - room, room if length > room else 0)
                room -= min(room, length)
            self.sizes.append((size, 1))
            self.sequences += 1
            total -= size

    def find(self, length: int, number: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the pieces of a remainder, in their order."""
        while length:
            firsts, rows = self.ranges[length]
            at = bisect_right(firsts, number) - 1
            each, sequence, offset, head, tail = rows[at]
            k = number - firsts[at]
            yield head or length, sequence + k // each, offset + k % each * length
            if not head:
                return
            length, number = length - head, tail + k


# -- the job


def _tokenised(path: str, kind: pa.DataType, capacity: int):
    shape = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32())), ("part", pa.int32()), ("length", pa.int32()), ("number", pa.int64()), ("windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens(path), TaskContext.get().partitionId()
        seen, windows = [0] * capacity, 0
        for batch in batches:
            ids = own.encode([t.decode(errors="replace") for t in batch.column(1).to_pylist()])
            lengths, numbers, before = [], [], []
            for i in ids:
                full, rest = divmod(len(i), capacity)
                lengths.append(rest)
                numbers.append(seen[rest])
                before.append(windows)
                seen[rest] += 1
                windows += full
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array([part] * len(ids), pa.int32()), pa.array(lengths, pa.int32()), pa.array(numbers, pa.int64()), pa.array(before, pa.int64())], schema=shape)

    return run


def _placed(plan: Plan, kind: pa.DataType):
    shape = pa.schema([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ids, length, number, window = batch.columns
            rows, of = [], []
            for k, (rest, n, w) in enumerate(zip(length.to_pylist(), number.to_pylist(), window.to_pylist(), strict=True)):
                own = ids[k].values.to_numpy()
                view, start = memoryview(own.astype("<u4").view(np.uint8)), 0
                whole = len(own) // plan.capacity
                pieces = [(plan.capacity, plan.sequences + w + j, 0) for j in range(whole)]
                pieces += plan.find(rest, n)
                for size, sequence, offset in pieces:
                    rows.append((start, size, crc32(view[4 * start : 4 * (start + size)]), len(own), sequence, offset))
                    of.append(k)
                    start += size
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(of, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], schema=shape)

    return run


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece of a document."""
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema[id_col].dataType
    arrow, long = to_arrow_type(kind), T.LongType()
    first = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("part", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("number", long), T.StructField("windows", long)])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    coded = written(texts.mapInArrow(_tokenised(path, arrow, capacity), first), "tokens")
    # how many of each length, and how many whole windows, there are in the tasks before
    held = coded.groupBy("part", "length").agg(F.count("*").alias("n"), F.sum(F.floor(F.size("ids") / capacity)).alias("whole"))
    earlier = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = held.groupBy("part").agg(F.sum("whole").alias("whole")).withColumn("all", F.lit(0))
    parts = parts.select("part", F.coalesce(F.sum("whole").over(earlier(Window.partitionBy("all"))), none).alias("windows_before"))
    shifts = held.join(parts, "part").select("part", "length", "n", "windows_before", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("length"))), none).alias("before"))
    shifts = written(shifts, "shifts")
    plan = Plan({r.length: r.n for r in shifts.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # below ``capacity`` rows
    found = coded.join(shifts, ["part", "length"]).select("doc_id", "ids", "length", (F.col("number") + F.col("before")).alias("number"), (F.col("windows") + F.col("windows_before")).alias("windows"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, long) for n in names]])
    return found.mapInArrow(_placed(plan, arrow), out)
