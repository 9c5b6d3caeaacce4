"""Brown class-based n-grams: exchange clustering and a smoothed class bigram model.

A text is its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end token.
Its probability is the product over tokens of

    p(class | class before) * p(word | class)

the end token standing before the first word.

* Counts are exact for every word of the training texts, however rare; they are
  a table that grows with the corpus and never leaves the cluster.
* Classes are found by exchange clustering in two steps.  First the ``TOP_WORDS``
  most frequent words are units of their own and every other word belongs to the
  unit of its last four bytes, one of ``ENDINGS``; training bigrams are counted
  between units, a matrix of bounded size, and units are moved between classes
  one by one as long as the class bigram likelihood grows.  Then every further
  word of the core that occurs ``LEAST_COUNT`` times is moved, on its own counts
  of the classes beside it, to the class where the likelihood is largest; these
  counts are a table on the cluster.  Only rarer words, those beyond the core and
  unknown ones keep the class of their ending.
* Emissions are discounted absolutely within each class; what is taken off is
  the probability of an unknown word of that class.  Transitions are drawn
  towards the class frequencies.  So the probabilities of all known words and
  of one unknown word per class sum to 1 after any class.
* Scoring: at most ``CORE`` words, all of a count above a cut, are looked up in
  a table that every task holds; the rest of each text's words go to a join with
  the counts.  Both are exact.
* Training texts are turned into numbers once, in a written table; unit bigrams,
  neighbouring classes and class bigrams are counted from those.

Defined results: a null text counts as empty and has the end token only; with no
training texts every word is unknown, and all classes are equally likely;
repeated rows get equal scores, each its own row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import payload, remainder, tune, written

CORE, TOP_WORDS, ENDINGS, CLASSES = 262_144, 1_024, 512, 64
SWEEPS = 12
#: Words whose class one task finds.
MOVED_WORDS = 4_000
#: Core words take a class by their own neighbours from so many occurrences on.
LEAST_COUNT = 3
#: Weight of the class frequencies in a transition, in tokens.
PULL = 5.0
#: A task hands on its word counts when it holds so many different words.
HELD_WORDS = 400_000
END = b""


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def ending_unit(word: bytes) -> int:
    return 1 + TOP_WORDS + crc32(word[-4:]) % ENDINGS


UNITS = 1 + TOP_WORDS + ENDINGS


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit from the matrix of unit bigrams; unit 0 keeps class 0 to itself."""

    def f(x):
        return x * np.log(np.maximum(x, 1))

    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u]
    of = np.zeros(n, np.int64)
    for rank, u in enumerate(order):
        of[u] = 1 + rank % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    each = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            was, own = of[u], pairs[u, u]
            right = np.bincount(of, pairs[u], classes)
            left = np.bincount(of, pairs[:, u], classes)
            right[was] -= own
            left[was] -= own
            table[was] -= right
            table[:, was] -= left
            table[was, was] -= own
            rows, cols = table.sum(1) + left, table.sum(0) + right  # with what u adds to every class
            gain = (f(table + right[None, :]) - f(table)).sum(1) + (f(table + left[:, None]) - f(table)).sum(0)
            on = table[each, each]
            gain += f(on + right + left + own) + f(on) - f(on + right) - f(on + left)
            gain -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            moved += best != was
            of[u] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += own
        if not moved:
            break
    return of


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def moved(table: np.ndarray, was: np.ndarray, right: np.ndarray, left: np.ndarray, tried: int = 4) -> np.ndarray:
    """The best class of each of several words, each on its own moved within the class bigrams ``table``.

    ``right`` and ``left`` hold, word by word, how often each class follows and
    precedes it; ``was`` is the class that holds these counts in the table.  The
    most likely ``tried`` classes, by the word's counts alone, are compared by the
    exact gain.  A word stays where no class is better, and never joins class 0.
    """
    k = len(table)
    log = np.log(table + 0.5)
    rough = right @ (log - np.log(table.sum(1, keepdims=True) + 0.5 * k)).T + left @ (log - np.log(table.sum(0) + 0.5 * k))
    rough[:, 0] = -np.inf
    was, at = np.asarray(was), np.arange(len(right))
    c = np.concatenate([was[:, None], np.argsort(-rough, axis=1, kind="stable")[:, :tried]], axis=1)
    # the table without the word's counts, at the rows and columns of the classes tried
    stays = c == was[:, None]
    a = table[c] - stays[:, :, None] * right[:, None, :]
    b = table.T[c] - stays[:, :, None] * left[:, None, :]
    r, l = np.take_along_axis(right, c, 1), np.take_along_axis(left, c, 1)
    a[at, :, was] -= l
    b[at, :, was] -= r
    np.maximum(a, 0, out=a)
    np.maximum(b, 0, out=b)
    gain = (_f(a + right[:, None, :]) - _f(a)).sum(2) + (_f(b + left[:, None, :]) - _f(b)).sum(2)
    on = np.maximum(table[c, c] - stays * (r + l), 0)
    gain += _f(on + r + l) + _f(on) - _f(on + r) - _f(on + l)
    for margin, own in ((table.sum(1)[c], right.sum(1)[:, None]), (table.sum(0)[c], left.sum(1)[:, None])):
        rest = np.maximum(margin - stays * own, 0)
        gain -= _f(rest + own) - _f(rest)
    top = gain.argmax(1)
    return np.where(gain[at, top] > gain[:, 0] + 1e-9, c[at, top], was)


@dataclass
class Model:
    counts: DataFrame  # word, n: every training word
    tokens: int
    types: int
    core: list[bytes]  # the words looked up in place
    core_n: np.ndarray
    core_class: np.ndarray
    of: np.ndarray  # class of each unit
    step: np.ndarray  # log10 transition, before x after
    total: np.ndarray  # tokens, discount and log10 of the unknown word, by class
    discount: np.ndarray
    unknown: np.ndarray


class Lookup:
    """What a task needs to turn words into numbers: their place in the core, or its size plus their ending's place."""

    def __init__(self, core: list[bytes]):
        self.at = {w: i for i, w in enumerate(core)}
        self.size = len(core)

    def numbers(self, toks: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """(numbers, positions of the words outside the core)."""
        get = self.at.get
        ids = np.fromiter((get(w, -1) for w in toks), np.int64, len(toks))
        rest = np.flatnonzero(ids < 0).tolist()
        if rest:
            ids[rest] = [self.size + ending_unit(toks[i]) - 1 - TOP_WORDS for i in rest]
        return ids, rest


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()
    names = ["word", "n"]
    for batch in batches:
        for text in batch.column(0).to_pylist():
            toks = words(text)
            total.update(toks)
            total[END] += 1
            if len(total) >= HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names)
                total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names)


def _numbered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value)
        for batch in batches:
            found = [look.numbers(words(text))[0] for text in batch.column(0).to_pylist()]
            cut = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int32)))], ["ids"])

    return run


def chained(batch: pa.RecordBatch, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, kinds) of the texts of a batch one after another, an end (-1, kind 0) before, between and after them."""
    lists = batch.column(0)
    cut = lists.offsets.to_numpy()
    ids = lists.values.to_numpy()[cut[0] : cut[-1]].astype(np.int64)
    ids = np.append(np.insert(ids, cut[:-1] - cut[0], -1), -1)
    return ids, np.append(kind, 0)[ids]


def _cells(count):
    """Tallies ``count(batch)``, arrays of cells, and hands them on summed by cell."""

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(count(batch))
            size += len(held[-1])
            if size > 4_000_000:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)

    return run


def _bigrams(shared, kinds: int):
    """Counts of pairs of kinds; ``shared``: the kind of each number."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        _, kind = chained(batch, shared.value)
        return kind[:-1] * kinds + kind[1:]

    return _cells(count)


def _beside(shared, low: int, high: int):
    """Counts of (number, side, class) for numbers from low up to high: side 0 is what follows; ``shared``: the class of each number."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        ids, kind = chained(batch, shared.value)
        at = np.flatnonzero((ids >= low) & (ids < high))
        return np.concatenate([ids[at] * 2 * CLASSES + kind[at + 1], (ids[at] * 2 + 1) * CLASSES + kind[at - 1]])

    return _cells(count)


def _moves(shared):
    """(id, class) of words from their cells (id, list of cell and count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            cell, n = (x.to_numpy() for x in lists.flatten().flatten())
            beside = np.zeros((len(ids), 2 * CLASSES))
            beside[owner, cell % (2 * CLASSES)] = n
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(moved(table, kind[ids], beside[:, :CLASSES], beside[:, CLASSES:]).astype(np.int32))], ["id", "class"])

    return run


def _classes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, kind = shared.value
        look = Lookup(core)
        for batch in batches:
            toks = batch.column(0).to_pylist()
            c = kind[look.numbers(toks)[0]]
            c[[i for i, w in enumerate(toks) if w == END]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), batch.column(1)], ["class", "n"])

    return run


def fit(docs: DataFrame, keep: Column, text_col: str = "text") -> Model:
    """Learn from the rows of ``docs`` for which ``keep`` holds."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.where(keep).select(payload(text_col).alias("t"))
    counts = written(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    # how many words have each count: a short list, from which the core's cut follows
    by_count = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    tokens, types = sum(n * k for n, k in by_count), sum(k for _, k in by_count)
    cut, so_far = None, 0
    for n, k in by_count:
        so_far += k
        if so_far > CORE:
            break
        cut = n
    core: list[tuple[bytes, int]] = []
    if cut is not None:
        got = counts.where(F.col("n") >= cut).toArrow()
        core = sorted(((w, n) for w, n in zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True) if w != END), key=lambda x: (-x[1], x[0]))
    names, core_n = [w for w, _ in core], np.array([n for _, n in core], np.int64)
    numbered = written(texts.mapInArrow(_numbered(spark.sparkContext.broadcast(names)), "ids array<int>"), "numbers")

    def matrix(kind: np.ndarray, kinds: int) -> np.ndarray:
        cells = numbered.mapInArrow(_bigrams(spark.sparkContext.broadcast(kind), kinds), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(kinds * kinds)
        out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        return out.reshape(kinds, kinds)

    # numbers are the core's words, then the endings
    unit = np.concatenate([[i + 1 if i < TOP_WORDS else ending_unit(w) for i, w in enumerate(names)], 1 + TOP_WORDS + np.arange(ENDINGS)]).astype(np.int64)
    pairs = matrix(unit, UNITS)
    of = exchange(pairs)
    kind = of[unit]
    low, high = min(TOP_WORDS, len(names)), int((core_n >= LEAST_COUNT).sum())
    if high > low:
        table = np.zeros((CLASSES, CLASSES))
        np.add.at(table, (of[:, None], of[None, :]), pairs)
        beside = numbered.mapInArrow(_beside(spark.sparkContext.broadcast(kind), low, high), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        beside = beside.withColumn("id", F.expr(f"cell div {2 * CLASSES}")).repartition(1 + (high - low) // MOVED_WORDS, "id").groupBy("id").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # up to 2 * CLASSES for each word
        better = beside.mapInArrow(_moves(spark.sparkContext.broadcast((table, kind))), "id long, class int").toArrow()
        kind = kind.copy()
        kind[better.column("id").to_numpy()] = better.column("class").to_numpy()
    table = matrix(kind, CLASSES)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * CLASSES)
    step = np.log10((table + PULL * share) / (table.sum(1, keepdims=True) + PULL))
    stats = counts.mapInArrow(_classes(spark.sparkContext.broadcast((names, kind))), "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
    total, v, n1, n2 = np.zeros((4, CLASSES))
    for r in stats:
        total[r["class"]], v[r["class"]], n1[r["class"]], n2[r["class"]] = r.n, r.v, r.n1, r.n2
    open_class = np.zeros(CLASSES, bool)
    open_class[of[1 + TOP_WORDS :]] = True  # unknown words can only fall here
    discount = np.where(open_class, np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05, 0.95), 0.0)
    with np.errstate(divide="ignore"):
        unknown = np.where(total > 0, np.log10(discount * v / np.maximum(total, 1)), 0.0)
    return Model(counts, tokens, types, names, core_n, kind[: len(names)], of, step, total, discount, unknown)


def score(model: Model, docs: DataFrame, columns: dict[str, Column], text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``columns``, then ``n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    spark = docs.sparkSession
    tune(spark)
    base_of = -np.log10(model.tokens + model.types + 1)
    core_class = model.core_class
    none = np.zeros(ENDINGS)
    core_base = np.append(np.log10(model.core_n + 1.0) + base_of, none)
    core_score = np.append(np.log10(np.maximum(model.core_n - model.discount[core_class], 1e-9)) - np.log10(np.maximum(model.total[core_class], 1)), none)
    end = model.tokens and int(model.total[0])
    end_base, end_known = float(np.log10(end + 1.0) + base_of), int(end > 0)
    shared = spark.sparkContext.broadcast((model.core, np.append(core_class, model.of[1 + TOP_WORDS :]), core_base, core_score, model.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, class_of, base, emit, step = shared.value
        look = Lookup(core)
        for batch in batches:
            rows, bag, bag_n, bag_c, cuts = [], [], [], [], [0]
            for text in batch.column(0).to_pylist():
                toks = words(text)
                ids, rest = look.numbers(toks)
                kinds = np.concatenate([[0], class_of[ids], [0]])
                rows.append((len(toks) + 1, len(toks) - len(rest) + end_known, float(base[ids].sum()) + end_base, float(step[kinds[:-1], kinds[1:]].sum() + emit[ids].sum())))
                tail = Counter([toks[i] for i in rest])
                kind = {toks[i]: int(kinds[i + 1]) for i in rest}
                bag += tail.keys()
                bag_n += tail.values()
                bag_c += [kind[w] for w in tail]
                cuts.append(len(bag))
            cut = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, t)) for x, t in ((bag, pa.binary()), (bag_n, pa.int32()), (bag_c, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], *lists], [*batch.schema.names[1:], "n_tokens", "n_known", "base_score", "score", "rv_word", "rv_n", "rv_class"])

    source = docs.select(payload(text_col).alias("rv_text"), *[c.alias(k) for k, c in columns.items()])
    shape = source.drop("rv_text").schema
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("rv_word", T.ArrayType(T.BinaryType())), ("rv_n", T.ArrayType(T.IntegerType())), ("rv_class", T.ArrayType(T.IntegerType()))):
        shape = shape.add(name, kind)
    scored = written(source.mapInArrow(run, shape).withColumn("rv_row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("rv_row", F.explode(F.arrays_zip("rv_word", "rv_n", "rv_class")).alias("x")).select("rv_row", F.col("x.rv_word").alias("word"), F.col("x.rv_n").alias("times"), F.col("x.rv_class").alias("c"))
    tail = tail.join(model.counts, "word", "left")
    by_class = lambda values: F.get(F.array(*[F.lit(float(max(v, -1e300))) for v in values]), F.col("c"))
    known = F.col("n").isNotNull()
    emitted = F.when(known, F.log10(F.col("n") - by_class(model.discount)) - by_class(np.log10(np.maximum(model.total, 1)))).otherwise(by_class(model.unknown))
    tail = tail.groupBy("rv_row").agg(F.sum(F.when(known, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * (F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0) + float(base_of))).alias("base_score"), F.sum(F.col("times") * emitted).alias("score"))
    names = list(columns)
    out = scored.select("rv_row", *names, "n_tokens", "n_known", "base_score", "score").join(tail.select("rv_row", F.col("n_known").alias("rv_k"), F.col("base_score").alias("rv_b"), F.col("score").alias("rv_s")), "rv_row", "left")
    both = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = out.select(*names, "n_tokens", both("n_known", "rv_k").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), both("base_score", "rv_b").alias("base_score"), both("score", "rv_s").alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def training_rows(id_col: str = "doc_id") -> Column:
    """The contract's training rows: crc32 of the id modulo 7 is not 2."""
    return remainder(id_col, 7) != 2
