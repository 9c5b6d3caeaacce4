"""Quality classifier: random Fourier features, ridge, isotonic calibration.

A text becomes a fixed vector of statistics (shares of character classes, word
and sentence shape, repetition).  Random cosines of the standardised vector
approximate a Gaussian kernel; ridge weights come from normal equations that
every partition sums for its own rows, so the driver only adds one bounded
matrix per partition; an isotonic (pool-adjacent-violators) map, fitted on
rows kept out of the ridge fit, turns ridge outputs into probabilities.

Defined results: null text counts as the empty text, whose statistics are all
zero and which is scored like any other; repeated rows get equal scores, and of
rows with equal ids the smallest text is learnt from; with
no learning rows every score is 0.5; with one class the smoothed share of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import remainder, tune, written

#: At most so many labelled rows are learnt from, those with the smallest hash of their id.
TRAIN_ROWS = 12_000
#: Number of random features, kernel width in standard deviations, ridge penalty per row.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-4
#: Partitions of the learning rows; each sends one (FEATURES + 2)^2 matrix.
PARTS = 8

_KIND = np.zeros((8, 256), np.float64)
for _b in range(256):
    _c = chr(_b)
    _KIND[0, _b] = _b >= 128
    _KIND[1, _b] = 97 <= _b <= 122
    _KIND[2, _b] = 65 <= _b <= 90
    _KIND[3, _b] = 48 <= _b <= 57
    _KIND[4, _b] = _c in ".,;:"
    _KIND[5, _b] = _c in "!?"
    _KIND[6, _b] = 33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:!?"
    _KIND[7, _b] = _b in (9, 10, 11, 12, 13)
STATISTICS = 24


def statistics(text: bytes) -> np.ndarray:
    """The vector of one whole text, all zero for an empty one."""
    out = np.zeros(STATISTICS)
    n = len(text)
    if not n:
        return out
    out[:8] = _KIND @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    w = text.split()
    lines = text.split(b"\n")
    m = max(1, len(w))
    size = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    low = text.lower().split()
    seen = len(set(low))
    pairs = len(set(zip(low, low[1:], strict=False)))
    out[8] = np.log1p(n) / 10
    out[9] = np.log1p(len(w)) / 10
    out[10] = size.mean() / 10
    out[11] = size.std() / 10
    out[12] = seen / m
    out[13] = np.log1p(seen) / np.log1p(m)
    out[14] = pairs / max(1, len(w) - 1) if len(w) > 1 else 1
    out[15] = len(set(lines)) / len(lines)
    out[16] = np.log1p(n / len(lines)) / 10
    out[17] = (size <= 1).mean()
    out[18] = (size <= 3).mean()
    out[19] = (size > 15).mean()
    out[20] = sum(map(bytes.isupper, w)) / m
    out[21] = sum(map(bytes.isalpha, w)) / m
    out[22] = text.count(b". ") / m + text.count(b".\n") / m
    out[23] = sum(a == b for a, b in zip(low, low[1:], strict=False)) / m
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    steps: np.ndarray  # ridge outputs at which the isotonic map has values
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.project + self.phase) * np.sqrt(2 / self.project.shape[1]), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step fit of y on x, as knots for interpolation.

    Each pool's value is smoothed by half a row of either class, so that no score is exactly 0 or 1.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    pools: list[list[float]] = []  # sum, rows, first x, last x
    for a, b in zip(x, y, strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots = np.array([k for p in pools for k in ((p[2], p[3]))])
    values = np.array([v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1)] * 2])
    return knots, np.maximum.accumulate(values)


def _moments(batches, model: Model) -> Iterator[pd.DataFrame]:
    """One row: the summed outer products of (cosines, label) of this partition's ridge rows."""
    d = len(model.phase) + 2
    total = np.zeros((d, d))
    for frame in batches:
        if len(frame):
            a = np.column_stack([model.cosines(np.stack(frame["x"])), frame["y"].to_numpy(float)])
            total += a.T @ a
    yield pd.DataFrame({"m": [total.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11) -> Model:
    """Learn from at most ``rows`` labelled rows for which ``keep`` (over ``labels``) holds."""
    spark = docs.sparkSession
    tune(spark)
    named = labels.where(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(label_col) > 0).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    some = named.orderBy(F.xxhash64("i"), "i").limit(rows).collect()
    picked = spark.createDataFrame(pd.DataFrame({"i": pd.Series([r.i for r in some], dtype=object), "y": pd.Series([r.y for r in some], dtype="int64")}), T.StructType([T.StructField("i", labels.schema[id_col].dataType), T.StructField("y", T.LongType())]))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"i": frame["i"], "y": frame["y"], "held": [crc32(t) % 4 == 0 for t in frame["t"]], "x": [statistics(t) for t in frame["t"]]})

    kind = docs.schema[id_col].dataType
    rows_of = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).join(F.broadcast(picked), "i")
    # one row for each id, however often the table repeats it
    rows_of = rows_of.groupBy("i").agg(F.min(F.struct("t", "y")).alias("x")).select("i", "x.t", "x.y")
    rows_of = rows_of.mapInPandas(measured, T.StructType([T.StructField("i", kind), T.StructField("y", T.LongType()), T.StructField("held", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    # the bounded sample, so that the normal equations and the calibration read it without measuring texts again
    rows_of = written(rows_of.repartition(PARTS, "i"), "measured")
    rng = np.random.default_rng(seed)
    got = rows_of.select(F.count("*").alias("n"), F.sum("y").alias("up"), *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(STATISTICS)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(STATISTICS)]).first()
    flat = 0.5 if not got.n else (got.up + 1) / (got.n + 2)
    mean = np.array([got[f"m{k}"] or 0.0 for k in range(STATISTICS)])
    scale = np.array([got[f"s{k}"] or 0.0 for k in range(STATISTICS)])
    scale[scale < 1e-9] = 1.0
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([flat]))
    if got.n and 0 < got.up < got.n:
        shared = spark.sparkContext.broadcast(model)
        d = FEATURES + 2
        total = sum((np.frombuffer(r.m).reshape(d, d) for r in rows_of.where("not held").mapInPandas(lambda b: _moments(b, shared.value), "m binary").toLocalIterator()), np.zeros((d, d)))
        n = total[-2, -2]
        model.weight = np.linalg.solve(total[:-1, :-1] + RIDGE * max(n, 1) * np.eye(d - 1), total[:-1, -1])
        check = rows_of.where("held").select("x", "y").collect() or rows_of.select("x", "y").collect()
        out = model.raw(np.array([r.x for r in check]))
        model.steps, model.values = isotonic(out, np.array([float(r.y) for r in check]))
    return model


def score(model: Model, text: Column, spark) -> Column:
    """The calibrated probability that a text's quality label is 1."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def training_rows(labels_id: str = "doc_id") -> Column:
    """The contract's learning rows: crc32 of the id modulo 4 is not 2."""
    return remainder(labels_id, 4) != 2
