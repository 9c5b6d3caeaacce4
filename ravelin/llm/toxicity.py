"""Toxicity: a convolutional text classifier, trained on Spark over all labelled rows.

Words (ASCII lower case, split at ASCII blanks and punctuation) are hashed to
rows of an embedding, each word to one row for itself and one for each of three
lengths of beginning, so that inflected forms share what is learnt; filters of
several widths run over the sequence, each filter keeps its maximum over the
whole text, and a logistic layer turns the maxima into a score.

Every labelled row is learnt from.  Rows are dealt by the hash of their id into
parts of about ``PART_ROWS``; in each round a task passes over each part by Adam,
from the parameters of the round before, and what the parts have changed is
averaged on the cluster by blocks of parameters: an embedding row by how often each part has
met it, the rest by rows.  A single part is passed over in one round.  Scores are
calibrated by Platt scaling on held-back labelled rows, and a threshold per
language is chosen on the same rows: all of them, counted by their logits in
thousandths.

Scoring reads whole texts.  Because a filter is linear, its taps are multiplied
into the embedding once per model, so that a text costs one table row per word
and tap; texts are scored in runs of ``RUN_WORDS`` words that overlap by the
widest filter, so memory does not grow with the length of a text.

Defined results: null text scores as the empty text; an empty text has no
words and gets the score of a padding-only sequence; repeated rows get equal
scores.  The language only picks the threshold of ``flag``; a language without
its own threshold (too few labelled rows, or null) takes the global one.
Training needs both classes: with one class or no rows every score is that
class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import forget, remainder, tune, written

#: Learning rows of a part, and bytes of their words that a task works on at a time.
PART_ROWS, PART_BYTES = 16_384, 32 << 20
#: So many labels are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: A quarter of the rows (by hash) is held back for calibration and thresholds.
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 12, 8, (1, 2, 3)
#: Small parts are passed over more often, for about so many steps; none less or more often than this.
STEPS, PASSES = 600, (4, 60)
#: Embedding rows that are averaged together.
BLOCK = 1_024
#: Share of embedding rows left out at random in training.
DROP = 0.6
#: Lengths in bytes of the beginnings.
BEGINNINGS = (4, 6, 8)
RUN_WORDS = 50_000
#: A language takes a threshold of its own from so many held-back rows on.
LANG_ROWS = 40

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: bytes) -> np.ndarray:
    """Embedding rows (whole word, its beginnings) of a text's words; 0 is padding."""
    w = text.translate(_PLAIN).split()
    out = np.empty((len(w), 1 + len(BEGINNINGS)), np.int64)
    out[:, 0] = [crc32(x) for x in w]
    for i, k in enumerate(BEGINNINGS):
        out[:, i + 1] = [crc32(x[:k], k) for x in w]
    out %= BUCKETS - 1
    out += 1
    return out


def _padding(n: int) -> np.ndarray:
    return np.zeros((n, 1 + len(BEGINNINGS)), np.int64)


@dataclass
class Model:
    taps: np.ndarray  # rows x (taps of all widths x filters): embedding times filter taps
    bias: np.ndarray  # of each filter
    weight: np.ndarray
    intercept: float
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)
    constant: float | None = None

    def maxima(self, texts: list[np.ndarray]) -> np.ndarray:
        """The maximum of every filter over each text."""
        out = np.full((len(texts), len(SPANS) * FILTERS), -np.inf, np.float32)
        run: list[np.ndarray] = []
        owner: list[int] = []
        own: list[int] = []
        size = 0
        edge = max(SPANS) - 1

        def flush() -> None:
            nonlocal size
            if not run:
                return
            pad = _padding(edge)
            ids = np.concatenate([x for r in run for x in (r, pad)])
            starts = np.cumsum([0, *(len(r) + edge for r in run[:-1])])
            n = len(ids) - edge
            at, full = 0, self.taps[ids[:, 0]]
            for i in range(1, ids.shape[1]):
                full += self.taps[ids[:, i]]
            conv = np.empty((n, len(SPANS) * FILTERS), np.float32)
            for s, span in enumerate(SPANS):
                part = conv[:, s * FILTERS : (s + 1) * FILTERS]
                part[:] = self.bias[s * FILTERS : (s + 1) * FILTERS]
                for j in range(span):
                    part += full[j : j + n, at : at + FILTERS]
                    at += FILTERS
            # windows begin at a part's own words, not in the overlap or padding after them
            bounds = np.stack([starts, starts + own], axis=1).ravel()
            top = np.maximum.reduceat(conv, bounds if bounds[-1] < n else bounds[:-1], axis=0)[::2]
            np.maximum.at(out, owner, top)
            run.clear()
            owner.clear()
            own.clear()
            size = 0

        for i, ids in enumerate(texts):
            for at in range(0, max(1, len(ids)), RUN_WORDS):
                part = ids[at : at + RUN_WORDS + edge] if len(ids) else _padding(1)
                run.append(part)
                owner.append(i)
                own.append(max(1, min(RUN_WORDS, len(ids) - at)))
                size += len(part)
                if size >= RUN_WORDS:
                    flush()
        flush()
        return np.maximum(out, 0)  # rectified

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.maxima(texts) @ self.weight + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * z + self.platt[1], -35, 35)))


def _share(up: float, n: float) -> float:
    return float((up + 1) / (n + 2))


def _begun(seed: int) -> dict[str, np.ndarray]:
    """The parameters before training: embedding, filter taps, bias of each filter, logistic layer."""
    rng = np.random.default_rng(seed)
    par = {
        "e": rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32),
        "k": rng.normal(0, 0.4, (WIDTH, sum(SPANS) * FILTERS)).astype(np.float32),
        "b": np.zeros(len(SPANS) * FILTERS, np.float32),
        "w": rng.normal(0, 0.3, len(SPANS) * FILTERS).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }
    par["e"][0] = 0
    return par


class _Adam:
    """Steps over mini-batches from given parameters, which are changed in place."""

    def __init__(self, par: dict[str, np.ndarray], seed: list[int]) -> None:
        self.par, self.rng, self.step = par, np.random.default_rng(seed), 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2))
        self.met = np.zeros(BUCKETS)  # how often each embedding row was in a batch
        self.place = np.zeros(BUCKETS, np.int64)  # and its place among those of the batch

    def passed(self, ids: list[np.ndarray], y: np.ndarray, balance: tuple[float, float], size: int, rate: float) -> None:
        """One pass over the texts in random order; ``balance`` weights clean and toxic ones."""
        par, mean, square, edge = self.par, self.mean, self.square, max(SPANS) - 1
        for batch in np.array_split(self.rng.permutation(len(ids)), max(1, len(ids) // size)):
            flat = np.concatenate([x for i in batch for x in (ids[i] if len(ids[i]) else _padding(1), _padding(edge))])
            flat[self.rng.random(flat.shape, np.float32) < DROP] = 0
            starts = np.cumsum([0, *(max(1, len(ids[i])) + edge for i in batch[:-1])])
            ends = np.append(starts[1:], len(flat))
            often = np.bincount(flat.ravel(), minlength=BUCKETS)
            self.met += often
            known = np.flatnonzero(often)
            self.place[known] = np.arange(len(known))
            table = par["e"][known] @ par["k"]
            inverse = self.place[flat]
            n, at, full = len(flat) - edge, 0, table[inverse[:, 0]]
            for i in range(1, inverse.shape[1]):
                full += table[inverse[:, i]]
            best = np.empty((len(batch), len(SPANS) * FILTERS), np.int64)
            value = np.empty(best.shape, np.float32)
            for s, span in enumerate(SPANS):
                conv = np.tile(par["b"][s * FILTERS : (s + 1) * FILTERS], (n, 1))
                for j in range(span):
                    conv += full[j : j + n, at : at + FILTERS]
                    at += FILTERS
                for d, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    m = conv[a : min(b - edge, n)].argmax(0)
                    best[d, s * FILTERS : (s + 1) * FILTERS] = a + m
                    value[d, s * FILTERS : (s + 1) * FILTERS] = conv[a + m, np.arange(FILTERS)]
            h = np.maximum(value, 0)
            z = h @ par["w"] + par["c"][0]
            dz = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[batch]) * np.where(y[batch] > 0, balance[1], balance[0]) / len(batch)).astype(np.float32)
            dh = np.outer(dz, par["w"]) * (value > 0)
            grad = {"w": h.T @ dz + 1e-4 * par["w"], "c": np.array([dz.sum()], np.float32), "b": dh.sum(0)}
            dk, de, at = np.zeros_like(par["k"]), np.zeros((len(known), WIDTH), np.float32), 0
            for s, span in enumerate(SPANS):
                cols = np.arange(s * FILTERS, (s + 1) * FILTERS)
                for j in range(span):
                    where = inverse[best[:, cols] + j]  # rows of the word under this tap
                    kernel = par["k"][:, at : at + FILTERS]
                    for f in range(FILTERS):
                        g = dh[:, cols[f]]
                        rows = where[:, f]
                        dk[:, at + f] = g @ par["e"][known[rows]].sum(1)
                        np.add.at(de, rows, np.outer(g, kernel[:, f])[:, None, :])
                    at += FILTERS
            grad["k"] = dk
            self.step += 1
            fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for name, g in grad.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                par[name] -= rate * fix * mean[name] / (np.sqrt(square[name]) + 1e-7)
            rows = known[known > 0]
            g = de[known > 0]
            mean["e"][rows] += 0.1 * (g - mean["e"][rows])
            square["e"][rows] += 0.001 * (g * g - square["e"][rows])
            par["e"][rows] -= rate * fix * mean["e"][rows] / (np.sqrt(square["e"][rows]) + 1e-7)


def _rate(done: int, passes: int) -> float:
    return 0.02 * (1 - done / passes) + 0.001


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint16).reshape(-1, 1 + len(BEGINNINGS)).astype(np.int64)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint16).tobytes()


#: The parameters that all rows share, in the order in which they are sent.
_DENSE = ("k", "b", "w", "c")


def _changes(base: dict, adam: _Adam, part: int, rows: int) -> pd.DataFrame:
    """What a part has changed, times its weights, by blocks of the embedding and one (-1) of all else; the weights come first."""
    dense = np.concatenate([(adam.par[k] - base[k]).ravel() for k in _DENSE])
    out = {-1: np.append(np.float32(rows), rows * dense)}
    for at in range(0, BUCKETS, BLOCK):
        met = adam.met[at : at + BLOCK, None]
        if met.any():
            out[at] = np.hstack([met, met * (adam.par["e"][at : at + BLOCK] - base["e"][at : at + BLOCK])])
    return pd.DataFrame({"block": list(out), "part": part, "sums": [v.astype(np.float32).tobytes() for v in out.values()]})


def _trained(batches: Iterator[pd.DataFrame], base: dict, seed: int, rounds: range, passes: int, size: int, balance: tuple[float, float]) -> Iterator[pd.DataFrame]:
    """The changes of each part after the passes ``rounds`` of ``passes``; rows of a part follow each other."""
    held: list[tuple[np.ndarray, int]] = []
    part, adam, rows, room = None, None, 0, PART_BYTES

    def work() -> None:
        nonlocal room
        if held:
            ids, y = [x for x, _ in held], np.array([v for _, v in held], np.float32)
            for done in rounds:
                adam.passed(ids, y, balance, size, _rate(done, passes))
        held.clear()
        room = PART_BYTES

    for frame in batches:
        for p, y, packed in zip(frame["part"], frame["y"], frame["ids"], strict=True):
            if p != part:
                work()
                if rows:
                    yield _changes(base, adam, part, rows)
                part, rows = p, 0
                adam = _Adam({k: v.copy() for k, v in base.items()}, [seed, rounds.start, int(p)])
            held.append((_ids(packed), y))
            rows += 1
            room -= len(packed)
            if room < 0:
                work()
    work()
    if rows:
        yield _changes(base, adam, part, rows)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """The sum of the changes of one block, part by part."""
    parts = frame.sort_values("part")["sums"]
    total = np.sum([np.frombuffer(v, np.float32).astype(np.float64) for v in parts], axis=0)
    return pd.DataFrame({"block": [frame["block"].iat[0]], "sums": [total.tobytes()]})


def _averaged(par: dict[str, np.ndarray], sums: list) -> dict[str, np.ndarray]:
    """The parameters moved by the average of the changes."""
    out = {k: v.copy() for k, v in par.items()}
    for r in sums:
        v = np.frombuffer(r.sums)
        if r.block < 0:
            moved, at = v[1:] / v[0], 0
            for k in _DENSE:
                out[k] += moved[at : at + out[k].size].reshape(out[k].shape).astype(np.float32)
                at += out[k].size
        else:
            v = v.reshape(-1, 1 + WIDTH)
            out["e"][r.block : r.block + BLOCK] += (v[:, 1:] / np.maximum(v[:, :1], 1)).astype(np.float32)
    return out


def _platt(z: np.ndarray, y: np.ndarray, stands: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with Platt's smoothed targets, by Newton steps; each value stands for ``stands`` rows."""
    stands = np.ones(len(y)) if stands is None else stands
    up, n = (y * stands).sum(), stands.sum()
    stands = stands * (len(y) / n)
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        m = a * z + b
        return float((stands * (np.logaddexp(0, m) - goal * m)).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        off = stands * (p - goal)
        g = np.array([(z * off).sum(), off.sum()])
        w = stands * p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        here, size = loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * d[0], b - size * d[1]) > here:  # a whole step may overshoot
            size /= 2
        a, b = a - size * d[0], b - size * d[1]
    return float(max(a, 1e-3)), float(b)


def _best_cut(p: np.ndarray, y: np.ndarray, stands: np.ndarray | None = None) -> float:
    """The cut with the best F1, halfway between neighbouring scores; ``stands`` weights the rows."""
    order = np.argsort(-p, kind="stable")
    stands = np.ones(len(y)) if stands is None else stands[order]
    p, y = p[order], y[order]
    hit = np.cumsum(y * stands)
    f1 = 2 * hit / (np.cumsum(stands) + hit[-1])
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal scores
    i = int(f1.argmax())
    return float((p[i] + p[i + 1]) / 2) if i + 1 < len(p) else float(p[i] / 2)


def _thresholds(model: Model, p: np.ndarray, y: np.ndarray, langs: list, stands: np.ndarray, rows: np.ndarray) -> None:
    """``rows``: of how many held-back rows each value comes; ``stands``: for how many labelled rows these stand."""
    model.thresholds[None] = _best_cut(p, y, stands)
    names = np.array([x or "" for x in langs])
    for lang in sorted(set(names) - {""}):
        own = names == lang
        if rows[own].sum() >= LANG_ROWS and 0 < y[own].sum() < own.sum():
            model.thresholds[str(lang)] = _best_cut(p[own], y[own], stands[own])


def _learning(docs: DataFrame, named: DataFrame, n: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``part, y, l, held, ids`` of the labelled texts (named: i, y), rows of a part together; of rows with equal ids the smallest text."""

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[["part", "y", "l"]].assign(held=[crc32(t) % 4 == 0 for t in frame["t"]], ids=[_packed(words(t)) for t in frame["t"]])

    parts = max(1, -(-n // PART_ROWS))
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), lang.cast("string").alias("l"))
    texts = texts.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, "i").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    one = texts.repartition(parts, "part").groupBy("part", "i").agg(F.min(F.struct("t", "l", "y")).alias("x"))
    return written(one.sortWithinPartitions("part", "i").select("part", "x.*").mapInPandas(numbered, "part int, y int, l string, held boolean, ids binary"), "learning")


def fit(docs: DataFrame, labels: DataFrame, keep: Column, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", seed: int = 7) -> Model:
    """Learn from all labelled rows for which ``keep`` (over ``labels``) holds.

    The driver gets the parameters (a constant number) once a round, and how many
    held-back rows of each language and class have each logit.  A caller may ask
    for ``rows`` of each class only (those with the smallest hash of their id); each
    then stands for as many labelled rows as it was drawn from.
    """
    spark = docs.sparkSession
    tune(spark)
    named = labels.where(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(label_col) > 0).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    named = written(named, "labelled")
    total = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if rows is not None:
        order = [F.xxhash64("i"), "i"]
        named = named.where("y = 1").orderBy(*order).limit(rows).unionByName(named.where("y = 0").orderBy(*order).limit(rows))
    taken = {y: n if rows is None else min(n, rows) for y, n in total.items()}
    table = _learning(docs, named, sum(taken.values()), id_col, text_col, lang_col)
    counts = {(r.held, r.y): r for r in table.groupBy("held", "y").agg(F.count("*").alias("n"), F.sum(F.length("ids")).alias("bytes")).collect()}
    of = lambda y, held: sum(r.n for (h, v), r in counts.items() if v == y and h in held)
    up, n = of(1, (True, False)), of(0, (True, False)) + of(1, (True, False))
    if up in (0, n):
        return Model(np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, constant=_share(up, n))
    apart = all(of(y, (h,)) for y in (0, 1) for h in (True, False))
    learnt, check = (table.where("not held"), table.where("held")) if apart else (table, table)
    clean, toxic = (of(y, (False,) if apart else (True, False)) for y in (0, 1))
    balance = ((clean + toxic) / (2 * clean), (clean + toxic) / (2 * toxic))
    parts = max(1, -(-sum(taken.values()) // PART_ROWS))
    each = (clean + toxic) // parts
    size = 64 if each > 1500 else 16
    passes = max(PASSES[0], min(PASSES[1], -(-STEPS * size // max(1, each))))
    whole = parts == 1 and sum(r.bytes for r in counts.values()) <= PART_BYTES
    par = _begun(seed)
    for at in range(1 if whole else passes):
        shared = spark.sparkContext.broadcast(par)
        rounds = range(passes) if whole else range(at, at + 1)
        changes = learnt.select("part", "y", "ids").mapInPandas(lambda b, shared=shared, rounds=rounds: _trained(b, shared.value, seed, rounds, passes, size, balance), "block int, part int, sums binary")
        par = _averaged(par, changes.groupBy("block").applyInPandas(_summed, "block int, sums binary").collect())
        shared.destroy()
    model = Model(par["e"] @ par["k"], par["b"], par["w"], float(par["c"][0]))
    shared = spark.sparkContext.broadcast(model)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in batches:
            z = m.maxima([_ids(x) for x in frame["ids"]]) @ m.weight + m.intercept
            yield frame[["l", "y"]].assign(z=np.rint(z.astype(np.float64) * 1000).astype(np.int64))

    found = check.select("l", "y", "ids").mapInPandas(logits, "l string, y int, z long").groupBy("l", "y", "z").agg(F.count("*").alias("n")).orderBy("l", "y", "z").collect()
    shared.destroy()
    forget(table)
    z, y, many = np.array([r.z for r in found]) / 1000, np.array([float(r.y) for r in found]), np.array([float(r.n) for r in found])
    stands = many * np.where(y > 0, total[1] / taken[1], total[0] / taken[0])
    model.platt = _platt(z, y, stands)
    _thresholds(model, 1 / (1 + np.exp(-np.clip(model.platt[0] * z + model.platt[1], -35, 35))), y, [r.l for r in found], stands, many)
    return model


def score(model: Model, text: Column, spark) -> Column:
    """The calibrated probability that a text is toxic."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.score([words(t) for t in texts]))

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def flag(model: Model, score_col: Column, lang: Column) -> Column:
    """Whether a score reaches its language's threshold."""
    own = {k: v for k, v in model.thresholds.items() if k is not None}
    cut = F.lit(model.thresholds.get(None, 0.5))
    for k, v in sorted(own.items()):
        cut = F.when(lang.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(cut)
    return score_col >= cut


def training_rows(labels_id: str = "doc_id") -> Column:
    """The contract's learning rows: crc32 of the id modulo 3 is not 1."""
    return remainder(labels_id, 3) != 1
