"""Ranked lexical search by Block-Max WAND over a compressed inverted index.

Terms are the runs of letters and digits of a text and of all that is not ASCII,
lower-case as to ASCII letters.  A document's score for a query is the sum, over
the query's distinct terms, of ``weight * impact``:

* ``impact = 1000000000 * tf div (1000 * tf + 8 * m)`` with
  ``m = 10 + 90 * n * N div L``: what the term says of the document;
* ``weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``: how rare the term is.

N documents have a term, L terms in all with repeats, n are the document's; df
documents hold the term, tf times in this one.  All but the logarithm is 64-bit
integer arithmetic.

* Documents are dealt into shards of up to SHARD_TERMS terms as they are read,
  each with its own index.  A term's postings are cut into blocks of BLOCK
  documents; a block's directory entry holds its first and last document and its
  largest impact, and its payload the gaps and frequencies in as few bytes each
  as the block needs.  The index is a table in the shared folder.
* A shard answers a query document by document, in the order of ids.  The terms'
  cursors are sorted by the document where they stand; the pivot is the first
  where the largest impacts of the lists up to there could reach the score
  needed.  Then the cursors move shallowly, in the directories alone, to the
  pivot's blocks: if the largest impacts of these cannot reach the score either,
  all go on behind the nearest end of a block, and what lies between is never
  decompressed.  Else the blocks are read and the document is scored.
* The score needed is the k-th best so far.  Shards answer in ROUNDS, and the
  k-th best scores of the rounds before are where the next begins, which leaves
  most of its blocks unread.  Nothing is approximate: a shard may leave out what
  cannot be among the k best, only.
* A shard's postings go to one task together with the queries that have these
  terms; queries are dealt into blocks of up to QUERY_TERMS terms.

Defined results: a null or empty text has no term and is never found, a query
without terms finds nothing; rows repeated under one id are ranked each, rows
repeated under one query id each have a ranking of their own, and null ids come
last among equals; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappush, heapreplace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import tune, written

BEST = 10
BLOCK = 128
#: Terms and documents of a shard, at most (a longer text is a shard of its own).
SHARD_TERMS, SHARD_DOCS = 4_000_000, 32_768
#: Terms of the queries that a task answers at once.
QUERY_TERMS = 200_000
#: Shards answer in rounds: those with a hash below these eighths, one round after the other.
ROUNDS = (1, 4, 8)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_ENTRY = np.dtype([("first", "<i4"), ("last", "<i4"), ("peak", "<i8"), ("start", "<i4"), ("gap", "u1"), ("tf", "u1")])
_WIDTHS = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}
_NOWHERE = 1 << 62


def terms(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def lowered(text: Column) -> Column:
    """ASCII letters lower-case."""
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())


def length(n, n_docs: int, n_terms: int):
    """m of a document of n terms."""
    return 10 + 90 * n * n_docs // n_terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# -- the index of a shard


def _bytes_of(v: np.ndarray) -> np.ndarray:
    return np.where(v < 256, 1, np.where(v < 65536, 2, 4))


def _spread(values: np.ndarray, widths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Little-endian bytes of the values, each of its width, from ``at`` on."""
    for k in range(4):
        there = widths > k
        out[at[there] + k] = values[there] >> (8 * k) & 255


def build(term_of: np.ndarray, doc_of: np.ndarray, m: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(df, entries of a term begin at, entries, bytes of a term begin at, bytes) of the occurrences of term numbers in documents."""
    both = np.sort(term_of.astype(np.int64) << 32 | doc_of.astype(np.int64))
    new = np.flatnonzero(np.diff(both, prepend=-1))
    tf = np.diff(np.append(new, len(both)))
    both = both[new]
    term, doc = both >> 32, both & 0xFFFFFFFF
    df = np.bincount(term, minlength=n_terms)
    begins = np.cumsum(df) - df
    place = np.arange(len(term)) - begins[term]
    heads = np.flatnonzero(place % BLOCK == 0)  # first posting of each block
    sizes = np.diff(np.append(heads, len(term)))
    block = np.repeat(np.arange(len(heads)), sizes)
    gap = np.diff(doc, prepend=0)
    gap[heads] = 0  # the first document of a block stands in the directory
    entries = np.zeros(len(heads), _ENTRY)
    entries["first"], entries["last"] = doc[heads], doc[heads + sizes - 1]
    entries["peak"] = np.maximum.reduceat(impact(tf, m[doc]), heads)
    wide, wide_tf = _bytes_of(np.maximum.reduceat(gap, heads)), _bytes_of(np.maximum.reduceat(tf, heads))
    entries["gap"], entries["tf"] = wide, wide_tf
    ends = np.cumsum(sizes * (wide + wide_tf))
    starts = ends - sizes * (wide + wide_tf)
    payload = np.empty(int(ends[-1]), np.uint8)
    inside = np.arange(len(term)) - heads[block]
    _spread(gap, wide[block], starts[block] + inside * wide[block], payload)
    _spread(tf, wide_tf[block], starts[block] + sizes[block] * wide[block] + inside * wide_tf[block], payload)
    blocks_of = -(-df // BLOCK)
    first_block = np.cumsum(blocks_of) - blocks_of
    byte_of = np.append(starts, ends[-1])[np.append(first_block, len(heads))]
    entries["start"] = starts - byte_of[np.repeat(np.arange(n_terms), blocks_of)]
    return df, np.append(first_block, len(heads)), entries, byte_of, payload


_SHAPE = "shard long, term binary, df long, entries binary, postings binary"


def _indexed(n_docs: int, n_terms: int):
    """Rows of the shards: one per term, and one without a term that holds the documents (ids, nulls and m)."""
    shape = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("entries", pa.binary()), ("postings", pa.binary())])

    def shard(key: int, ids: list, docs: list[np.ndarray], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        sizes = np.array([len(docs[k]) for k in order], np.int64)
        m = length(sizes, n_docs, n_terms)
        doc_of = np.repeat(np.arange(len(order)), sizes)
        df, block_at, entries, byte_at, payload = build(np.concatenate([docs[k] for k in order]), doc_of, m, len(known))
        own = np.array([ids[k] or 0 for k in order], np.int64)
        gone = np.array([ids[k] is None for k in order], np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([None], pa.binary()), pa.array([len(order)]), pa.array([own.tobytes() + gone.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], schema=shape)
        words, flat, packed = list(known), entries.view(np.uint8), _ENTRY.itemsize
        for a in range(0, len(words), 50_000):
            b = min(a + 50_000, len(words))

            def column(at: np.ndarray, data: np.ndarray, a=a, b=b) -> pa.Array:
                offsets = (at[a : b + 1] - at[a]).astype(np.int32)
                return pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at[a] : at[b]]))])

            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, key)), pa.array(words[a:b], pa.binary()), pa.array(df[a:b]), column(block_at * packed, flat), column(byte_at, payload)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = count(TaskContext.get().partitionId() << 32)
        ids, docs, held = [], [], 0
        known: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                if docs and (held + len(words) > SHARD_TERMS or len(docs) >= SHARD_DOCS):
                    yield from shard(next(keys), ids, docs, known)
                    ids, docs, held, known = [], [], 0, {}
                for w in set(words).difference(known):
                    known[w] = len(known)
                ids.append(doc_id)
                docs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                held += len(words)
        if docs:
            yield from shard(next(keys), ids, docs, known)

    return run


# -- a shard's answer


class Cursor:
    """A place in the postings of a term; a block is decompressed when a document in it is asked for."""

    __slots__ = ("at", "doc", "docs", "entries", "firsts", "lasts", "loaded", "peaks", "place", "postings", "tfs", "top", "weight")

    def __init__(self, entries: bytes, postings: bytes, weight: int):
        self.entries, self.postings, self.weight = np.frombuffer(entries, _ENTRY), postings, weight
        self.firsts, self.lasts = self.entries["first"].tolist(), self.entries["last"].tolist()
        self.peaks = (self.entries["peak"] * weight).tolist()
        self.top = max(self.peaks)
        self.loaded = -1
        self.restart()

    def restart(self) -> None:
        self.at, self.place, self.doc = 0, 0, self.firsts[0]

    def load(self) -> None:
        e = self.entries[self.at]
        start, gap, tf = int(e["start"]), _WIDTHS[int(e["gap"])], _WIDTHS[int(e["tf"])]
        end = int(self.entries[self.at + 1]["start"]) if self.at + 1 < len(self.entries) else len(self.postings)
        n = (end - start) // (gap.itemsize + tf.itemsize)
        self.docs = (np.cumsum(np.frombuffer(self.postings, gap, n, start), dtype=np.int64) + int(e["first"])).tolist()
        self.tfs = np.frombuffer(self.postings, tf, n, start + n * gap.itemsize)
        self.loaded = self.at

    def move(self, doc: int) -> None:
        """To the first document from ``doc`` on; into a block only if it begins before."""
        at = bisect_left(self.lasts, doc, self.at)
        if at == len(self.lasts):
            self.doc = _NOWHERE
            return
        if at != self.at:
            self.at, self.place = at, 0
        if doc <= self.firsts[at]:
            self.doc = self.firsts[at]
            return
        if self.loaded != at:
            self.load()
        self.place = bisect_left(self.docs, doc, self.place)
        self.doc = self.docs[self.place]

    def tf(self) -> int:
        if self.loaded != self.at:
            self.load()
        return int(self.tfs[self.place])


def best(cursors: list[Cursor], m: np.ndarray, k: int, need: int) -> list[tuple[int, int]]:
    """(score, -document) of the k best documents with a score of at least ``need``, no order; of equal ones the first."""
    found: list[tuple[int, int]] = []
    for c in cursors:
        c.restart()
    while cursors:
        cursors.sort(key=lambda c: c.doc)
        reach, pivot = 0, -1
        for i, c in enumerate(cursors):
            reach += c.top
            if reach >= need:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot].doc
        if doc == _NOWHERE:
            break
        while pivot + 1 < len(cursors) and cursors[pivot + 1].doc == doc:
            pivot += 1
        ahead = cursors[: pivot + 1]
        reach, end = 0, _NOWHERE
        for c in ahead:  # shallow: the directory alone
            at = bisect_left(c.lasts, doc, c.at)
            if at < len(c.lasts):
                reach += c.peaks[at]
                end = min(end, c.lasts[at])
        if reach < need:
            after = min(end + 1, cursors[pivot + 1].doc) if pivot + 1 < len(cursors) else end + 1
            for c in ahead:
                c.move(max(after, doc + 1))
        elif cursors[0].doc == doc:
            own = int(m[doc])
            score = sum(c.weight * impact(c.tf(), own) for c in ahead)
            if score >= need:
                if len(found) < k:
                    heappush(found, (score, -doc))
                else:
                    heapreplace(found, (score, -doc))
                if len(found) == k:
                    need = max(need, found[0][0] + 1)  # a later document of the same score comes behind
            for c in ahead:
                c.move(doc + 1)
        else:
            for c in ahead:
                if c.doc < doc:
                    c.move(doc)
        cursors = [c for c in cursors if c.doc != _NOWHERE]
    return found


def _answers(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of one shard: its documents (no term), and terms with their weight and the queries that have them, each with the score it needs."""
        head = rows[rows["term"].isna()].iloc[0]
        n = int(head["df"])
        ids, gone, m = np.frombuffer(head["entries"], np.int64, n), np.frombuffer(head["entries"], np.uint8, n, 8 * n), np.frombuffer(head["postings"], np.int64)
        asked: dict[int, list[Cursor]] = {}
        need: dict[int, int] = {}
        held = rows[rows["term"].notna()]
        for entries, postings, weight, queries in zip(held["entries"], held["postings"], held["weight"], held["queries"], strict=True):
            cursor = Cursor(entries, postings, int(weight))
            for q in queries:
                asked.setdefault(q["query"], []).append(cursor)
                need[q["query"]] = max(1, q["need"])
        out = []
        for query, cursors in asked.items():
            out += [(query, None if gone[-d] else int(ids[-d]), score) for score, d in best(cursors, m, k, need[query])]
        found = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        return found.astype({"query": "int64", "doc_id": "Int64", "score": "int64"})

    return run


# -- the job


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(terms(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], ["docs", "terms"])


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    row = texts.mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(the index in the shared folder, number of documents with a term)."""
    tune(docs.sparkSession)
    n_docs, n_terms = totals(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return written(rows.mapInArrow(_indexed(n_docs, max(1, n_terms)), _SHAPE), "index"), n_docs


def ranked(docs: DataFrame, queries: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best documents of each query."""
    built, n_docs = index(docs, id_col, text_col)
    asked = queries.select(F.col(query_id).alias("name"), F.array_distinct(F.regexp_extract_all(lowered(F.col(query_text)), F.lit(TERM), F.lit(0))).alias("terms"))
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    each = asked.select("query", F.explode("terms").alias("word")).select("query", F.col("word").cast("binary").alias("term"))
    blocks = max(1, -(-each.count() // QUERY_TERMS))
    each = written(each.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "terms")
    rows = written(built.join(each.select("term").distinct(), "term", "left_semi"), "postings")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("df") + 1)))
    weights = written(rows.groupBy("term").agg(weight.alias("weight")), "weights")
    documents = built.where("term is null").withColumn("weight", F.lit(None).cast("long"))

    def answered(low: int, high: int, need: DataFrame | None) -> DataFrame:
        eighth = F.pmod(F.xxhash64("shard"), F.lit(ROUNDS[-1]))
        mine = (eighth >= low) & (eighth < high)
        own = each.withColumn("need", F.lit(1).cast("long")) if need is None else each.join(need, "query", "left").na.fill(1, ["need"])
        of_term = own.groupBy("block", "term").agg(F.collect_list(F.struct("query", "need")).alias("queries")).join(weights, "term")
        postings = rows.where(mine).join(of_term, "term").select("shard", "block", "term", "df", "entries", "postings", "weight", "queries")
        heads = documents.where(mine).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        heads = heads.select("shard", "block", "term", "df", "entries", "postings", "weight", F.lit(None).cast(postings.schema["queries"].dataType).alias("queries"))
        groups = postings.unionByName(heads).groupBy("shard", "block")
        return written(groups.applyInPandas(_answers(k), "query long, doc_id long, score long"), "answers")

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found, need = None, None
    for low, high in zip((0, *ROUNDS), ROUNDS):  # noqa: B905
        new = answered(low, high, need)
        found = new if found is None else found.unionByName(new)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if high < ROUNDS[-1]:
            found = written(found.drop("rank"), "best")
            need = found.groupBy("query").agg(F.min("score").alias("need"), F.count("*").alias("n")).where(F.col("n") == k).select("query", "need")
    return found.join(asked.select("query", "name"), "query").select(F.col("name").alias(query_id), "rank", "doc_id", "score")


def oracle(k: int = BEST) -> str:
    """DuckDB SQL of ``ranked`` over ``documents`` and ``benchmark``."""
    upper = "".join(chr(c) for c in range(65, 91))
    words = lambda text: f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '{TERM}')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words("coalesce(text, '')")} AS t FROM documents),
  sized AS MATERIALIZED (SELECT row, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
  al AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
  p AS MATERIALIZED (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM sized) GROUP BY row, term),
  w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, al GROUP BY term, docs),
  m AS MATERIALIZED (SELECT row, doc_id, 10 + (90 * n * docs) // terms AS m FROM sized, al),
  q AS MATERIALIZED (SELECT item, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS item, item_id, list_distinct({words("coalesce(text, '')")}) AS t FROM benchmark)),
  s AS (SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
