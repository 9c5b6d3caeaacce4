"""Merkle manifest of a table: a hash tree over the rows of each group, a tree over the groups, and a proof of every row.

H is the lower-case hexadecimal SHA-256 of its inputs, concatenated; digests go
in as their hexadecimal text.

* A row's leaf is H of its ``FIELDS``, each as ``-`` if null, else its UTF-8
  length, ``:`` and the value.
* Rows are ordered by (group, id) in ranges, so one group may hold most rows:
  each range knows how many rows of its groups lie in the ranges before it.
* Trees grow by ``combineByKey`` (``_grown``).  The key is the ancestor DEPTH
  levels up; its combiner holds partial parents.  A child digest is filed under
  its parent by index, and when as many have arrived as the level's size allows
  for (the last run is shorter) the parent is hashed and arrives one level up,
  at once.  As ranges are ordered, nearly all parents close before the exchange;
  what is still open at the ends of a range (the frontier) meets in the merge.
  The ancestors are the nodes of the next round, so n rows take
  log(n) / log(ARITY ** DEPTH) exchanges, each smaller by ARITY ** DEPTH.
* Closed parents leave reverse links: every node knows what stands before and
  after it in its run.  The links of a node and of its ancestors make its path.
  Proof and folded root are column expressions over the path.

Defined results: a null group is a group of its own, before all others; null ids
come first; rows of one group and id are ordered by their leaves (equal rows are
interchangeable); a group of one row has its leaf as subroot, a table of one
group its subroot as root; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: So many levels are resolved between two exchanges; a combiner holds ARITY ** DEPTH nodes of the lowest.
DEPTH = 8
#: Rows of a partition are numbered in these bits of ``monotonically_increasing_id``.
ROW_BITS = (1 << 33) - 1

STEP = "array<struct<before string, after string>>"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def width(size: int, level: int, arity: int = ARITY) -> int:
    """Number of nodes so many levels above ``size`` leaves."""
    return -(-size // arity**level)


class Parents:
    """The combiner of one key: partial parents, and the links of the parents that are complete."""

    __slots__ = ("arity", "depth", "held", "open", "runs", "size", "top")

    def __init__(self, size: int, arity: int, depth: int):
        self.size, self.arity, self.depth = size, arity, depth
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        #: (level, index of the parent) -> digests of its children
        self.runs: dict[tuple[int, int], list[str]] = {}
        #: index -> what a node of the lowest level carries
        self.held: dict[int, tuple] = {}
        self.top: str | None = None

    def arrive(self, level: int, index: int, digest: str) -> None:
        """File a digest under its parent, and go on with the parent while that completes it."""
        while level < self.depth and width(self.size, level, self.arity) > 1:
            at = index // self.arity
            met = self.open.setdefault((level, at), {})
            met[index] = digest
            if len(met) < min(self.arity, width(self.size, level, self.arity) - at * self.arity):
                return
            run = [d for _, d in sorted(self.open.pop((level, at)).items())]
            self.runs[level, at] = run
            digest, index, level = hashed(*run), at, level + 1
        self.top = digest

    def add(self, node: tuple) -> Parents:
        index, digest, carried = node
        self.held[index] = (digest, carried)
        self.arrive(0, index, digest)
        return self

    def merge(self, other: Parents) -> Parents:
        """Links are united; the other's open children arrive here."""
        self.runs.update(other.runs)
        self.held.update(other.held)
        self.top = self.top or other.top
        for (level, _), met in other.open.items():
            for index, digest in met.items():
                self.arrive(level, index, digest)
        return self

    def path(self, index: int) -> list[tuple[str, str]]:
        """What stands before and after the node and its ancestors in their runs, upwards."""
        steps, level = [], 0
        while level < self.depth and width(self.size, level, self.arity) > 1:
            at = index // self.arity
            run, own = self.runs[level, at], index - at * self.arity
            steps.append(("".join(run[:own]), "".join(run[own + 1 :])))
            index, level = at, level + 1
        return steps


def _grown(nodes: DataFrame, arity: int, depth: int, name: str) -> DataFrame:
    """One round over ``grp, size, index, digest, carried``.

    Rows with ``index``: a node with its path, and ``up``, the index of its
    ancestor; rows without: the ancestors, with their digest.
    """
    carried = nodes.schema["carried"].dataType
    shape = T.StructType([T.StructField("grp", T.StringType()), T.StructField("size", T.LongType()), T.StructField("index", T.LongType()), T.StructField("up", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))), T.StructField("carried", carried)])
    span = arity**depth

    def created(node):
        return Parents(node[3], arity, depth).add(node[:3])

    def rows(item):
        (group, up), parents = item
        if parents.top is None:
            raise ValueError(f"nodes missing below {group!r}, {up}")
        for index, (digest, what) in parents.held.items():
            yield group, parents.size, index, up, digest, parents.path(index), what
        yield group, width(parents.size, depth, arity), None, up, parents.top, None, None

    pairs = nodes.select("grp", "size", "index", "digest", "carried").rdd.map(lambda r: ((r[0], r[2] // span), (r[2], r[3], r[4], r[1])))
    grown = pairs.combineByKey(created, lambda parents, node: parents.add(node[:3]), Parents.merge).flatMap(rows)
    return written(nodes.sparkSession.createDataFrame(grown, shape), name)


def _tree(nodes: DataFrame, arity: int, depth: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: grp, up, path, digest, carried; ancestors: grp, up, path to the top, top) of the tree of each group."""
    rounds = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        grown = _grown(nodes, arity, depth, name)
        rounds.append(grown.where("index is not null").select("grp", "index", "up", "path", "digest", "carried"))
        tops = grown.where("index is null").select("grp", "size", F.col("up").alias("index"), "digest", F.lit(None).cast("int").alias("carried"))
        most = width(most, depth, arity)
        if most <= 1:
            break
        nodes = tops
    above = tops.select("grp", F.col("index").alias("up"), F.array().cast(STEP).alias("rest"), F.col("digest").alias("top"))
    for level in reversed(rounds[1:]):
        above = level.join(above, ["grp", "up"]).select("grp", F.col("index").alias("up"), F.concat("path", "rest").alias("rest"), "top")
    return rounds[0], above if len(rounds) == 1 else written(above, name)


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "leaves") -> DataFrame:
    """``rows`` with ``index``, the place in the group by ``order`` from 0, and ``size``, the group's rows."""
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("_i")), name)
    parts = ranged.groupBy("_p", group).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_p", group, "_first", before.alias("_before"), F.sum("_n").over(of_group).alias("size"))
    return ranged.join(parts, ["_p", group]).withColumn("index", F.col("_i") - F.col("_first") + F.col("_before")).drop("_p", "_i", "_first", "_before")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """H of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """``id_col, leaf, now, subroot, root, path``, one row per row of ``docs``.

    ``now`` is the leaf of the row with the columns in ``changed`` replaced,
    which an audit holds against the manifest by folding it along ``path``.
    """
    if arity < 2 or depth < 1:
        raise ValueError("arity must be at least 2 and depth at least 1")
    as_is = {f: F.col(f) for f in fields}
    own, now = leaf(as_is.values()), leaf((as_is | (changed or {})).values())
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("grp"), F.col(id_col).alias("id"), own.alias("digest"), now.alias("now"))
    # the running number lets ranges part even rows that are equal in all else
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())
    placed = numbered(written(leaves, "rows"), "grp", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")])
    low, above = _tree(placed.select("grp", "size", "index", "digest", F.struct("id", "now").alias("carried")), arity, depth, "tree")
    subroots = above.groupBy("grp").agg(F.first("top").alias("digest"))
    ranked = numbered(subroots.withColumn("all", F.lit("")), "all", [F.col("grp")], "subroots")
    upper, top = _tree(ranked.select(F.lit("").alias("grp"), "size", "index", "digest", F.col("grp").alias("carried")), arity, depth, "roots")
    roots = upper.join(top, ["grp", "up"]).select(F.col("carried").alias("grp"), F.concat("path", "rest").alias("to_root"), F.col("top").alias("root"))
    above = above.join(roots, "grp").select("grp", "up", F.concat("rest", "to_root").alias("rest"), F.col("top").alias("subroot"), "root")
    return low.join(above, ["grp", "up"]).select(F.col("carried.id").alias(id_col), F.col("digest").alias("leaf"), F.col("carried.now").alias("now"), "subroot", "root", F.concat("path", "rest").alias("path"))


def audit(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``manifest`` with the digest of each proof, the root that ``now`` folds to, and whether that is the root."""
    out = found.select(id_col, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(tampered: str, levels: int = 24, group_levels: int = 12) -> str:
    """DuckDB SQL of the audit over ``documents``; ``tampered`` is the SQL of the rows whose n_chars has grown by 1.

    Levels are unrolled: 2 ** ``levels`` rows a group and 2 ** ``group_levels`` groups at most.
    """

    def text(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf_of(n: str) -> str:
        return f"sha256({' || '.join(text(n if f == 'n_chars' else f) for f in FIELDS)})"

    def climb(name: str, n: int) -> list[str]:
        """Level after level: t (the nodes) and p (every lowest node's index, proof and fold)."""
        out = []
        for k in range(n):
            out.append(f"""{name}p{k + 1} AS MATERIALIZED (SELECT a.id, a.grp, a.index // 2 AS index, a.proof || coalesce(s.digest, '') AS proof,
  CASE WHEN o.n = 1 THEN a.fold WHEN a.index % 2 = 1 THEN sha256(s.digest || a.fold) ELSE sha256(a.fold || coalesce(s.digest, '')) END AS fold
  FROM {name}p{k} a JOIN {name}t{k} o ON o.grp = a.grp AND o.index = a.index LEFT JOIN {name}t{k} s ON s.grp = a.grp AND s.index = xor(a.index, 1))""")
            out.append(f"""{name}t{k + 1} AS MATERIALIZED (SELECT grp, index // 2 AS index, (max(n) + 1) // 2 AS n, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY index)) END AS digest
  FROM {name}t{k} GROUP BY grp, index // 2)""")
        return out

    parts = [
        f"""leaves AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS grp, {leaf_of("n_chars")} AS leaf, CASE WHEN {tampered} THEN {leaf_of("(n_chars + 1)")} ELSE {leaf_of("n_chars")} END AS now FROM documents)""",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS index, count(*) OVER (PARTITION BY grp) AS n FROM leaves)",
        "at0 AS MATERIALIZED (SELECT grp, index, n, leaf AS digest FROM placed)",
        "ap0 AS MATERIALIZED (SELECT id, grp, index, '' AS proof, now AS fold FROM placed)",
        *climb("a", levels),
        f"bt0 AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS index, count(*) OVER () AS n, digest, grp AS name FROM at{levels})",
        f"bp0 AS MATERIALIZED (SELECT p.id, '' AS grp, b.index, p.proof, p.fold FROM ap{levels} p JOIN bt0 b ON b.name = p.grp)",
        *climb("b", group_levels),
    ]
    return f"""WITH {", ".join(parts)}
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = r.digest AS verified
FROM leaves l JOIN at{levels} s ON s.grp = l.grp JOIN bp{group_levels} p ON p.id = l.id CROSS JOIN bt{group_levels} r"""
