"""I-Match document fingerprints, in DataFrame expressions only.

Terms are the pieces of a text between ASCII blanks and punctuation, A-Z
lower-cased.  The lexicon holds the terms whose inverse document frequency lies
in a band: those in at most ``MOST_DOCS`` of the documents and in at least as
many as leaves ``LEXICON`` terms, two at least.  The lower edge is found from the
number of terms of each document frequency, a short table; it does not depend on
the length of the texts.  The lexicon is sent along inside the plan as a hash set.

A fingerprint has one component per randomised subset of the lexicon: the hash
of the text's sorted distinct terms in the subset.  Subsets keep a sixteenth, a
thirty-second and so on down to one in 512 of the lexicon, ``EACH`` of each, by
disjoint bits of the term's hash, so that some have one or two terms of a text,
whether it is short or long.  A subset without terms gives a component of zeros; if
all are empty, the whole text is hashed instead, so that texts without lexicon
terms are not taken for equal.  Likeness is the share of components that agree,
of those not empty on both sides.

Defined results: a null text counts as empty; equal texts have equal
fingerprints, empty ones too; a null id sorts last in descending order, rows of
equal id by text; a single row is its own next document; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import written

MOST_DOCS, LEXICON = 0.25, 20_000
EACH, HALVINGS = 3, range(4, 10)
#: Buckets of neighbouring ids: FAN to the power of the levels, with about ROWS rows each, three levels at most.
FAN, ROWS = 32, 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "[\\x09-\\x0D -/:-@\\[-`{-~]+"
#: (number, bit offset, mask) of each subset in the two 60-bit numbers of a term's hash.
SUBSETS: list[tuple[int, int, int]] = []
for _d in HALVINGS:
    for _ in range(EACH):
        _n, _at = (SUBSETS[-1][0], SUBSETS[-1][1] + SUBSETS[-1][2].bit_length()) if SUBSETS else (0, 0)
        SUBSETS.append((_n, _at, (1 << _d) - 1) if _at + _d <= 60 else (_n + 1, 0, (1 << _d) - 1))
assert SUBSETS[-1][0] < 2
WIDTH = 16
_LAST = -(1 << 63)


def terms(text: Column) -> Column:
    """All terms of a text, repeated ones too."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SPLIT), lambda t: t != "")


def lexicon(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The terms in the band, sorted; at most LEXICON."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(terms(F.coalesce(F.col(text_col), F.lit(""))))).alias("t"))
    count = written(each.groupBy("t").count().where((F.col("count") >= 2) & (F.col("count") <= MOST_DOCS * n)), "terms")
    so_far, least = 0, None
    for r in sorted(count.groupBy("count").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["count"]):  # one row for each frequency
        so_far += r.k
        if so_far > LEXICON:
            break
        least = r["count"]
    return [] if least is None else sorted(r.t for r in count.where(F.col("count") >= least).select("t").collect())


def _among(term: Column, words: list[str]) -> Column:
    """``term.isin(words)``, handed to the planner as one list instead of a call for each word; terms hold no blanks."""
    jvm = SparkContext._active_spark_context._jvm
    every = jvm.java.util.regex.Pattern.compile(" ").splitAsStream(" ".join(words)).toList()
    return Column(term._jc.isInCollection(every))


def _in_band(text: Column, words: list[str]) -> Column:
    """Sorted distinct lexicon terms of a text with their hashes."""
    kept = F.filter(terms(text), lambda t: _among(t, words) if words else F.lit(False))
    hashed = F.transform(F.array_sort(F.array_distinct(kept)), lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("m")))
    number = lambda m, k: F.conv(F.substring(m, 1 + 15 * k, 15), 16, 10).cast("long")
    return F.transform(hashed, lambda x: F.struct(x["t"].alias("t"), number(x["m"], 0).alias("h0"), number(x["m"], 1).alias("h1")))


def fingerprint(text: Column, words: list[str]) -> Column:
    """The fingerprint (hex string) of a text under a lexicon."""
    text = F.coalesce(text, F.lit(""))

    def components(pair: Column) -> Column:
        found, body = pair["found"], pair["text"]

        def one(s: Column) -> Column:
            own = F.filter(found, lambda x: F.call_function("shiftright", F.when(s["of"] == 0, x["h0"]).otherwise(x["h1"]), s["at"]).bitwiseAND(s["mask"]) == 0)
            return F.when(F.size(own) == 0, F.lit("0" * WIDTH)).otherwise(F.substring(F.md5(F.array_join(F.transform(own, lambda x: x["t"]), " ").cast("binary")), 1, WIDTH))

        subsets = F.array(*[F.struct(F.lit(n).alias("of"), F.lit(a).alias("at"), F.lit(m).cast("long").alias("mask")) for n, a, m in SUBSETS])
        joined = F.array_join(F.transform(subsets, one), "")
        bare = F.repeat(F.substring(F.md5(body.cast("binary")), 1, WIDTH), len(SUBSETS))
        return F.when(joined == "0" * WIDTH * len(SUBSETS), bare).otherwise(joined)

    # bound in a lambda, so that the terms are found once and not once per subset
    return F.element_at(F.transform(F.array(F.struct(_in_band(text, words).alias("found"), text.alias("text"))), components), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing components, 0 to 1."""
    at = F.array(*[F.lit(1 + WIDTH * k) for k in range(len(SUBSETS))])
    none = F.lit("0" * WIDTH)
    part = lambda x, i: F.substring(x, i, WIDTH)
    same = F.size(F.filter(at, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != none)))
    used = F.size(F.filter(at, lambda i: (part(a, i) != none) | (part(b, i) != none)))
    return F.when(a == b, F.lit(1.0)).otherwise(same.cast("double") / F.greatest(used, F.lit(1)))


def _bucket(number: Column, cuts: list[int], levels: int) -> Column:
    """How many cuts are at most ``number``, by a search tree of FAN-way nodes held in nested arrays."""

    def nested(low: int, high: int, level: int):
        """Cuts of the node over [low, high) and its children."""
        step = FAN ** (level - 1)
        own = [cuts[i + step - 1] for i in range(low, high - step + 1, step)]
        return own, [nested(i, min(high, i + step - 1), level - 1) for i in range(low, high + 1, step)] if level > 1 else []

    def flat(node, depth: int):
        return [node[0]] if depth == 0 else [x for child in node[1] for x in flat(child, depth - 1)]

    tree = nested(0, len(cuts), levels)
    place = F.lit(0)
    for level in range(levels):
        rows = flat(tree, level)
        table = F.lit(None).cast("array<array<bigint>>") if not rows else F.array(*[F.array(*[F.lit(v).cast("long") for v in r]).cast("array<bigint>") for r in rows])
        here = F.coalesce(F.get(table, place), F.array().cast("array<bigint>"))
        place = place * FAN + F.size(F.filter(here, lambda cut: cut <= number))
    return place


def neighbours(docs: DataFrame, columns: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``docs``' id and ``columns``, and under ``next_<name>`` those of the next row in descending id order, the last row's being the first's.

    Rows are dealt by ranges of ids (buckets cut at approximate quantiles) and
    each bucket also gets a copy of the row that follows it, so one exchange and
    no global sort is needed.  Only cuts and first ids of the buckets, at most
    FAN**3 numbers, reach the driver.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    rows = docs.count()
    if not rows:
        empty = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in columns.items()])
        return empty.select("*", *[F.col(k).alias(f"next_{k}") for k in columns])
    levels = min(3, max(1, math.ceil(math.log(max(2, rows / ROWS), FAN))))
    n = FAN**levels
    got = docs.select(number.alias("i")).agg(F.percentile_approx("i", [k / n for k in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(got)
    bucket = _bucket(number, cuts, levels)
    heads = docs.select(bucket.alias("b"), number.alias("i")).groupBy("b").agg(F.max("i").alias("i")).collect()
    heads = sorted(((r.b, r.i) for r in heads), reverse=True)
    follows = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]  # the first bucket's head closes the last bucket
    small = spark.createDataFrame(follows, T.StructType([T.StructField("rv_i", T.LongType()), T.StructField("rv_also", T.IntegerType())]))
    full = docs.select(F.col(id_col).alias("doc_id"), number.alias("rv_i"), bucket.alias("rv_own"), *[c.alias(k) for k, c in columns.items()])
    full = full.join(F.broadcast(small), "rv_i", "left")
    place = lambda b, copy: F.struct(b.alias("b"), F.lit(copy).alias("copy"))
    both = F.when(F.col("rv_also").isNull(), F.array(place(F.col("rv_own"), False))).otherwise(F.array(place(F.col("rv_own"), False), place(F.col("rv_also"), True)))
    full = full.withColumn("rv_at", F.explode(both))
    from pyspark.sql import Window

    first = next(iter(columns))
    w = Window.partitionBy("rv_at.b").orderBy(F.col("rv_at.copy"), F.col("rv_i").desc(), F.col(first))
    full = full.select("doc_id", "rv_at", *columns, *[F.lead(k).over(w).alias(f"next_{k}") for k in columns])
    return full.where(~F.col("rv_at.copy")).drop("rv_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose second half the next document's beginning replaces.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    words = lexicon(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = neighbours(docs, {"text": text, "fingerprint": fingerprint(text, words)}, id_col)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint", fingerprint(F.col("edited"), words).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def oracle() -> str:
    """The same in DuckDB SQL over a view ``documents``."""
    subsets = ", ".join(f"({k}, {n}, {a}, {m})" for k, (n, a, m) in enumerate(SUBSETS))
    zero = "0" * WIDTH
    part = lambda x: f"{x}[1 + {WIDTH} * i : {WIDTH} * (i + 1)]"
    count = lambda cond: f"len([i for i in range({len(SUBSETS)}) if {cond}])"
    like = lambda a, b: f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE
        {count(f"{part(a)} = {part(b)} AND {part(a)} <> '{zero}'")}::DOUBLE / greatest(1, {count(f"{part(a)} <> '{zero}' OR {part(b)} <> '{zero}'")}) END"""  # noqa: E731
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS k, doc_id, coalesce(text, '') AS text FROM documents),
    e AS (SELECT k, doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY k), first_value(text) OVER (ORDER BY k)) AS follow FROM d),
    x AS (SELECT k, doc_id, n, text, substr(text, 1, n - n // 2) || substr(follow, 1, n // 2) AS edited FROM e),
    texts AS (SELECT k, 0 AS kind, text FROM x UNION ALL SELECT k, 1 AS kind, edited FROM x),
    terms AS (SELECT DISTINCT k, kind, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '{SPLIT}')) AS term FROM texts),
    own AS (SELECT term, count(*) AS df FROM terms WHERE kind = 0 AND term <> '' GROUP BY term),
    band AS (SELECT term, df FROM own, (SELECT count(*) AS n FROM d) WHERE df >= 2 AND df <= {MOST_DOCS}::DOUBLE * n),
    lexicon AS (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS h0, ('0x' || substr(md5(term), 16, 15))::BIGINT AS h1 FROM (SELECT term, count(*) OVER (ORDER BY df DESC) AS upto FROM band) WHERE upto <= {LEXICON}),
    subsets(s, which, low, mask) AS (VALUES {subsets}),
    parts AS (SELECT k, kind, s, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {WIDTH}) AS part FROM terms JOIN lexicon USING (term) JOIN subsets ON ((CASE which WHEN 0 THEN h0 ELSE h1 END >> low) & mask) = 0 GROUP BY k, kind, s),
    prints AS (SELECT t.k, t.kind, CASE WHEN count(part) = 0 THEN repeat(substr(md5(any_value(text)), 1, {WIDTH}), {len(SUBSETS)}) ELSE string_agg(coalesce(part, '{zero}'), '' ORDER BY s) END AS print
      FROM (SELECT k, kind, text, s FROM texts CROSS JOIN subsets) t LEFT JOIN parts USING (k, kind, s) GROUP BY t.k, t.kind),
    a AS (SELECT x.k, doc_id, n, edited, p.print AS fp, q.print AS fe FROM x JOIN prints p ON p.k = x.k AND p.kind = 0 JOIN prints q ON q.k = x.k AND q.kind = 1),
    b AS (SELECT *, coalesce(lead(fp) OVER (ORDER BY k), first_value(fp) OVER (ORDER BY k)) AS fnext FROM a)
    SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, fe AS edited_fingerprint, {like('fp', 'fe')} AS near_edited, {like('fp', 'fnext')} AS near_next FROM b"""
