"""URL filter: explicit rules, then empirical-Bayes host reputation.

A rule (host and path prefix) decides the urls that it fits; the longest wins.
Any other url is judged by its host: labelled page outcomes (bad or not) are
counted by host, and the rate of bad pages is shrunk level by level.  The rate
of a public suffix is drawn towards the global rate, a registered domain
towards its suffix, a host towards its domain, each by a beta-binomial prior
whose mean is the parent's posterior mean and whose strength (in pages) is
fitted at that level by the method of moments.  A host is blocked if the lower
posterior bound of its bad rate, mean - Z * sd, exceeds ``BLOCK_ABOVE``.

Counts are combined before any shuffle; the host table meets the pages by a
join on host and salt, so a host with a third of all pages is dealt over
``SALTS`` tasks.  Only six sums per level reach the driver.

Defined results: a null url, or one without ``://``, has empty host and path
and is judged as the host ''; null or repeated outcomes of a page count once
(bad if any is); of rules of equal length that with the longer host wins, then a
block; hosts without outcomes get their domain's posterior; without
any outcomes all hosts are allowed; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

Z, BLOCK_ABOVE, SALTS = 1.645, 0.5, 8
#: Bounds of a level's prior strength in pages.
WEAKEST, STRONGEST = 1.0, 10_000.0

#: Second labels that make a public suffix below any country's two letters (``co.uk``, ``com.mx``, ``or.jp``).
SECOND_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def domain_pattern(suffixes: list[str] | None = None) -> str:
    """Pattern of the registered domain; ``suffixes``: further public suffixes, such as a full list of them (``blogspot.com``)."""
    more = "".join("|" + s.replace(".", "\\.") for s in sorted(suffixes or [], key=lambda s: (-len(s), s)))
    return "((?:[^.]+\\.)?(?:" + f"(?:{'|'.join(SECOND_LABELS)})\\.[a-z]{{2}}{more}|[^.]+))$"


DOMAIN = domain_pattern()
#: What is no part of a name; names that are addresses.
PORT, ADDRESS = "[.]*(?::[0-9]*)?$", "^(?:[0-9]+(?:[.][0-9]+){3}|\\[.*\\])$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def domain_of(host: Column, suffixes: list[str] | None = None) -> Column:
    """The registered domain of a host, without port and closing dots; an address is a domain of its own."""
    name = F.regexp_replace(host, PORT, "")
    return F.when(name.rlike(ADDRESS), name).otherwise(F.regexp_extract(name, domain_pattern(suffixes), 1))


def suffix_of(domain: Column) -> Column:
    named = (F.instr(domain, ".") > 0) & ~domain.rlike(ADDRESS)
    return F.when(named, F.substring(domain, F.instr(domain, ".") + 1, F.length(domain))).otherwise("")


def _rank(rule: tuple[str, str, str]) -> tuple:
    return len(rule[1] + rule[2]), len(rule[1]), rule[0] == "block", rule[1:]


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, null if none fits; rules: (verdict, host, path prefix).

    Of rules of equal length that with the longer host wins, then a block.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=_rank):  # those that win wrap the others
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> tuple[float, float]:
    """(bad rate, prior strength) of a level by the method of moments; groups: n labelled, b bad."""
    g = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("b").cast("double") * F.col("b") / F.col("n")).alias("bb")).first()
    if not g.n:
        return 0.0, STRONGEST
    p = g.b / g.n
    spread = p * (1 - p) * (g.n - g.nn / g.n - (g.k - 1))
    if spread <= 0:
        return p, STRONGEST
    rho = (g.bb - p * p * g.n - p * (1 - p) * (g.k - 1)) / spread
    return p, STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, (1 - rho) / rho))


def reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", suffixes: list[str] | None = None) -> DataFrame:
    """One row per host of ``pages``: ``host, n, b, bad_rate, lower``.

    ``outcomes``: (id, bad boolean) of labelled pages.
    """
    known = outcomes.select(F.col(outcomes.columns[0]).alias("i"), F.col(outcomes.columns[1]).cast("int").alias("bad")).where("i is not null and bad is not null").groupBy("i").agg(F.max("bad").alias("bad"))
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("i"), host.alias("host")).distinct().join(known, "i", "left")
    hosts = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    hosts = written(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    (p, s1), (_, s2), (_, s3) = _strength(suffixes), _strength(domains), _strength(hosts)
    mean = lambda s, parent: (F.lit(s) * parent + F.col("b")) / (F.lit(s) + F.col("n"))
    suffixes = suffixes.select("suffix", mean(s1, F.lit(p)).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", mean(s2, F.col("of_suffix")).alias("of_domain"))
    out = hosts.join(domains, "domain").select("host", "n", "b", mean(s3, F.col("of_domain")).alias("bad_rate"))
    return out.withColumn("lower", F.col("bad_rate") - F.lit(Z) * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.lit(s3) + F.col("n") + 1)))


def verdicts(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", suffixes: list[str] | None = None) -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict, bad_rate``; bad_rate is the posterior mean."""
    table = written(reputation(pages, outcomes, id_col, url_col, suffixes).select("host", "bad_rate", (F.col("lower") > BLOCK_ABOVE).alias("bad")), "reputation")
    table = table.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"))
    judged = rows.join(table, ["host", "salt"], "left").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))


def oracle(rules: list[tuple[str, str, str]], outcomes_sql: str) -> str:
    """The same in DuckDB SQL over a view ``pages``; outcomes_sql gives (i, bad 0 or 1)."""
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(rules, key=_rank, reverse=True))
    strength = lambda t: f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN {STRONGEST} ELSE (
        WITH m AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(n::DOUBLE * n) AS nn, sum(b::DOUBLE * b / n) AS bb FROM {t} WHERE n > 0),
        q AS (SELECT *, b / n AS p FROM m),
        r AS (SELECT *, p * (1 - p) * (n - nn / n - (k - 1)) AS spread FROM q),
        o AS (SELECT CASE WHEN spread > 0 THEN (bb - p * p * n - p * (1 - p) * (k - 1)) / spread ELSE 0 END AS rho FROM r)
        SELECT CASE WHEN rho <= 0 THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, (1 - rho) / rho)) END FROM o) END FROM {t})"""  # noqa: E731
    return f"""
    WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM split),
    parts AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
    known AS (SELECT i, max(bad) AS bad FROM ({outcomes_sql}) WHERE i IS NOT NULL AND bad IS NOT NULL GROUP BY i),
    counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS b FROM (SELECT DISTINCT page_id, host FROM parts) LEFT JOIN known ON i = page_id GROUP BY host),
    bare AS (SELECT *, regexp_replace(host, '{PORT}', '') AS name FROM counted),
    named AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE regexp_extract(name, '{DOMAIN}', 1) END AS domain FROM bare),
    hosts AS (SELECT *, CASE WHEN instr(domain, '.') > 0 AND NOT regexp_matches(domain, '{ADDRESS}') THEN substr(domain, instr(domain, '.') + 1) ELSE '' END AS suffix FROM named),
    domains AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
    s1 AS (SELECT {strength('suffixes')} AS s, coalesce((SELECT sum(b)::DOUBLE / nullif(sum(n), 0) FROM suffixes), 0) AS p),
    s2 AS (SELECT {strength('domains')} AS s),
    s3 AS (SELECT {strength('hosts')} AS s),
    m1 AS (SELECT suffix, (s * p + b) / (s + n) AS mean FROM suffixes, s1),
    m2 AS (SELECT domain, (s * mean + b) / (s + n) AS mean FROM domains JOIN m1 USING (suffix), s2),
    m3 AS (SELECT host, n, s, (s * mean + b) / (s + n) AS rate FROM hosts JOIN m2 USING (domain), s3),
    found AS (SELECT *, CASE {cases} END AS hit FROM parts JOIN m3 USING (host))
    SELECT page_id, host, path, substr(hit, instr(hit, ' ') + 1) AS rule,
      coalesce(split_part(hit, ' ', 1), CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / (s + n + 1)) > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
      round(rate, 6) AS bad_rate
    FROM found"""
