"""URL filtering by rules and empirical-Bayes host reputation (operator 6); DataFrame functions only.

A page's outcome is known where its url names a labelled document (the first number
of its path is the document's id): good if the document's quality is 1 and it is not
toxic.  Hosts have few labelled pages, so their rates are shrunk: the host's towards
its registered domain's, the domain's towards its suffix's, the suffix's towards the
overall rate.  Each level's prior is a beta distribution whose mean is the parent's
posterior mean and whose strength is estimated from the level's own over-dispersion
(method of moments for beta-binomial counts).  A page passes if the lower posterior
bound of its host's rate, mean - z * standard deviation, is at least `min_bound`.
Rules go before reputation; the longest rule that fits wins, of equally long ones the
one that is listed last.  Up to `CASE_RULES` rules are one expression; more are a table
that the urls' host suffixes and path beginnings are joined to, with the same result.

The prior levels look at the host without its port.  A suffix is the last label, or the
last two where those are in `SUFFIXES`; a registered domain has one label more.  A host
that is an IPv4 address is a domain and a suffix of its own.

Counts are pre-aggregated by host before anything is joined.  The table of hosts is
written out and joined to the pages; Spark broadcasts it only below its size
threshold and otherwise splits a hot host's pages between tasks.

Defined results: a null url or one without `://` has an empty host and path, no rule,
and is judged by the overall rate like any unlabelled host.  Several labels for one
document count as bad if any is.  Without labels every bound is that of the flat
prior, so pages without a rule are blocked.  Repeated rows are judged one by one; an
empty table gives an empty table.  Only id and url are looked at, so other columns may
have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm.exchange import stored

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
CASE_RULES = 1000
#: Public suffixes of two labels that are told apart.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
Z = 1.645
MIN_BOUND = 0.6


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER_CASE)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def document_of(path):
    """The id of the document that a path names, its first number; ids beyond a long are no documents."""
    digits = F.nullif(F.regexp_extract(path, "/([0-9]{1,18})([^0-9]|$)", 1), F.lit(""))
    return F.try_to_number(digits, F.lit("9" * 18)).cast("long")


def _case(rules, value):
    """The value of the longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        out = F.when(fits, F.lit(value(rule, verdict))).otherwise(out)
    return out


def ruled(pages: DataFrame, rules, limit: int = CASE_RULES) -> DataFrame:
    """Parsed pages with rule and ruling, the longest fitting rule and its verdict."""
    if len(rules) <= limit:
        return pages.withColumn("rule", _case(rules, lambda r, _: r)).withColumn("ruling", _case(rules, lambda _, v: v))
    rows = [(name, "/" + rest, rule, verdict, k) for k, (rule, verdict) in enumerate(rules) for name, _, rest in [rule.partition("/")]]
    table = pages.sparkSession.createDataFrame(rows, "name string, start string, rule string, ruling string, k int")
    sizes = table.groupBy("name").agg(F.collect_set(F.length("start")).alias("sizes"))
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pages.select("host", "path").distinct().withColumn("name", F.explode(names)).join(sizes, "name")
    asked = asked.select("host", "path", "name", F.explode("sizes").alias("n")).withColumn("start", F.expr("substr(path, 1, n)"))
    best = F.max_by(F.struct("rule", "ruling"), F.struct(F.length("rule"), "k")).alias("best")
    found = asked.join(table, ["name", "start"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.ruling")
    return pages.join(found, ["host", "path"], "left")


def levels(host):
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    own, two = name.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.substring_index(name, ".", -2).isin(*SUFFIXES)
    domain = F.when(own, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, F.when(own, name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def _strength(children: DataFrame) -> DataFrame:
    """One row, kappa: the strength of the beta prior about the children's `mean`."""
    spread = F.col("mean") * (1 - F.col("mean"))
    share = F.col("good") / F.col("n")
    sums = children.where("n > 0").agg(
        F.sum(F.col("n") * (share - F.col("mean")) ** 2 - spread).alias("over"),
        F.sum(spread * (F.col("n") - 1)).alias("room"),
    )
    rho = F.when(F.col("room") > 0, F.col("over") / F.col("room")).otherwise(0.5)
    return sums.select((1 / F.greatest(F.lit(1e-3), F.least(F.lit(0.999), F.coalesce(rho, F.lit(0.5)))) - 1).alias("kappa"))


def reputation(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """(host, bound) of every host of parsed pages."""
    doc = document_of(F.col("path"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("long").alias("good"))
    outcomes = pages.select("host", doc.alias("doc_id")).join(known, "doc_id", "left")
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = levels(F.col("host"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mean"))
    level = total
    for name, key in (("suffix", "suffix"), ("domain", "domain")):
        own = hosts.groupBy(*(["suffix"] if name == "suffix" else ["domain", "suffix"])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        own = own.crossJoin(F.broadcast(level)) if name == "suffix" else own.join(level, "suffix")
        kappa = F.broadcast(_strength(own))  # one row
        post = (F.col("good") + F.col("kappa") * F.col("mean")) / (F.col("n") + F.col("kappa"))
        level = stored(own.crossJoin(kappa).select(key, post.alias("mean")), name)
    own = hosts.join(level, "domain")
    own = own.crossJoin(F.broadcast(_strength(own)))
    a = F.col("good") + F.col("kappa") * F.col("mean")
    b = F.col("n") - F.col("good") + F.col("kappa") * (1 - F.col("mean"))
    bound = a / (a + b) - z * F.sqrt(a * b / (a + b + 1)) / (a + b)
    return stored(own.select("host", bound.alias("bound")), "reputation")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_bound: float = MIN_BOUND, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, bound) of every page."""
    known = parsed(pages.select(key, "url"))
    bounds = reputation(known, labels)
    judged = ruled(known.join(bounds, "host", "left"), rules)
    by_bound = F.when(F.col("bound") >= min_bound, "allow").otherwise("block")
    return judged.select(key, "host", "path", "rule", F.coalesce("ruling", by_bound).alias("verdict"), F.round("bound", 6).alias("bound"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    def case(value):
        arms = []
        for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
            name, _, rest = rule.partition("/")
            arms.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{value(rule, verdict)}'")
        return f"CASE {' '.join(arms)} END"

    name = "regexp_replace(host, ':[0-9]*$', '')"
    last = lambda n: f"array_to_string(list_slice(string_split({name}, '.'), -{n}, -1), '.')"
    suffixes = ", ".join(f"'{x}'" for x in SUFFIXES)
    level = lambda more: f"CASE WHEN regexp_full_match({name}, '[0-9]+([.][0-9]+){{3}}') THEN {name} WHEN {last(2)} IN ({suffixes}) THEN {last(2 + more)} ELSE {last(1 + more)} END"
    strength = """SELECT 1 / greatest(1e-3, least(0.999, coalesce(CASE WHEN sum(mean * (1 - mean) * (n - 1)) > 0
      THEN sum(n * power(good / n - mean, 2) - mean * (1 - mean)) / sum(mean * (1 - mean) * (n - 1)) ELSE 0.5 END, 0.5))) - 1 AS kappa
      FROM {} WHERE n > 0"""
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
known AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER_CASE}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
good AS (SELECT doc_id, CAST(min(quality) * (1 - max(coalesce(toxic, 0))) AS BIGINT) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, count(g.good) AS n, coalesce(sum(g.good), 0) AS good,
  {level(1)} AS domain, {level(0)} AS suffix
  FROM known LEFT JOIN good g ON g.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1) AS BIGINT) GROUP BY host),
total AS (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(mean) AS mean FROM hosts, total GROUP BY suffix),
s1 AS (SELECT suffix, (good + kappa * mean) / (n + kappa) AS mean FROM s0, ({strength.format('s0')})),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s1.mean) AS mean FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, (good + kappa * mean) / (n + kappa) AS mean FROM d0, ({strength.format('d0')})),
h0 AS (SELECT host, n, good, mean FROM hosts JOIN d1 USING (domain)),
h1 AS (SELECT host, good + kappa * mean AS a, n - good + kappa * (1 - mean) AS b FROM h0, ({strength.format('h0')})),
bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / (a + b + 1)) / (a + b) AS bound FROM h1)
SELECT page_id, host, path, {case(lambda r, _: r)} AS rule,
  coalesce({case(lambda _, v: v)}, CASE WHEN bound >= {MIN_BOUND} THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 6) AS bound
FROM known LEFT JOIN bounds USING (host)
"""


QUERIES = {"op6_url_reputation": op6_url_reputation}
ORACLE_SQL = {"op6_url_reputation": _sql()}
