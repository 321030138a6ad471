"""Mixing sources to target weights by Poisson replication (operator 1); DataFrame functions only.

A source with weight w among W, holding n documents, is to make up w/W of `total`
documents, so each of its documents is repeated a Poisson number of times with mean
(the repetition rate) w/W * total / n.  The number is drawn by inverting the
distribution function at a uniform number hashed from the seed and the document's id:
drawing again gives the same corpus, on any cluster, and a document's draw does not
depend on any other document.  Copies are dealt out by a hash of seed, id and copy
number, and sorted by it: a global shuffle.

Only counts by source are aggregated (pre-aggregated by task).  A source's distribution
function is tabled once, over the 12 standard deviations about its mean outside which no
hashed number falls, so a rate r takes about 24 sqrt(r) numbers; a document's number is
found in it by binary search.  Tables are broadcast while they have at most
`BROADCAST_NUMBERS` numbers in all (8 MB), which is summed first; beyond that they are
joined by shuffle, where adaptive execution splits a hot source.  The only
exchange of texts is the shuffle itself, and its key is a hash, so a source that
holds a third of all documents lands in no single task.

Defined results: rows of a null source form a source of their own, which takes the
weight given for None, else the default weight.  Documents with equal ids, or none,
share one draw.  Sources of weight 0 vanish; an empty table stays empty.  A source
whose weight is listed but that has no documents counts for nothing: the weights of
present sources are rescaled.  Texts of any length, null texts and repeated rows are
moved as they are.  Extra columns stay as they are, but for one named `copy`, which
becomes `copy_in` (`copy_in_in` if there is a `copy_in` too, and so on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_NUMBERS = 1_000_000
SEED = 17


def source_rates(docs: DataFrame, weights: dict | None = None, default: float = 1.0, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate): how often a document of each source is repeated on average.

    weights: relative weights by source; sources it lacks have `default`.  total:
    documents aimed at, by default as many as there are.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    rated = counts.withColumn("weight", weight)
    sums = rated.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    aim = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * aim / F.col("n")).otherwise(0.0)
    return rated.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def _log_factorial(k):
    """ln k!, by Stirling's series; meant for 0 and for large k."""
    x = k + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(k > 0, series).otherwise(0.0)


def bounds_of(rate):
    """The least and greatest number that a Poisson variable of this rate takes, but for a chance far below any hashed number's."""
    spread = 12 * F.sqrt(rate) + 40
    return F.greatest(F.lit(0.0), F.floor(rate - spread)).cast("double"), F.ceil(rate + spread).cast("double")


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, lo, cdf, steps): cdf[i] = P(N <= lo + i); steps are those of a binary search in cdf."""
    lo, hi = bounds_of(F.col("rate"))
    ranged = rates.where("rate > 0").withColumn("lo", lo).withColumn("hi", hi)
    rows = ranged.select("source", "rate", "lo", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("i")).withColumn("k", F.col("i").cast("double"))
    run = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("lo") * F.log("rate") - F.col("rate") - _log_factorial(F.col("lo"))
    log_p = F.sum(F.when(F.col("k") > F.col("lo"), F.log("rate") - F.log("k")).otherwise(first)).over(run)
    summed = rows.withColumn("log_p", log_p).withColumn("c", F.sum(F.exp("log_p")).over(run))
    listed = summed.groupBy("source").agg(F.first("lo").cast("int").alias("lo"), F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    last = F.floor(F.log2(F.size("cdf"))).cast("int")
    return listed.withColumn("steps", F.transform(F.sequence(last, F.lit(0)), lambda b: F.pow(F.lit(2.0), b).cast("int")))


def poisson_number(u):
    """How many of (lo, cdf, steps)'s numbers lie below u's: the distribution inverted at u, by binary search."""
    n = F.size("__mix_cdf")
    at = F.aggregate("__mix_steps", F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get("__mix_cdf", at + step - 1) <= u), at + step).otherwise(at))
    return F.col("__mix_lo") + at


def hashed_uniform(*parts):
    """A number in [0, 1) of 52 bits, hashed from the parts' texts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict | None = None, default: float = 1.0, total: float | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs' columns and `copy` (1, 2, ...), a row a copy, in shuffled order."""
    if "copy" in docs.columns:
        name = "copy_in"
        while name in docs.columns:
            name += "_in"
        docs = docs.withColumnRenamed("copy", name)
    rates = source_rates(docs, weights, default, total, source)
    lo, hi = bounds_of(F.col("rate"))
    numbers = rates.where("rate > 0").agg(F.coalesce(F.sum(hi - lo + 1), F.lit(0.0))).head()[0]
    tables = poisson_tables(rates).select(F.col("source").alias("__mix_source"), F.col("lo").alias("__mix_lo"), F.col("cdf").alias("__mix_cdf"), F.col("steps").alias("__mix_steps"))
    if numbers <= BROADCAST_NUMBERS:
        tables = F.broadcast(tables)
    drawn = docs.join(tables, docs[source].eqNullSafe(tables["__mix_source"]))
    drawn = drawn.withColumn("__mix_u", hashed_uniform(F.lit(seed), F.col(key)))
    drawn = drawn.withColumn("__mix_n", poisson_number(F.col("__mix_u"))).where("__mix_n > 0")
    copies = drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), F.col(key), F.col("copy"))
    return copies.withColumn("__mix_place", place).repartition("__mix_place").sortWithinPartitions("__mix_place", key, "copy").drop("__mix_place")


#: Weights of the query: four times the standard weight for one source, half of it for another.
WEIGHTS = {"src3": 4.0, "src5": 0.5}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


def mixing_sql(docs: str, columns: str, weights: dict | None = None, default: float = 1.0, seed: int = SEED) -> str:
    """DuckDB SQL for mix() over the relation `docs`."""
    cases = "".join(f" WHEN source = '{s}' THEN {float(w)}" for s, w in (weights or {}).items())
    weight = f"CASE{cases} ELSE {float(default)} END" if cases else str(float(default))
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, {weight} AS weight FROM {docs} GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * CAST(sum(n) OVER () AS DOUBLE) / n AS rate FROM counts),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS p FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1.0), p + exp(log_p + ln(rate) - ln(k + 1.0))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
tables AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len([c FOR c IN ps IF c <= CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0]) AS copies
  FROM {docs} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT {columns}, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM drawn
"""


QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLE_SQL = {"op1_source_mixing": mixing_sql("documents", "doc_id, text, lang, source, n_chars", WEIGHTS)}
