"""A cleaning pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept; run() writes every stage as Parquet to the shared folder and reads it
back, so a lost executor never replays an earlier stage.

1. toxicity: documents that the classifier chain rejects go.
2. near_duplicates: of each group of near duplicates (word shingles of five, Jaccard
   similarity of 0.8 or more) the document with the least id stays.
3. repeated_passages: words covered by passages that documents with smaller ids have
   too are removed from the texts.
4. benchmark_leaks: documents in which any 13-word window of a benchmark item occurs go.
5. source_mixing: documents are repeated to their sources' target weights and
   shuffled; this adds the column `copy`.

Rows with null columns, empty texts or equal ids pass through the stages as each
operator's module defines; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm import decontaminate, jaccard_join, mixing, substring_dedup, toxicity
from brookql.llm.exchange import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.WEIGHTS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_passages),
    ("benchmark_leaks", drop_leaks),
    ("source_mixing", mix_sources),
]

#: SQL cannot express the trained classifier of the first stage; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
