"""A cleaning pipeline over ``documents``: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one with token ids besides.  ``run`` writes what a stage returns as Parquet to the
shared folder and reads it again as the next stage's docs, so that lineage ends between stages and a
lost executor costs no more than the stage at hand. What a stage has read is removed when it is written.

Defined cases are those of the operators: null and empty texts pass every stage (line
deduplication leaves them as they are, the join finds no partner for them); an
empty table stays empty; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulespan.llm import decontam, line_dedup, ngram_join, sentencepiece_sa, toxicity
from rulespan.shared import read_parquet_dir, remove_dir, work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: Toxicity, retrieval and tokens have no SQL. Tests hold line deduplication and the join against SQL and all pairs, decontamination
#: against its decision in all windows, tokens against the library; of toxicity, the field's marginals and gradient against
#: enumeration, and its decisions against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = work_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = read_parquet_dir(spark, stage(spark, docs, sf_dir), f"{folder}/{name}")
        if last:
            remove_dir(last)
        last = f"{folder}/{name}"
    return docs
