"""Signed relations: rows with a multiplicity in a BIGINT column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.operators.wide import multiplies, wide_join

DIFF = "__diff"


def with_diff(df: DataFrame, diff: int = 1) -> DataFrame:
    return df.withColumn(DIFF, F.lit(diff).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """Multiplicities of equal rows added; rows of 0 go."""
    keys = [c for c in df.columns if c != DIFF]
    return df.groupBy(*keys).agg(F.sum(DIFF).alias(DIFF)).filter(F.col(DIFF) != 0)


def delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current - previous. Both have multiplicities or neither."""
    if DIFF not in current.columns:
        current, previous = with_diff(current), with_diff(previous)
    return consolidate(current.unionByName(previous.withColumn(DIFF, -F.col(DIFF))))


def join_weighted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join; multiplicities multiply."""
    r = right.withColumnRenamed(DIFF, "__other")
    return left.join(r, on).withColumn(DIFF, F.col(DIFF) * F.col("__other")).drop("__other")


def count_weighted(df: DataFrame) -> DataFrame:
    """count: the sum of multiplicities, 0 of an empty relation."""
    return df.agg(F.coalesce(F.sum(DIFF), F.lit(0)).alias("count"))


def set_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """What appeared (+1) and disappeared (-1) between two sets, by one shuffle of both."""
    return delta(new, old)


def multiway_join(relations: list[DataFrame], key: str, partitions: int | None = None) -> DataFrame:
    """Joins three or more relations on one key, all brought to the same partitioning once: the joins
    after it don't shuffle. Where the result is much larger than they are, there are more partitions, and keys are cut into slices (``operators.wide``)."""
    if multiplies(relations, [key]):
        return wide_join(relations, [key], partitions)
    placed = [r.repartition(partitions, key) if partitions else r for r in relations]
    return reduce(lambda a, b: a.join(b, key), placed)


def exchange(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Hash partitioning by keys."""
    return df.repartition(partitions, *keys)
