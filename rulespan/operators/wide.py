"""Joins on one key whose result is much larger than what is joined.

Rows of a key meet in as many slices as their pairs need: at each key the relation with most rows is cut by the hash of the row, and the
others are repeated for each slice.  So a task gives about ``SLICE`` rows however many a key has, and what is shuffled stays small
beside the result.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.shared import input_bytes, work_dir

SLICE = 1 << 23  # rows of the result
MULTIPLES = 4  # a result of more than that many times its input is wide
LEAST_BYTES = 1 << 30  # below that product of sizes there is nothing to gain
MOST_PARTITIONS = 10_000
_SLICE, _SLICES, _CUT = "__slice", "__slices", "__cut"


def multiplies(frames: list[DataFrame], on: list[str]) -> bool:
    """An estimate, by one pass over the keys without a shuffle: the result is wide where keys are about evenly used."""
    bytes_, rows, keys = 1, [], []
    for df in frames:
        bytes_ *= max(1, input_bytes(df))
    if bytes_ < LEAST_BYTES:
        return False
    for df in frames:
        n, k = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*on))).first()
        rows.append(n)
        keys.append(max(1, k))
    return reduce(lambda a, b: a * b, rows) / max(keys) ** (len(rows) - 1) > max(SLICE, MULTIPLES * sum(rows))


def wide_join(frames: list[DataFrame], on: list[str], partitions: int | None = None) -> DataFrame:
    """The equi-join. Its columns are those of the join by names. partitions: at least so many."""
    spark = frames[0].sparkSession
    sizes = reduce(lambda a, b: a.join(b, on), (df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"__n{k}")) for k, df in enumerate(frames)))
    counts = [F.col(f"__n{k}") for k in range(len(frames))]
    product = reduce(lambda a, b: a * b, (c.cast("double") for c in counts))
    most = F.greatest(*counts)
    cut = reduce(lambda rest, k: F.when(counts[k] == most, F.lit(k)).otherwise(rest), reversed(range(len(frames))), F.lit(0))
    sizes = sizes.select(*on, product.alias("__rows"), F.least(F.ceil(product / SLICE), most).cast("int").alias(_SLICES), cut.alias(_CUT))
    path = f"{work_dir(spark, 'wide')}/keys"  # few: each has more than SLICE rows of the result
    rows = sizes.agg(F.sum("__rows")).first()[0] or 0
    sizes.filter(f"{_SLICES} > 1").select(*on, _SLICES, _CUT).write.parquet(path)
    heavy = spark.read.schema(sizes.select(*on, _SLICES, _CUT).schema).parquet(path)
    n = max(partitions or 1, min(2 * ceil(rows / SLICE), MOST_PARTITIONS))  # slices meet by chance
    placed = []
    for k, df in enumerate(frames):
        own = F.array(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(_SLICES)).cast("int"))
        every = F.sequence(F.lit(0), F.col(_SLICES) - 1)
        at = F.when(F.col(_SLICES).isNull(), F.array(F.lit(0))).when(F.col(_CUT) == k, own).otherwise(every)
        placed.append(df.join(heavy, on, "left").withColumn(_SLICE, F.explode(at)).drop(_SLICES, _CUT).repartition(n, *on, _SLICE))
    return reduce(lambda a, b: a.join(b, [*on, _SLICE]), placed).drop(_SLICE)
