"""Relations as Parquet parts in the shared folder, to which rows are added and from which rows are taken without writing the rest again.

A part adds rows that weren't there, or (``gone``) takes rows away that the parts before it have. Large
parts are bucketed by the relation's key: what is compared with them is shuffled once, to the same buckets, and
the parts themselves never move. Small parts are read as they are, so that Catalyst broadcasts them by their size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.operators.signed import DIFF

COMPACT = 8
SMALL_ROWS = 100_000  # that many may be broadcast
FEW_ROWS = 10_000  # that many may be with the driver


@dataclass(frozen=True)
class Part:
    path: str
    n: int
    gone: bool = False
    where: str | None = None  # the rows of the files that count
    table: str | None = None  # its bucketed table


class Store:
    """keys: the columns that buckets are made of, the relation's own or those beside an aggregate."""

    def __init__(self, spark: SparkSession, schema: T.StructType, folder: str, keys: list[str] | None = None):
        self.spark, self.schema, self.folder = spark, schema, folder
        self.keys = keys if keys is not None else schema.names
        self.parts: list[Part] = []
        self.tables: list[str] = []
        self.made = 0
        self._read: dict[tuple[Part, ...], DataFrame] = {}  # the last ones: files aren't listed again for the same parts

    def _path(self) -> str:
        self.made += 1
        return f"{self.folder}/{self.made}-{uuid.uuid4().hex[:6]}"

    # --- writing

    def write(self, df: DataFrame, gone: bool = False) -> Part:
        path, seen = self._path(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        return Part(path, int(seen.get.get("n") or 0), gone)

    def write_signed(self, df: DataFrame) -> tuple[Part, Part]:
        """Rows with a multiplicity: (those that appear, those that go), in one folder."""
        path, seen = self._path(), Observation()
        count = lambda test, name: F.coalesce(F.sum(F.expr(f"if({DIFF} {test} 0, 1, 0)")), F.lit(0)).alias(name)
        df.observe(seen, count(">", "plus"), count("<", "minus")).write.mode("overwrite").parquet(path)
        n = seen.get
        return Part(path, int(n.get("plus") or 0), False, f"{DIFF} > 0"), Part(path, int(n.get("minus") or 0), True, f"{DIFF} < 0")

    def write_bucketed(self, df: DataFrame, placed: bool = False) -> Part:
        """placed: df is partitioned by the keys already, each bucket being one task's."""
        if not self.keys:
            return self.write(df)
        path, buckets = self._path(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"rulespan_{uuid.uuid4().hex}"
        if not placed:
            df = df.repartition(buckets, *[F.col(f"`{k}`") for k in self.keys])
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").bucketBy(buckets, *self.keys).option("path", path).saveAsTable(table)
        self.tables.append(table)
        return Part(path, int(seen.get.get("n") or 0), False, None, table)

    # --- reading

    def read(self, part: Part, bucketed: bool = False) -> DataFrame:
        if part.table and bucketed:
            return self.spark.table(part.table)
        if part.where:
            return self.spark.read.parquet(part.path).filter(part.where).select(*[f"`{c}`" for c in self.schema.names])
        return self.spark.read.schema(self.schema).parquet(part.path)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def of(self, parts: list[Part]) -> DataFrame:
        key = tuple(parts)
        if key not in self._read:
            if len(self._read) >= 4:
                self._read.pop(next(iter(self._read)))
            self._read[key] = self._of(parts)
        return self._read[key]

    def _of(self, parts: list[Part]) -> DataFrame:
        out = None
        for group in _groups(parts):
            rows = self._plain(group)
            if not group[0].gone:
                out = rows if out is None else out.union(rows)
            elif out is not None:
                out = out.join(rows, self.schema.names, "left_anti")
        return self.empty() if out is None else out

    def _plain(self, group: list[Part]) -> DataFrame:
        whole = [p.path for p in group if not p.where]
        rows = [self.spark.read.schema(self.schema).parquet(*whole)] if whole else []
        return reduce(DataFrame.union, rows + [self.read(p) for p in group if p.where])

    @property
    def df(self) -> DataFrame:
        return self.of(self.parts)

    @property
    def rows(self) -> int:
        return sum(-p.n if p.gone else p.n for p in self.parts)

    def absent(self, df: DataFrame, better: str | None = None) -> DataFrame:
        """Rows of df that aren't there. better: (of a relation by keys) an SQL comparison of ``__new`` with ``__old`` that tells that the
        row that is there is as good. Only df is shuffled, once, whatever the number of bucketed parts."""
        if any(p.gone for p in self.parts):
            return df.join(self.df, self.schema.names, "left_anti")
        large = [p for p in self.parts if p.table]
        rest = [p for p in self.parts if not p.table]
        others = [self.read(p, True) for p in large] + ([self._plain(rest)] if rest else [])
        for have in others:
            if better is None:
                df = df.join(have, self.schema.names, "left_anti")
            else:
                (value,) = [c for c in self.schema.names if c not in self.keys]
                old = have.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(self.schema.names)])
                at = self.schema.names.index(value)
                same = [F.col(f"`{c}`") == F.col(f"__{k}") for k, c in enumerate(self.schema.names) if c != value]
                df = df.join(old, reduce(lambda a, b: a & b, same + [F.col(f"__{at}") <= F.col(f"`{value}`") if better == "min" else F.col(f"__{at}") >= F.col(f"`{value}`")]), "left_anti")
        return df

    def absent_small(self, part: Part) -> DataFrame:
        """As absent, of rows that are written; up to SMALL_ROWS of them are broadcast, so that what is there is read but not moved."""
        df = self.read(part)
        if part.n > SMALL_ROWS or not self.parts or not self.schema.names:
            return self.absent(df)
        held = F.broadcast(df)  # at most SMALL_ROWS
        there = self.df.join(held, self.schema.names, "left_semi")
        return df.join(there, self.schema.names, "left_anti")

    # --- keeping few parts

    def add(self, *parts: Part) -> None:
        self.parts += [p for p in parts if p.n]

    def drop_tables(self) -> None:
        for t in self.tables:
            self.spark.sql(f"drop table if exists {t}")
        self.tables = []

    def compact(self, merge=None) -> None:
        """Small parts behind a large one are written as one; all of it, once they outweigh it. merge: of rows that stand for one another."""
        if len(self.parts) < COMPACT:
            return
        first, rest = self.parts[0], self.parts[1:]
        if sum(p.n for p in rest) > first.n // 2 or first.gone:
            df = self.df
            self.parts = [(self.write_bucketed if self.rows > SMALL_ROWS else self.write)(merge(df) if merge else df)]
            return
        plus = self.of(rest)
        minus = [p for p in rest if p.gone]
        large = first.table and sum(p.n for p in rest) > SMALL_ROWS
        new = (self.write_bucketed if large else self.write)(merge(plus) if merge else plus)
        gone = [self.write(self._plain(minus).distinct(), True)] if minus else []
        self.parts = [first]
        self.add(*gone, new)


def few(df: DataFrame) -> list[tuple] | None:
    """The rows, with repetitions, or None if they are more than FEW_ROWS. One job; no more than that reaches the driver."""
    row = df.limit(FEW_ROWS + 1).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("r")).collect()[0].r
    return None if len(row) > FEW_ROWS else [tuple(r) for r in row]


def local(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A relation in the plan itself, whose size Catalyst knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, columns = to_arrow_schema(schema), list(zip(*rows)) or [()] * len(schema.fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], names=schema.names), schema)


def _groups(parts: list[Part]) -> list[list[Part]]:
    out: list[list[Part]] = []
    for p in parts:
        if out and out[-1][0].gone == p.gone:
            out[-1].append(p)
        else:
            out.append([p])
    return out
