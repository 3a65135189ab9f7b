"""Readers by scheme: ``io="csv"`` and others in .input. The default is csv."""

from __future__ import annotations

import importlib
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AdapterError(ValueError):
    pass


@dataclass
class Context:
    """What an adapter knows of the relation that it reads."""

    spark: SparkSession
    relation: str
    schema: T.StructType
    params: dict[str, str] = field(default_factory=dict)
    base_dir: str = "."

    @property
    def ncols(self) -> int:
        return len(self.schema.fields)

    def column_type(self, k: int) -> T.DataType:
        return self.schema.fields[k].dataType

    def param(self, key: str, default: str | None = None) -> str | None:
        return self.params.get(key, default)

    def path(self) -> str:
        """The file name: as it is if absolute, else from the working directory, else from base_dir."""
        name = self.param("filename")
        if not name:
            raise AdapterError(f"{self.relation}: .input has no filename")
        if "://" in name or name.startswith(("/", "file:")) or os.path.exists(name):
            return name
        return os.path.join(self.base_dir, name)


@dataclass(frozen=True)
class Adapter:
    scheme: str
    read: Callable[[Context], DataFrame]
    validate: Callable[[Context], None] = lambda ctx: None
    description: str = ""


_adapters: dict[str, Adapter] = {}
_lock = threading.Lock()


def register_adapter(adapter: Adapter) -> None:
    with _lock:
        if adapter.scheme in _adapters:
            raise AdapterError(f"there is an adapter for {adapter.scheme}")
        _adapters[adapter.scheme] = adapter


def unregister_adapter(scheme: str) -> None:
    with _lock:
        if _adapters.pop(scheme, None) is None:
            raise AdapterError(f"no adapter for {scheme}")


def find_adapter(scheme: str) -> Adapter | None:
    return _adapters.get(scheme)


def load_plugin(name: str) -> None:
    """module or module:function; the function (default: rulespan_plugin) is called with register_adapter."""
    module, _, fn = name.partition(":")
    getattr(importlib.import_module(module), fn or "rulespan_plugin")(register_adapter)


def read_input(ctx: Context) -> DataFrame:
    params = dict(ctx.params)
    scheme = params.pop("io", None) or params.pop("IO", None) or "csv"
    params.pop("IO", None)
    adapter = find_adapter("csv" if scheme == "file" else scheme)
    if adapter is None:
        raise AdapterError(f"{ctx.relation}: no adapter for {scheme}")
    ctx = Context(ctx.spark, ctx.relation, ctx.schema, params, ctx.base_dir)
    adapter.validate(ctx)
    df = adapter.read(ctx)
    if len(df.columns) != ctx.ncols:
        raise AdapterError(f"{ctx.relation} has {ctx.ncols} columns, {scheme} gives {len(df.columns)}")
    return conform(df, ctx.schema, ctx.relation)


def conform(df: DataFrame, schema: T.StructType, relation: str = "the input", nulls: str = "raise") -> DataFrame:
    """Columns by position, with the relation's names and types; integers become BIGINT. A null, also of a value that its
    type can't hold, fails the query, or (nulls="drop") leaves its row out."""
    cols = []
    for have, want in zip(df.schema.fields, schema.fields):
        c = F.col(f"`{have.name}`")
        cols.append((c if have.dataType == want.dataType else c.cast(want.dataType)).alias(want.name))
    out = df.select(*cols)
    if nulls == "drop":
        return out.na.drop("any")
    if nulls != "raise":
        raise AdapterError(f"nulls is raise or drop, not {nulls}")
    can = [f for f, have in zip(out.schema.fields, df.schema.fields) if f.nullable or have.dataType != f.dataType]
    if not can:
        return out
    none = reduce(lambda a, b: a | b, (F.col(f"`{f.name}`").isNull() for f in can))
    return out.filter(F.when(none, F.raise_error(F.lit(f"{relation}: a value is null or of another type")).cast("boolean")).otherwise(F.lit(True)))


def separator(params: dict[str, str]) -> str:
    d = params.get("delimiter", "\t")
    return "\t" if d in ("", "\\t") else d[0]


def read_csv(ctx: Context) -> DataFrame:
    """No header; TAB unless there is a delimiter. A row with too few or many fields, or a field that isn't an integer where one is due, fails the load."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in ctx.schema.fields])
    df = (
        ctx.spark.read.schema(raw).option("sep", separator(ctx.params)).option("header", False).option("mode", "FAILFAST").option("quote", '"').option("escape", "\x00")
        .option("ignoreTrailingWhiteSpace", True).option("emptyValue", "").option("nullValue", "\x00").option("comment", "").csv(ctx.path())
    )
    cols = []
    for f in ctx.schema.fields:
        c = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        if isinstance(f.dataType, T.LongType):
            n = F.btrim(c)
            bad = F.raise_error(F.concat(F.lit(f"{ctx.relation}.{f.name}: not an integer: "), c))
            c = F.when(n.rlike(r"^[+-]?\d+$") & n.try_cast("long").isNotNull(), n.try_cast("long")).otherwise(bad.cast("long"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_parquet(ctx: Context) -> DataFrame:
    """Columns by name where all names are there, else by position."""
    df = ctx.spark.read.parquet(ctx.path())
    names = [f.name for f in ctx.schema.fields]
    return df.select(*[f"`{n}`" for n in names]) if set(names) <= set(df.columns) else df


def read_text(ctx: Context) -> DataFrame:
    """One string column: the lines."""
    return ctx.spark.read.text(ctx.path())


def read_json(ctx: Context) -> DataFrame:
    return ctx.spark.read.schema(ctx.schema).json(ctx.path())


for _scheme, _read in (("csv", read_csv), ("parquet", read_parquet), ("text", read_text), ("json", read_json)):
    _adapters[_scheme] = Adapter(_scheme, _read)
