"""Tuples as text, and files of them."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def show_value(v) -> str:
    if isinstance(v, str):
        return f'"{v}"'
    if isinstance(v, tuple):
        return "(" + ", ".join(map(show_value, v)) + ")"
    return str(v)


def show_tuple(rel: str, row: Iterable) -> str:
    return f"{rel}({', '.join(map(show_value, row))})"


def show_delta(rel: str, row: Iterable, diff: int) -> str:
    return f"{'+' if diff > 0 else '-'}{show_tuple(rel, row)}"


def write_csv_file(df: DataFrame, path: str, sep: str = ",") -> int:
    """One local file without header and quotes, in streaming order: for results that one machine takes."""
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for row in df.toLocalIterator(prefetchPartitions=True):
            f.write(sep.join("" if v is None else str(v) for v in row) + "\n")
            n += 1
    return n


def write_csv_folder(df: DataFrame, path: str, sep: str = ",") -> None:
    """The same lines, a file for each partition, written by the executors."""
    df.select(F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_output(df: DataFrame, params: dict[str, str], base_dir: str = ".") -> None:
    """io: csv (one file, the default), csv_folder or parquet."""
    name = params.get("filename") or ""
    path = name if os.path.isabs(name) or "://" in name else os.path.join(base_dir, name)
    scheme = params.get("io", params.get("IO", "csv"))
    sep = params.get("delimiter", ",")
    sep = "\t" if sep == "\\t" else sep
    if scheme == "parquet":
        write_parquet(df, path)
    elif scheme == "csv_folder":
        write_csv_folder(df, path, sep)
    else:
        write_csv_file(df, path, sep)
