"""Files that every executor can see, and code that every executor can import.

All working files go to the folder that the session names in
``spark.checkpoint.dir``.  Where that is unset and Spark runs in one process (tests, a laptop) a
temporary folder is made once per context and set as the checkpoint folder; on a cluster, whose executors
wouldn't see it, that is an error.  Working folders of a session go when it is closed, all others when the
driver's process ends.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent
_own: dict[str, str] = {}
_shipped: set[str] = set()
_made: set[str] = set()
MIN_SHARDS = 64


def _local(uri: str) -> str | None:
    """The path of a ``file:`` URI or a plain path; None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def shared_base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get().rstrip("/")
    app = sc.applicationId
    if app not in _own:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="rulespan-")
        atexit.register(shutil.rmtree, _own[app], True)
        sc.setCheckpointDir(_own[app])
    return _own[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    path = f"{shared_base(spark)}/rulespan-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(remove_made)
    _made.add(path)
    if (p := _local(path)) is not None:
        os.makedirs(p, exist_ok=True)
    return path


def remove_made() -> None:
    """All folders that this process made and that are still there."""
    for path in list(_made):
        try:
            remove_dir(path)
        except Exception:  # at the end of the process the file system may be gone
            pass


def remove_dir(uri: str) -> None:
    """A folder whose files nothing reads any more."""
    _made.discard(uri)
    if (p := _local(uri)) is not None:
        shutil.rmtree(p, ignore_errors=True)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.delete_dir(path)


def drop_mapped(uri: str) -> None:
    """remove_dir for files that workers mapped and won't read again: emptied first, as the disk is held until the last map of a removed file goes."""
    if (p := _local(uri)) is not None:
        for folder, _, names in os.walk(p):
            for name in names:
                os.truncate(f"{folder}/{name}", 0)
    remove_dir(uri)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of queries that begin here go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def write_file(uri: str, data: bytes | Iterable) -> None:
    """One buffer or several, one after the other. Atomic: a retried or duplicated task leaves one whole file."""
    parts = [data] if isinstance(data, bytes) else data
    if (p := _local(uri)) is not None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(tmp, p)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_output_stream(path) as f:
        for x in parts:
            f.write(x)


def open_ranges(uri: str):
    """A seekable binary file for range reads."""
    if (p := _local(uri)) is not None:
        return open(p, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_parquet_dir(spark: SparkSession, df: DataFrame, uri: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there."""
    df.write.mode("overwrite").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def input_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shard_count(df: DataFrame, per_shard: int = 24 << 20) -> int:
    """Grows with the input, so that a shard stays a bounded piece of work; small inputs have as many as there
    are partitions, MIN_SHARDS at most, so that all cores have some."""
    least = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_SHARDS)
    size = input_bytes(df)
    if size > 1 << 60:  # no statistics
        return max(least, 64)
    return max(min(least, 1 + size // (1 << 20)), size // per_shard, 1)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE_ROOT.parent))
    path = f"{work_dir(spark, 'code')}/{PACKAGE_ROOT.name}.zip"
    write_file(path, blob.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
