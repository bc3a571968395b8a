"""What the operators share: intermediate tables in the shared folder, row keys and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words everywhere in this subpackage: blank, tab, LF, VT, FF, CR.
WHITESPACE = " \t\n\x0b\x0c\r"


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="marlstone-")
    return _own_dirs[app]


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written = threading.local()
_writes = {"lock": threading.Lock(), "running": 0, "before": "false"}
#: Seconds between two requests to the driver's JVM to collect its garbage.
COLLECT_S = 4.0
_collected = {"at": 0.0}


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of what is written inside go with the end of the write, as nothing else reads them, and not at some later collection of garbage.

    Writes may run on several threads: the first one changes the session's setting, the last one puts it back.
    """
    with _writes["lock"]:
        if not _writes["running"]:
            _writes["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writes["running"] += 1
    try:
        yield
    finally:
        with _writes["lock"]:
            _writes["running"] -= 1
            if not _writes["running"]:
                spark.conf.set(_CLEANUP, _writes["before"])


def _collect(spark: SparkSession) -> None:
    """What broadcasts and plans of finished writes hold in the driver and in the executors goes when the driver's JVM collects garbage, which it puts off while there is room."""
    if time.monotonic() - _collected["at"] > COLLECT_S:
        spark._jvm.System.gc()
        _collected["at"] = time.monotonic()


def materialize(df: DataFrame, name: str, codec: str = "zstd", **seen: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    ``seen`` are aggregates of what is written, observed on the way; the result has them as ``seen``.
    """
    spark = df.sparkSession
    watch = Observation()
    if seen:
        df = df.observe(watch, *[c.alias(k) for k, c in seen.items()])
    path = f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.option("compression", codec).parquet(path)
    _collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    out.seen = watch.get if seen else {}
    for scope in getattr(_written, "scopes", ()):
        scope.append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` of what ``make`` returns, after which all tables that ``make`` has materialised on the way are deleted."""
    if not hasattr(_written, "scopes"):
        _written.scopes = []
    _written.scopes.append(own := [])
    try:
        out = materialize(make(), name)
    finally:
        _written.scopes.pop()
    discard(*own[:-1])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more; one that is gone already is left alone."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; for when its results have been written."""
    _delete(spark, _tables_dir(spark))


_RESIDENT: dict = {}


def resident(key, make):
    """What a Python worker remembers between tasks: one object at a time, let go of when no task comes for ``IDLE_S``."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


#: Seconds after which a worker without a task gives its memory back.
IDLE_S = 1.5
_tasks = {"running": 0, "ended": 0.0, "watched_by": 0}


def release() -> None:
    """Give what this worker remembers, and what its allocators keep, back to the system."""
    _RESIDENT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _watch() -> None:
    released = 0.0
    while True:
        time.sleep(0.5)
        ended = _tasks["ended"]
        if not _tasks["running"] and ended > released and time.monotonic() - ended > IDLE_S:
            release()
            released = time.monotonic()


def working(batches: Iterator) -> Iterator:
    """``batches`` of a task, while which the worker counts as busy."""
    if _tasks["watched_by"] != os.getpid():
        _tasks["watched_by"] = os.getpid()
        threading.Thread(target=_watch, daemon=True).start()
    _tasks["running"] += 1
    try:
        yield from batches
    finally:
        _tasks["running"] -= 1
        _tasks["ended"] = time.monotonic()


def by_bytes(batches: Iterator[pa.RecordBatch], col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``col`` has at most ``most`` bytes, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[col]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(ends) or ends[-1] <= most:
            yield b
            continue
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType, heavy: str | None = None, most: int = 8 << 20) -> DataFrame:
    """``df.mapInArrow`` for workers that outlive their task: an idle one remembers nothing, and ``heavy`` texts come ``most`` bytes at a time."""

    def task(batches):
        return working(run(by_bytes(batches, heavy, most) if heavy else batches))

    return df.mapInArrow(task, schema)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it can be asked for, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``: the least, by its columns in their order (any, if a column has no order)."""
    if any(word in kind for _, kind in df.dtypes for word in ("map<", "variant", "interval")):
        return df.dropDuplicates(keys)
    return df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*columns_of(df))).alias("__row")).select("__row.*")
