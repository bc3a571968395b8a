"""Parquet tables that change in place: rows lie in buckets of a key, and a change rewrites only the buckets that it touches.

A bucket is a partition directory. New contents of the touched ones are written with dynamic partition overwrite, so Spark swaps them in
when the write has ended and all other files stay as they are; a bucket that loses its last row is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Rows whose keys are sent to the tasks at once.
KEYS_AT_ONCE = 200_000


def bucket_of(col: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(col), F.lit(buckets)).cast("int")


def keys_at_once(keys: DataFrame) -> Iterator[tuple[list[int], DataFrame]]:
    """``keys`` (with their bucket) in parts of a few buckets each, to be broadcast, so that tables in the same buckets meet them where they lie.

    A bucket that has more than ``KEYS_AT_ONCE`` of its own is a part that isn't broadcast.
    """
    sizes = sorted((r["bucket"], r["n"]) for r in keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    own, total = [], 0
    for bucket, n in [*sizes, (None, KEYS_AT_ONCE + 1)]:
        if own and total + n > KEYS_AT_ONCE:
            part = keys.where(F.col("bucket").isin(own))
            yield own, F.broadcast(part) if total <= KEYS_AT_ONCE else part
            own, total = [], 0
        own, total = [*own, bucket], total + n


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table below ``path``, which may have no rows; None where there never was one."""
    try:
        schema = spark.read.parquet(f"{path}/schema").schema
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    try:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_rows(rows: DataFrame, path: str, sort: list[str], blooms: tuple[str, ...] = ()) -> None:
    """Put ``rows`` (with their bucket) in the place of the buckets they are of; sorted, with bloom filters on the columns of ``blooms``."""
    spark = rows.sparkSession
    if read_table(spark, path) is None:
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    writer = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy("bucket").parquet(f"{path}/rows")


def change_rows(spark: SparkSession, path: str, new: DataFrame | None, gone: DataFrame, key: str, sort: list[str], blooms: tuple[str, ...] = ()) -> None:
    """Take the rows whose ``key`` is in ``gone`` (with their bucket) out of their buckets and put ``new`` (with their bucket) in.

    ``gone`` names the rows of ``new`` as well; done twice, it is as done once. ``new`` and ``gone`` must not read this table: they are tables
    of their own. Rows that stay are shuffled once, to be sorted and written, and never to be joined.
    """
    held = read_table(spark, path)
    if held is None:
        if new is not None:
            write_rows(new, path, sort, blooms)
        return
    for touched, ids in keys_at_once(gone.select(key, "bucket").distinct()):
        own = held.where(F.col("bucket").isin(touched))
        stay = lambda rows: rows.join(ids, [key, "bucket"], "left_anti")  # noqa: B023, E731
        left = {r["bucket"] for r in stay(own.select(key, "bucket")).select("bucket").distinct().collect()}  # keys alone are read; buckets are few
        rows = stay(own).select(*held.columns)
        if new is not None:
            came = new.where(F.col("bucket").isin(touched))
            left |= {r["bucket"] for r in came.select("bucket").distinct().collect()}
            rows = rows.unionByName(came.select(*held.columns))
        write_rows(rows, path, sort, blooms)
        for b in set(touched) - left:
            delete_path(spark, f"{path}/rows/bucket={b}")
