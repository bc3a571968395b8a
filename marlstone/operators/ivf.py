"""Approximate nearest neighbours over inverted lists: vectors stored by their nearest centre, of which a question reads a few.

Centres come from rounds of k-means over unit vectors (so that nearness is cosine), seeded by the vectors of least SHA-256 of their id,
over a bounded sample (``sample`` vectors, again by SHA-256); every vector is assigned and stored. Lists are partitions of a Parquet table:
a question's ``probes`` nearest centres are the only partitions that are read, and what lies in them is ranked by its exact distance.
More probes give more recall, and all of them the exact answer.

The number of centres is bounded (``MOST_LISTS``), so they travel to the tasks as one matrix. A list of any size is many files and
tasks; a table of questions that is too large to be broadcast is joined by list instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import delete_path
from .retrieval import blocks_of, cosine_distance, near, small

MOST_LISTS = 4096


def _units(vectors: pa.Array) -> np.ndarray:
    """A matrix of unit rows; a row of zeros stays one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    length = np.sqrt((flat * flat).sum(1, keepdims=True))
    return flat / np.where(length > 0, length, 1)


def _nearest(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centres of greatest cosine for each row, the nearest first and of equal ones the first."""
    length = np.sqrt((centres * centres).sum(1))
    return np.argsort(-(units @ (centres / np.where(length > 0, length, 1)[:, None]).T), axis=1, kind="stable")[:, :n]


def _id_order(col: str = "chunk_id"):
    return F.sha2(F.col(col).cast("string").cast("binary"), 256)


def train(vectors: DataFrame, lists: int, rounds: int = 2, sample: int = 200_000) -> np.ndarray:
    """``lists`` centres (or as many as there are vectors) of ``vectors(chunk_id, embedding)``. A centre that loses all its vectors stays where it was."""
    if lists > MOST_LISTS:
        raise ValueError(f"at most {MOST_LISTS} lists")
    own = vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    own = own if own.limit(sample + 1).count() <= sample else own.orderBy(_id_order()).limit(sample)
    seeds = own.orderBy(_id_order(), "chunk_id").limit(lists).select("embedding").toArrow()
    if not len(seeds):
        return np.zeros((0, 0))
    centres = _units(seeds["embedding"].combine_chunks())
    for _ in range(rounds):
        sums = _sums(own, centres).groupBy("list", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # lists times components
        at, k = sums["list"].to_numpy(), sums["at"].to_numpy()
        centres = centres.copy()
        centres[at, k] = sums["total"].to_numpy() / sums["n"].to_numpy()
    return centres


def _sums(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """list, at, total, n: what a task's unit vectors under each centre add up to, component by component."""
    count, size = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((count, size)), np.zeros(count, np.int64)
        for b in batches:
            units = _units(b["embedding"])
            own = _nearest(units, centres, 1)[:, 0]
            np.add.at(total, own, units)
            n += np.bincount(own, minlength=count)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, size), pa.int32()), pa.array(np.tile(np.arange(size), len(held)), pa.int32()), pa.array(total[held].ravel()), pa.array(np.repeat(n[held], size))], names=["list", "at", "total", "n"])

    return vectors.select("embedding").mapInArrow(run, "list int, at int, total double, n bigint")


def assign(vectors: DataFrame, centres: np.ndarray, n: int = 1) -> DataFrame:
    """``vectors`` (with an embedding) and ``lists``, their ``n`` nearest centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _nearest(_units(b["embedding"]), centres, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "lists"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, lists array<int>")


def write(vectors: DataFrame, path: str, lists: int, rounds: int = 2, sample: int = 200_000) -> None:
    """Train centres and store ``vectors(chunk_id, embedding)`` by list below ``path``."""
    spark = vectors.sparkSession
    centres = train(vectors, lists, rounds, sample)
    held = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _listed(vectors, centres).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def _listed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    own = vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    return assign(own, centres).select("chunk_id", "embedding", F.col("lists")[0].alias("list"))


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    held = spark.read.parquet(f"{path}/centres").orderBy("list").limit(MOST_LISTS).toArrow()
    return _matrix(held["centre"].combine_chunks()) if len(held) else np.zeros((0, 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def add(vectors: DataFrame, path: str) -> None:
    """Store more vectors under the centres that are there."""
    spark = vectors.sparkSession
    _listed(vectors, centres_of(spark, path)).hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")


def trained(spark: SparkSession, path: str) -> bool:
    """Whether there are centres below ``path``."""
    try:
        return not spark.read.parquet(f"{path}/centres").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def remove(gone: DataFrame, path: str) -> None:
    """Take the vectors of ``gone(chunk_id)`` out; lists without one of them are left alone."""
    spark = gone.sparkSession
    held = spark.read.parquet(f"{path}/lists")
    ids = small(gone.select("chunk_id").distinct())
    touched = [r[0] for r in held.select("chunk_id", "list").join(ids, "chunk_id", "left_semi").select("list").distinct().collect()]  # at most MOST_LISTS
    if touched:
        stay = held.where(F.col("list").isin(touched)).join(ids, "chunk_id", "left_anti")
        left = {r[0] for r in stay.select("list").distinct().collect()}
        stay.select("chunk_id", "embedding", "list").hint("rebalance", "list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/lists")
        for n in set(touched) - left:
            delete_path(spark, f"{path}/lists/list={n}")


def probed(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """query_id, embedding, list: the lists that each of ``queries(query_id, embedding)`` reads."""
    own = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    return assign(own, centres_of(queries.sparkSession, path), probes).select("query_id", "embedding", F.explode("lists").alias("list"))


def candidates(queries: DataFrame, path: str, probes: int, most_bytes: int = 32 << 20) -> DataFrame:
    """query_id, chunk_id, score of everything in the lists that are read."""
    spark = queries.sparkSession
    asked = probed(queries, path, probes).withColumnRenamed("embedding", "__q")
    sizes = asked.groupBy("list").agg(F.sum(F.size("__q") * 8 + 24).alias("bytes")).collect()  # at most MOST_LISTS rows
    read = sorted(r["list"] for r in sizes)
    stored = spark.read.parquet(f"{path}/lists").where(F.col("list").isin(read))
    asked = F.broadcast(asked) if sum(r["bytes"] for r in sizes) <= most_bytes else asked
    met = stored.join(asked, "list")
    return met.select("query_id", "chunk_id", F.round(cosine_distance(F.col("__q"), F.col("embedding")), 6).alias("score"))


def search(queries: DataFrame, path: str, k: int = 5, probes: int = 8, most_bytes: int = 32 << 20) -> DataFrame:
    """The k nearest stored vectors within the probed lists of each question, like ``retrieval.knn``.

    Blocks of questions with their lists, of about ``most_bytes`` at most, travel to the tasks; pairs are never rows.
    """
    spark = queries.sparkSession
    own = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    asked = assign(own, centres_of(spark, path), probes)
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + F.size("lists") * 12 + 16), F.lit(0)).alias("n")).first()["n"]
    return near(blocks_of(asked, size, most_bytes), spark.read.parquet(f"{path}/lists").select("chunk_id", "embedding", "list"), k)


def vectors_read(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """One row: how many pairs of a question and a vector a search compares, out of the lists' sizes."""
    held = queries.sparkSession.read.parquet(f"{path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("held"))
    asked = probed(queries, path, probes).groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    return held.join(asked, "list").agg(F.coalesce(F.sum(F.col("held") * F.col("asked")), F.lit(0)).alias("vectors_read"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact hits there are, how many were found, and the quotient."""
    got = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    out = exact.select("query_id", "chunk_id").join(got, ["query_id", "chunk_id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")), 6))
