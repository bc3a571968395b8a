"""Index maintenance: tables keyed by chunk, embedding with a cache, entity locations. Every change is a new DataFrame to be written."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_absent(held: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``held`` and those new rows whose key it lacks."""
    return held.unionByName(new.join(held.select(key), key, "left_anti").select(*held.columns))


def upsert(held: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return held.join(new.select(key), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))


def delete(held: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``held`` without the rows whose key is in ``gone``."""
    return held.join(gone.select(key).distinct(), key, "left_anti").select(*held.columns)


def change_counts(held: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: how many new rows an insert adds and how many it skips."""
    met = new.join(held.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return met.agg(F.count_if(F.col("__k").isNull()).alias("added"), F.count_if(F.col("__k").isNotNull()).alias("skipped"))


def reset(held: DataFrame) -> DataFrame:
    """The empty table of the same columns."""
    return held.limit(0)


def chunk_by_id(held: DataFrame, chunk_id) -> DataFrame:
    """The row of a chunk, or none."""
    return held.where(F.col("chunk_id") == F.lit(chunk_id))


def chunks_of_document(held: DataFrame, document_id: str) -> DataFrame:
    return held.where(F.col("document_id") == F.lit(document_id))


def deleted_counts(held: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """One row: how many rows a delete removes."""
    return held.join(gone.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def health(held: DataFrame) -> DataFrame:
    return held.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("document_id").alias("total_documents"))


def metadata_json(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """chunk_id, metadata: the columns as flat JSON strings; null becomes the empty string."""
    flat = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    return chunks.select("chunk_id", F.to_json(flat).alias("metadata"))


#: Keys of a stored chunk's metadata (fixed values), in their order.
METADATA_KEYS = ["chunk_id", "document_id", "document_name", "module", "section", "section_id", "heading_path", "page_start", "page_end", "entities", "processing_stage", "chunking_version", "embedding_version", "pipeline_version"]


def stored_metadata(chunks: DataFrame, stage: str = "INDEXED") -> DataFrame:
    """chunk_id, metadata: all keys in one flat JSON object. Numbers and booleans stay so, null is an empty text, nested values are JSON texts (null: an empty list)."""
    own = chunks.withColumn("processing_stage", F.lit(stage))
    kinds = dict(own.dtypes)

    def flat(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        if kinds[c].startswith(("array", "struct", "map")):
            return F.coalesce(F.to_json(F.col(c)), F.lit("[]"))
        return F.coalesce(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)

    return own.select("chunk_id", F.to_json(F.struct(*[flat(c).alias(c) for c in METADATA_KEYS])).alias("metadata"))


def locate_entities(found: DataFrame) -> DataFrame:
    """Distinct (upper-cased entity_name, chunk_id) of ``found(chunk_id, document_id, page, section, name, entity_type, ord)``, the first one staying."""
    own = found.withColumn("entity_name", F.upper("name"))
    nth = F.row_number().over(Window.partitionBy("entity_name", "chunk_id").orderBy("ord"))
    return own.withColumn("__n", nth).where("__n = 1").select("entity_name", "chunk_id", "entity_type", "document_id", "page", "section")


def lookup(located: DataFrame, name: str) -> DataFrame:
    return located.where(F.col("entity_name") == F.upper(F.lit(name)))


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + ":"), text), 256)


def split_by_cache(chunks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their vectors, and misses; an empty vector is a miss."""
    own = chunks.withColumn("key", cache_key(model, F.col("text")))
    good = cache.where(F.size("embedding") > 0).select("key", "embedding")
    return own.join(good, "key"), own.join(good, "key", "left_anti")


def hash_embedding(texts: pd.Series, dims: int = 64) -> list[np.ndarray]:
    """A deterministic embedding without a model: signed feature hashing of the words, of unit length."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dims, np.float32)
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return out


def embed(chunks: DataFrame, embedder: Callable[[pd.Series], list] = hash_embedding, batch: int = 64, retries: int = 3, backoff: float = 2.0) -> DataFrame:
    """chunk_id, embedding, error, latency of ``chunks(chunk_id, text)`` in batches.

    A batch is tried ``retries`` times, after a pause of ``backoff`` seconds that doubles; when it fails for good its rows stay, with a null
    embedding and the error. latency is the seconds that a row of the batch took.
    """

    def vectors(texts: pd.Series) -> tuple[list, str | None]:
        for k in range(retries):
            try:
                got = list(embedder(texts))
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                return got, None
            except Exception as e:  # whatever the embedder raises is a failure of its batch, and is given out as such
                failure = f"{type(e).__name__}: {e}"
                if k < retries - 1:
                    time.sleep(backoff * 2**k)
        return [None] * len(texts), failure

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                start = time.monotonic()
                got, failure = vectors(part["text"])
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": got, "error": [failure] * len(part), "latency": [(time.monotonic() - start) / len(part)] * len(part)})

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, embedding array<float>, error string, latency double")


def embed_cached(chunks: DataFrame, cache: DataFrame, model: str, embedder: Callable = hash_embedding, **how) -> DataFrame:
    """chunk_id, key, embedding, error, latency, hit: cached vectors, and new ones for each missing text once. Write the result before it is read twice."""
    hits, misses = split_by_cache(chunks, cache, model)
    texts = misses.groupBy("key").agg(F.first("text").alias("text")).select(F.col("key").alias("chunk_id"), "text")
    made = embed(texts, embedder, **how).withColumnRenamed("chunk_id", "key")
    new = misses.select("chunk_id", "key").join(made, "key").select("chunk_id", "key", "embedding", "error", "latency", F.lit(False).alias("hit"))
    old = hits.select("chunk_id", "key", "embedding", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("latency"), F.lit(True).alias("hit"))
    return old.unionByName(new)


def cache_additions(embedded: DataFrame) -> DataFrame:
    """key, embedding: what the cache lacks yet; failures are not cached."""
    return embedded.where("NOT hit AND embedding IS NOT NULL").groupBy("key").agg(F.first("embedding").alias("embedding"))


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    """The cache below a folder: rows (key, embedding). Without one, or with files of another shape, everything is a miss."""
    try:
        got = spark.read.parquet(path)
        if {"key", "embedding"} <= set(got.columns):
            return got.select("key", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["key"])
    except AnalysisException:  # no folder, or nothing in it that is Parquet
        pass
    except Py4JJavaError as e:  # files that only have the name of Parquet
        if "CANNOT_READ_FILE_FOOTER" not in str(e):
            raise
    return spark.createDataFrame([], "key string, embedding array<float>")


def write_back(embedded: DataFrame, path: str) -> None:
    """Append the new vectors of ``embed_cached`` (a written table) to the cache below ``path``."""
    cache_additions(embedded).write.mode("append").parquet(path)


def embed_metrics(embedded: DataFrame) -> DataFrame:
    """One row: hits, misses, embedded, failures, total seconds of the embedder, its mean latency and vectors a second."""
    new, failed = ~F.col("hit"), F.col("embedding").isNull()
    spent = F.sum(F.when(new, F.col("latency")))
    done = F.count_if(~failed)
    out = embedded.agg(F.count_if("hit").alias("cache_hits"), F.count_if(new).alias("cache_misses"), F.count_if(new & ~failed).alias("embedded"), F.count_if(failed).alias("failures"), F.coalesce(spent, F.lit(0.0)).alias("seconds"), done.alias("__done"))
    return out.select("cache_hits", "cache_misses", "embedded", "failures", "seconds", F.when(F.col("__done") > 0, F.col("seconds") / F.col("__done")).otherwise(0.0).alias("average_latency"), F.when(F.col("seconds") > 0, F.col("__done") / F.col("seconds")).otherwise(0.0).alias("vectors_per_second"))


def embedded_chunks(embedded: DataFrame, model: str, version: str = "1.0.0") -> DataFrame:
    """What is stored of embedded chunks: vector, model, dimension, version and latency; failures are left out."""
    return embedded.where("embedding IS NOT NULL").select("chunk_id", "embedding", F.lit(model).alias("embedding_model"), F.size("embedding").alias("embedding_dimension"), F.lit(version).alias("embedding_version"), "latency")
