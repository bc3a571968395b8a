"""An index that changes in place: chunks, and with them their vectors, entities, BM25 postings and inverted lists.

Chunks, vectors and entities are bucketed by document (``buckets``), so a change rewrites the buckets of the documents it touches and no
other file. Postings change by segments (``segments``), inverted lists by list (``ivf``, if there are any). Chunks are written last: they say
what has been done, so a change that fails half-way is done whole when it is tried again, and one that is done again changes nothing.
A chunk id belongs to one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.scratch import scratch_dir

from . import ivf, segments
from .buckets import BUCKETS, bucket_of, change_rows, delete_path, keys_at_once, read_table
from .retrieval import small

#: Columns of a chunk that lookups ask for by value.
_BLOOMS = {"chunks": ("chunk_id", "document_id"), "vectors": ("chunk_id",), "entities": ("entity_name", "chunk_id")}
_SORTS = {"chunks": ["document_id", "chunk_id"], "vectors": ["chunk_id"], "entities": ["entity_name", "chunk_id"]}


def table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """chunks, vectors or entities as they are now, without what only changes use."""
    held = read_table(spark, f"{path}/{name}")
    return None if held is None else held.drop("bucket", "row_sha")


def _with_sha(chunks: DataFrame) -> DataFrame:
    """A chunk's digest, by which a change of it is told from a repetition; column names are part of it, their order isn't."""
    return chunks.withColumn("row_sha", F.sha2(F.to_json(F.struct(*sorted(chunks.columns)), {"ignoreNullFields": "false"}), 256))


def _of_documents(held: DataFrame, documents: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``held`` of the documents, out of their buckets alone."""
    ids = documents.select("document_id").distinct()
    where = [r[0] for r in ids.select(bucket_of("document_id", buckets)).distinct().collect()]
    return held.where(F.col("bucket").isin(where)).join(small(ids), "document_id", "left_semi")


def _changed(own: DataFrame, changed: DataFrame, some: bool, to: str) -> DataFrame:
    """The rows of ``own`` that are in ``changed(chunk_id, bucket, row_sha)``, which may be only some of them, as a table: they may come from the one that is to change."""
    if not some:
        own.write.parquet(to)
    else:
        for where, keys in keys_at_once(changed.distinct()):
            own.where(F.col("bucket").isin(where)).join(keys, ["chunk_id", "bucket", "row_sha"], "left_semi").write.mode("append").parquet(to)
    return own.sparkSession.read.parquet(to)


def apply(spark: SparkSession, path: str, chunks: DataFrame | None = None, vectors: DataFrame | None = None, entities: DataFrame | None = None, gone_chunks: DataFrame | None = None, gone_documents: DataFrame | None = None, replace: bool = True, whole_documents: bool = False, buckets: int = BUCKETS) -> dict[str, int]:
    """Delete, then insert or update; how many chunks were added, updated, skipped and deleted.

    ``chunks(chunk_id, document_id, text, ...)`` come with ``vectors(chunk_id, embedding, ...)`` and ``entities(entity_name, chunk_id, ...)``.
    Of chunks that are there those that differ are updated if ``replace`` and else skipped, equal ones are skipped. With
    ``whole_documents`` what else the documents had is deleted. ``gone_chunks(chunk_id)`` and ``gone_documents(document_id)`` name what is deleted.

    ``chunks`` is read more than once, first for digests alone: texts of chunks that are skipped go nowhere.
    """
    held = read_table(spark, f"{path}/chunks")
    work = scratch_dir(spark, "change")
    kinds = dict((held if held is not None else chunks).dtypes) if held is not None or chunks is not None else None
    if kinds is None:
        return {"added": 0, "updated": 0, "skipped": 0, "deleted": 0}
    none = spark.createDataFrame([], f"chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}")
    go = none
    if held is not None:
        keys = held.select("chunk_id", "document_id", "bucket", "row_sha")
        if gone_chunks is not None:
            go = go.unionByName(keys.join(small(gone_chunks.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "document_id"))
        if gone_documents is not None:
            go = go.unionByName(_of_documents(keys, gone_documents, buckets).select("chunk_id", "document_id"))
    if chunks is not None:
        own = _with_sha(chunks).withColumn("bucket", bucket_of("document_id", buckets))
        if held is None:
            met = own.select("chunk_id", "bucket", "row_sha").withColumn("__was", F.lit(None).cast("string"))
        else:
            before = _of_documents(keys, chunks, buckets).join(small(go.select("chunk_id").distinct()), "chunk_id", "left_anti")
            met = own.select("chunk_id", "bucket", "row_sha").join(before.select(F.col("chunk_id").alias("__id"), F.col("row_sha").alias("__was")), F.col("chunk_id") == F.col("__id"), "left").drop("__id")
            if whole_documents:
                go = go.unionByName(before.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "document_id"))
        state = F.when(F.col("__was").isNull(), "added").when((F.col("__was") == F.col("row_sha")) | F.lit(not replace), "skipped").otherwise("updated")
        met.withColumn("__state", state).drop("__was").write.mode("overwrite").parquet(f"{work}/states")
    go.distinct().withColumn("bucket", bucket_of("document_id", buckets)).write.mode("overwrite").parquet(f"{work}/gone")
    gone = spark.read.parquet(f"{work}/gone")
    counts = {"added": 0, "updated": 0, "skipped": 0, "deleted": gone.count()}
    new = None
    changed = none.select("chunk_id").withColumn("bucket", F.lit(None).cast("int"))
    if chunks is not None:
        states = spark.read.parquet(f"{work}/states")
        counts |= {r["__state"]: r["n"] for r in states.groupBy("__state").agg(F.count(F.lit(1)).alias("n")).collect()}
        changed = states.where("__state <> 'skipped'").drop("__state")
        if counts["added"] + counts["updated"]:
            new = own if held is None else _changed(own, changed, counts["skipped"] > 0, f"{work}/new")
        changed = changed.select("chunk_id", "bucket")
    away = gone.select("chunk_id", "bucket").unionByName(changed).distinct()
    if new is not None or counts["deleted"]:
        segments.change(spark, f"{path}/bm25", None if new is None else new.select("chunk_id", "text"), away)
        for name, rows in (("vectors", vectors), ("entities", entities)):
            if rows is not None and new is not None:
                rows = rows.join(changed, "chunk_id")
                rows.write.mode("overwrite").parquet(f"{work}/{name}")
                rows = spark.read.parquet(f"{work}/{name}")
            else:
                rows = None
            change_rows(spark, f"{path}/{name}", rows, away, "chunk_id", _SORTS[name], _BLOOMS[name])
        if ivf.trained(spark, f"{path}/ivf"):
            ivf.remove(away.select("chunk_id"), f"{path}/ivf")
            if vectors is not None and new is not None:
                ivf.add(spark.read.parquet(f"{work}/vectors").select("chunk_id", "embedding"), f"{path}/ivf")
        change_rows(spark, f"{path}/chunks", new, away, "chunk_id", _SORTS["chunks"], _BLOOMS["chunks"])
    delete_path(spark, work)
    return counts


def chunk_by_id(spark: SparkSession, path: str, chunk_id) -> DataFrame:
    """A chunk's row: bloom filters let the scan leave out row groups that don't have it."""
    return table(spark, path, "chunks").where(F.col("chunk_id") == F.lit(chunk_id))


def chunks_of_document(spark: SparkSession, path: str, document_id: str, buckets: int = BUCKETS) -> DataFrame:
    """A document's rows, out of its bucket alone."""
    held = read_table(spark, f"{path}/chunks")
    (at,) = spark.range(1).select(bucket_of(F.lit(document_id), buckets)).first()
    return held.where((F.col("bucket") == at) & (F.col("document_id") == F.lit(document_id))).drop("bucket", "row_sha")


def entity(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Where a name is: entities are sorted by name within a bucket, with bloom filters, so most row groups are left out."""
    return table(spark, path, "entities").where(F.col("entity_name") == F.upper(F.lit(name)))
