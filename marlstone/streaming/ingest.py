"""Incremental indexes: chunks, or whole files, that arrive in a stream are added once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.plans import verbs
from marlstone.sources import corpus, ingest
from marlstone.sources.pdf import read_pdf


def index_stream(chunks: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", available_now: bool = True) -> StreamingQuery:
    """Append new chunks of a streaming DataFrame to the Parquet table at ``path``.

    Each micro-batch keeps one row of a key and leaves out keys that the table has; a batch that is run again after a failure finds
    its rows there already.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            held = spark.read.schema(batch.schema).parquet(path).select(key)
            new = new.join(held, key, "left_anti")
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.select(*batch.columns).write.mode("append").parquet(path)

    writer = chunks.where(F.col(key).isNotNull()).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(spark: SparkSession, root: str, path: str, checkpoint: str, glob: str = "*.pdf", reader: Callable[[bytes], dict] = read_pdf, files_at_once: int = 10_000, available_now: bool = True) -> StreamingQuery:
    """Index the files that appear below ``root`` as they come, into the store at ``path``; each file is read once, over restarts too.

    The file source remembers in ``checkpoint`` which files it has given out. A micro-batch opens its files and writes what they hold under
    the batch's number; documents whose checksum an earlier batch had are left out, of equal ones in a batch the one of the least path
    stays. Files that can't be read go to ``ingested/failures`` instead. A batch that is run again after a failure writes the same tables
    again, and the store takes a document it has as it is, so nothing is there twice.
    """

    def known(batch_id: int) -> DataFrame:
        try:
            return spark.read.schema("sha256 string, batch bigint").parquet(f"{path}/ingested/known").where(F.col("batch") < batch_id)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "sha256 string, batch bigint")

    def add(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/ingested"
        ingest.open_files(batch, reader).write.mode("overwrite").parquet(f"{at}/opened/batch={batch_id}")
        opened = spark.read.parquet(f"{at}/opened/batch={batch_id}")
        ingest.failures(opened).write.mode("overwrite").parquet(f"{at}/failures/batch={batch_id}")
        new = ingest.new_files(ingest.good(opened), known(batch_id)).select("path")
        new.write.mode("overwrite").parquet(f"{at}/new/batch={batch_id}")
        chosen = opened.join(spark.read.parquet(f"{at}/new/batch={batch_id}"), "path", "left_semi")
        made = ingest.parts(chosen)
        for name in ("documents", "blocks", "toc"):
            made[name].write.mode("overwrite").parquet(f"{at}/{name}/batch={batch_id}")
        docs = spark.read.parquet(f"{at}/documents/batch={batch_id}")
        if not docs.isEmpty():
            verbs.index(spark.read.parquet(f"{at}/blocks/batch={batch_id}"), verbs.titles_of(docs), path)
        docs.select("sha256").write.mode("overwrite").parquet(f"{at}/known/batch={batch_id}")

    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(root)
    writer = corpus.file_columns(found).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
