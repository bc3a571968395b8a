"""From a folder of files to documents, table-of-contents rows and blocks, with what went wrong beside them.

Files are opened in the tasks by a ``reader`` (see ``pdf``), which gives a file's parts or raises ``BadPdf``; a file that can't be read
costs no other file anything. All tables come from ``opened``, which is to be written once, since opening is the expensive step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import pdf_date
from marlstone.operators import parsing
from marlstone.sources import corpus
from marlstone.sources.pdf import INVALID, NOT_A_FILE, NOT_FOUND, BadPdf, read_pdf

_FIELDS = ("title", "author", "subject", "keywords", "producer", "creator", "creationDate", "modDate")
PARTS = f"error_class string, error string, page_count int, metadata struct<{', '.join(f'{f}: string' for f in _FIELDS)}>, toc array<array<string>>, spans array<struct<page: int, block: int, span: int, size: double, text: string, kind: int>>"


def check_path(spark: SparkSession, path: str) -> str | None:
    """What is wrong with a single file's path before it is opened: not_found, not_a_file or nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return NOT_FOUND if not fs.exists(at) else None if fs.getFileStatus(at).isFile() else NOT_A_FILE


def open_files(files: DataFrame, reader: Callable[[bytes], dict] = read_pdf) -> DataFrame:
    """``files`` without content, with error_class and error, or else page_count, metadata, toc and spans."""
    keep = [f for f in files.schema.fields if f.name != "content"]
    names = [f.name for f in keep]

    def parts(content: bytes) -> tuple:
        try:
            got = reader(content)
        except BadPdf as e:
            return e.kind, str(e), None, None, None, None
        except Exception as e:  # a reader's own failure is that file's
            return INVALID, f"{type(e).__name__}: {e}", None, None, None, None
        meta = {f: got["metadata"].get(f) for f in _FIELDS}
        spans = [dict(zip(("page", "block", "span", "size", "text", "kind"), s, strict=True)) for s in got["spans"]]
        return None, None, got["page_count"], meta, got["toc"], spans

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(len(f)):  # a file at a time: files are large and of any size
                own = f.iloc[k : k + 1]
                made = dict(zip(("error_class", "error", "page_count", "metadata", "toc", "spans"), parts(own["content"].iloc[0]), strict=True))
                yield own[names].reset_index(drop=True).assign(**{c: pd.Series([v], dtype=object) for c, v in made.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return files.mapInPandas(run, f"{schema}, {PARTS}")


def good(opened: DataFrame) -> DataFrame:
    """Files that could be opened."""
    return opened.where("error_class IS NULL").drop("error_class", "error")


def failures(opened: DataFrame) -> DataFrame:
    """filename, error_class, error of the files that are skipped."""
    return opened.where("error_class IS NOT NULL").select("filename", "error_class", "error")


def toc_rows(opened: DataFrame) -> DataFrame:
    """document_id, ord, level, title, page; entries that lack one of the three are left out."""
    each = good(opened).select(F.col("sha256").alias("document_id"), F.posexplode("toc").alias("at", "e")).where("size(e) >= 3")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("at"))
    return each.select("document_id", nth.alias("ord"), F.col("e")[0].cast("int").alias("level"), F.col("e")[1].alias("title"), F.col("e")[2].cast("int").alias("page"))


def document_metadata(opened: DataFrame) -> DataFrame:
    """document_id and its metadata: unknown texts are empty, dates without an offset null."""
    text = [F.coalesce(F.col(f"metadata.{f}"), F.lit("")).alias(f) for f in _FIELDS[:6]]
    return good(opened).select(F.col("sha256").alias("document_id"), *text, pdf_date(F.col("metadata.creationDate")).alias("creation_date"), pdf_date(F.col("metadata.modDate")).alias("modification_date"), "page_count")


def blocks(opened: DataFrame) -> DataFrame:
    """document_id, page, block_index, type, level, text: headings, texts and figures; the index counts from 0 what is kept of a page."""
    spans = good(opened).select(F.col("sha256").alias("document_id"), F.explode("spans").alias("s")).select("document_id", "s.*")
    texts = parsing.span_blocks(spans.where("kind = 0").drop("kind")).where("text <> ''")
    return parsing.kept_blocks(texts, spans.where("kind = 1").select("document_id", "page", "block").distinct())


def documents(opened: DataFrame) -> DataFrame:
    """One row per readable file: document_id (its checksum), filename, path, sizes, times, metadata and numbers of pages and words."""
    words = parsing.page_counts(blocks(opened)).groupBy("document_id").agg(F.sum("word_count").alias("word_count"))
    files = good(opened).select(F.col("sha256").alias("document_id"), "filename", F.col("path").alias("absolute_path"), "sha256", "file_size_bytes", "last_modified", F.lit(None).cast("timestamp").alias("created_time"), "mime_type")
    out = files.join(document_metadata(opened), "document_id").join(words, "document_id", "left")
    return out.withColumn("word_count", F.coalesce("word_count", F.lit(0)))


#: Files whose paths the driver holds at once to open them.
PATHS_AT_ONCE = 10_000


def new_files(files: DataFrame, held: DataFrame | None) -> DataFrame:
    """path, sha256 of the files whose checksum a manifest does not have; of equal files the one of the least path. No content is moved."""
    own = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return own if held is None else own.join(held.select("sha256").distinct(), "sha256", "left_anti")


def unseen(files: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Files that no earlier run has read, by path, size and time of change; their content isn't asked for to know that."""
    return files if seen is None else files.join(seen.select("path", "file_size_bytes", "last_modified"), ["path", "file_size_bytes", "last_modified"], "left_anti")


# Manifest ----------------------------------------------------------------------------------------------------------------


def write_manifest(docs: DataFrame, path: str) -> None:
    """A JSON row for each document and one with the totals, below ``path``."""
    rows = docs.select(F.col("document_id").alias("id"), "filename", "sha256", "file_size_bytes", F.col("page_count").alias("pages"), F.lit(False).alias("indexed"))
    rows.write.mode("overwrite").json(f"{path}/documents")
    whole = corpus.manifest(docs).withColumn("ingestion_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    whole.write.mode("overwrite").json(f"{path}/totals")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents of a manifest; None where there is none or it can't be read. Rows that are no JSON are left out."""
    schema = "id string, filename string, sha256 string, file_size_bytes bigint, pages int, indexed boolean"
    try:
        return spark.read.schema(schema).json(f"{path}/documents").where("sha256 IS NOT NULL")
    except AnalysisException:
        return None


def _seen(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("path string, file_size_bytes bigint, last_modified timestamp, sha256 string").parquet(f"{path}/manifest/seen")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _paths(rows: DataFrame) -> Iterator[list[str]]:
    """Paths in bounded lists."""
    held: list[str] = []
    for r in rows.select("path").toLocalIterator():
        held.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]))  # a name is no pattern
        if len(held) == PATHS_AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def parts(opened: DataFrame) -> dict[str, DataFrame]:
    """What opened files hold, by name."""
    return {"documents": documents(opened), "toc": toc_rows(opened), "blocks": blocks(opened), "failures": failures(opened)}


def read_new(spark: SparkSession, root: str, path: str, glob: str = "*.pdf", reader: Callable[[bytes], dict] = read_pdf) -> dict[str, DataFrame]:
    """Open the files below ``root`` that are new to the manifest of ``path``, write what they hold below ``path`` and give it back by name.

    Files that were seen before under their path, size and time are not read; the others are read once for their checksums, and those
    with new ones once more to be opened. ``remember`` makes them known.
    """
    held = read_manifest(spark, f"{path}/manifest")
    listed = unseen(corpus.scan_files(spark, root, glob).select("path", "file_size_bytes", "last_modified"), _seen(spark, path))
    listed.write.mode("overwrite").parquet(f"{path}/unseen")
    schema = "path string, file_size_bytes bigint, last_modified timestamp, sha256 string"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/hashed")
    for names in _paths(spark.read.parquet(f"{path}/unseen")):
        corpus.scan_files(spark, names, glob).select("path", "file_size_bytes", "last_modified", "sha256").write.mode("append").parquet(f"{path}/hashed")
    new_files(spark.read.schema(schema).parquet(f"{path}/hashed"), held).write.mode("overwrite").parquet(f"{path}/new")
    open_files(corpus.scan_files(spark, root, glob).limit(0), reader).write.mode("overwrite").parquet(f"{path}/opened")
    for names in _paths(spark.read.parquet(f"{path}/new")):
        open_files(corpus.scan_files(spark, names, glob), reader).write.mode("append").parquet(f"{path}/opened")
    made = parts(spark.read.parquet(f"{path}/opened"))
    for name, rows in made.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in made}


def remember(spark: SparkSession, path: str, made: dict[str, DataFrame]) -> None:
    """Add what ``read_new`` has given out to the manifest, which keeps the documents of earlier runs, and all files it has read to those that are seen."""
    held = read_manifest(spark, f"{path}/manifest")
    listed = made["documents"].select("document_id", "filename", "sha256", "file_size_bytes", "page_count", "word_count")
    if held is not None:
        earlier = held.select(F.col("id").alias("document_id"), "filename", "sha256", "file_size_bytes", F.col("pages").alias("page_count"), F.lit(None).cast("bigint").alias("word_count"))
        # Written beside the old manifest, which this one is made from.
        listed.unionByName(earlier.join(listed.select("sha256"), "sha256", "left_anti")).write.mode("overwrite").parquet(f"{path}/listed")
        listed = spark.read.parquet(f"{path}/listed")
    write_manifest(listed, f"{path}/manifest")
    spark.read.parquet(f"{path}/hashed").write.mode("append").parquet(f"{path}/manifest/seen")


def ingest(spark: SparkSession, root: str, path: str, glob: str = "*.pdf", reader: Callable[[bytes], dict] = read_pdf) -> dict[str, DataFrame]:
    """``read_new`` and ``remember``: documents, toc, blocks and failures of this run."""
    made = read_new(spark, root, path, glob, reader)
    remember(spark, path, made)
    return made
