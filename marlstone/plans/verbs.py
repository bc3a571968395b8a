"""The engine's verbs over a folder of Parquet tables: ingest and index, search, prompt, ask, benchmark, stats.

``index`` adds chunks, vectors, BM25 postings and entity locations to the store, or replaces those of documents that it has; the others read them. Questions are always a DataFrame
``query_id bigint, question string``; one question is a table of one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import answers, chunking, context, enrichment, evaluation, ivf, retrieval, segments, store
from marlstone.operators import index as tables
from marlstone.plans.scratch import scratch_dir
from marlstone.sources import ingest

PER_SOURCE = 20


def index(blocks: DataFrame, titles: DataFrame, path: str, embedder: Callable = tables.hash_embedding, model: str = "hash-64") -> dict[str, int]:
    """Add the documents of ``blocks`` to the store, in place of what it has of them; how many chunks were added, updated, skipped and deleted.

    ``blocks`` come with ``titles(document_id, title, page_count)``, which may have a filename; vectors of known texts come from the cache.
    """
    spark = blocks.sparkSession
    own = enrichment.block_sections(blocks)
    # A document without headings is one section.
    bare = own.groupBy("document_id").agg(F.max("section_ord").alias("__last"))
    own = own.join(bare, "document_id").withColumn("section_ord", F.when(F.col("__last") == 0, 1).otherwise(F.col("section_ord"))).drop("__last")
    sections = enrichment.sections(blocks, titles).select("document_id", "section_ord", "section_id", F.col("title").alias("heading"))
    files = titles if "filename" in titles.columns else titles.withColumn("filename", F.lit(""))
    modules = enrichment.classify_modules(enrichment.classified_texts(files, blocks)).select("document_id", "module")
    made = chunking.stamp(chunking.assemble(own, chunking.pack(own))).join(sections, ["document_id", "section_ord"]).join(modules, "document_id", "left")
    work = scratch_dir(spark, "index")
    made.write.mode("overwrite").parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    cache = tables.cache_table(spark, f"{path}/cache")
    tables.embed_cached(chunks, cache, model, embedder).write.mode("overwrite").parquet(f"{path}/embedded")
    embedded = spark.read.parquet(f"{path}/embedded")
    tables.write_back(embedded, f"{path}/cache")
    named = enrichment.named_entities(blocks).select("document_id", "page", "name", "entity_type", F.lit(0).alias("kind"))
    found = named.unionByName(enrichment.pattern_entities(blocks).select("document_id", "page", "name", "entity_type", F.lit(1).alias("kind")))
    held = chunking.chunk_entities(chunks, found.select("document_id", F.lit(None).cast("bigint").alias("section_ord"), "page", "name", "entity_type"))
    held = held.join(chunks.select("chunk_id", "document_id", F.col("page_start").alias("page"), F.col("heading").alias("section")), "chunk_id")
    return store.apply(spark, path, chunks, tables.embedded_chunks(embedded, model), tables.locate_entities(held.withColumn("ord", F.col("name"))), whole_documents=True)


def train_lists(spark: SparkSession, path: str, lists: int = 256) -> None:
    """Store the vectors by inverted list as well, for ``search`` with ``probes``; later changes keep the lists."""
    ivf.write(_table(spark, path, "vectors").select("chunk_id", "embedding"), f"{path}/ivf", lists)


def ingest_and_index(spark: SparkSession, root: str, path: str, **how) -> dict[str, DataFrame]:
    """Open the files of a folder that are new and index what they hold; the tables that this run's ingest has written, failures included.

    The manifest is written last, so files whose indexing has failed are taken again.
    """
    made = ingest.read_new(spark, root, f"{path}/ingested", **how)
    index(made["blocks"], titles_of(made["documents"]), path)
    ingest.remember(spark, f"{path}/ingested", made)
    return made


def titles_of(documents: DataFrame) -> DataFrame:
    """What ``index`` asks of documents: a title, or else the filename."""
    return documents.select("document_id", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("filename")).alias("title"), "page_count", "filename")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """What embedding the last index took."""
    return tables.embed_metrics(_table(spark, path, "embedded"))


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return store.table(spark, path, name) if name in ("chunks", "vectors", "entities") else spark.read.parquet(f"{path}/{name}")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, entities: bool = False, embedder: Callable = tables.hash_embedding, probes: int | None = None) -> DataFrame:
    """Fused hits with what a context needs: query_id, rank, chunk_id, document, page, heading, text, score, entities, document_id, section_id, module.

    ``probes`` asks that many inverted lists of ``train_lists`` instead of all vectors.
    """
    hits = _hits(spark, path, queries, k, entities, embedder, probes)
    return _with_payload(spark, path, hits)


def _hits(spark: SparkSession, path: str, queries: DataFrame, k: int, entities: bool, embedder: Callable, probes: int | None, seen: Observation | None = None) -> DataFrame:
    """The fused hits, written: they are few, and what follows reads them more than once. ``seen`` observes the embedding of the questions."""
    asked = tables.embed(queries.select(F.col("query_id").alias("chunk_id"), F.col("question").alias("text")), embedder)
    if seen is not None:
        asked = asked.observe(seen, F.count(F.lit(1)).alias("questions"), F.count_if(F.col("embedding").isNull()).alias("failed"), F.coalesce(F.sum("latency"), F.lit(0.0)).alias("seconds"))
    to = scratch_dir(spark, "hits")
    asked.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "embedding").write.mode("overwrite").parquet(f"{to}/asked")
    asked = spark.read.parquet(f"{to}/asked")
    dense = retrieval.knn(asked, _table(spark, path, "vectors"), PER_SOURCE) if probes is None else ivf.search(asked, f"{path}/ivf", PER_SOURCE, probes)
    lists = [dense, segments.search(queries, f"{path}/bm25", PER_SOURCE)]
    if entities:
        lists.append(retrieval.entity_retrieve(queries, _table(spark, path, "entities"), PER_SOURCE))
    retrieval.rrf(lists, k).write.mode("overwrite").parquet(f"{to}/hits")
    return spark.read.parquet(f"{to}/hits")


def _with_payload(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Chunks and entities of the hits alone: both tables are cut down to the hits' chunks before anything is grouped or shuffled."""
    ids = retrieval.small(hits.select("chunk_id").distinct())
    chunks = _table(spark, path, "chunks").join(ids, "chunk_id", "left_semi")
    names = _table(spark, path, "entities").join(ids, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_name")).alias("entities"))
    payload = chunks.select("chunk_id", F.col("document_id").alias("document"), F.col("page_start").alias("page"), F.coalesce("heading", F.lit("")).alias("heading"), "text", "document_id", "section_id", "module")
    out = hits.join(payload, "chunk_id").join(names, "chunk_id", "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def prompt(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, max_tokens: int = 4096, least: float = 0.0, mode: str = "strict", date=None) -> DataFrame:
    """query_id, prompt, estimated_tokens out of all three retrievers."""
    fit = context.within_budget(context.assemble(search(spark, path, queries, k, entities=True), least), max_tokens)
    return context.prompts(queries, context.context_xml(queries, fit), date, mode)


def ask(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, max_tokens: int = 4096, mode: str = "concise", generator: Callable[[str], str] = answers.extract_answer) -> DataFrame:
    """query_id, answer, error, label, percentage, sources for each question that has a context; the generator runs once for each."""
    fit = context.within_budget(context.assemble(search(spark, path, queries, k)), max_tokens)
    with_hits = queries.join(fit.select("query_id").distinct(), "query_id", "left_semi")
    made = context.final_prompt(context.prompts(with_hits, context.context_xml(with_hits, fit)), F.lit(mode))
    cited = context.citations(fit).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "document", "section", "page"))), lambda c: F.struct(c["document"].alias("document"), c["section"].alias("section"), c["page"].alias("page"))).alias("sources"))
    return answers.generate(made, generator).join(answers.confidence(with_hits, fit), "query_id").join(cited, "query_id")


def benchmark(spark: SparkSession, path: str, expected: DataFrame, k: int = 10, embedder: Callable = tables.hash_embedding) -> DataFrame:
    """The metrics' means over ``expected`` (query_id, question and the columns of a question set) and both latencies; an empty set raises.

    embedding_latency is what a question's embedding took, observed while the questions were embedded; retrieval_latency is the time of
    the whole retrieval, embedding included, by the number of questions, as they are answered together. failed_embeddings had no vector.
    """
    if expected.isEmpty():
        raise ValueError("the question set is empty")
    seen, start = Observation("questions"), time.monotonic()
    found = _hits(spark, path, expected.select("query_id", "question"), k, True, embedder, None, seen)
    took, asked = time.monotonic() - start, seen.get
    hits = _with_payload(spark, path, found)
    wanted = expected.select(F.col("query_id").alias("__q"), *[F.col(f"expected_{c}").alias(f"__{c}") for c in ("document", "section", "page", "keywords")])
    met = hits.join(wanted, F.col("query_id") == F.col("__q"))
    matched = evaluation.is_match(*[F.col(c) for c in ("document", "heading", "page", "text", "__document", "__section", "__page", "__keywords")])
    out = evaluation.summary(evaluation.per_query(expected, met.select("query_id", "rank", matched.alias("matched"))))
    each = 1 / max(asked["questions"], 1)
    return out.withColumns({"embedding_latency": F.lit(asked["seconds"] * each), "retrieval_latency": F.lit(took * each), "failed_embeddings": F.lit(asked["failed"])})


def stats(spark: SparkSession, path: str) -> DataFrame:
    return tables.health(_table(spark, path, "chunks"))
