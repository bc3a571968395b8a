"""Indexes and ranked retrieval: BM25 postings, exact nearest neighbours, exact entities and rank fusion.

Hits are rows ``query_id, rank, chunk_id, score, method``; every ranking has a total order (score, then chunk_id or the order of the
lists). Scores are rounded before they rank, so that the order doesn't depend on the order of additions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.plans.scratch import scratch_dir

from .best import K1, B, Nearest, Scored

EPSILON = 0.25
#: Terms of questions that travel to the tasks at once.
MOST_ASKED = 500_000
RRF_K = 60


def top_k(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The best k rows of each query with their rank; the filter on row_number lets Spark cut groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


# --- BM25 -------------------------------------------------------------------------------------------------------------


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, dl of ``chunks(chunk_id, text)``; dl is the number of tokens of the chunk."""
    each = chunks.select("chunk_id", tokens("text").alias("__t")).select("chunk_id", F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    return each.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl: tokens of every chunk, none included."""
    return chunks.select("chunk_id", F.size(tokens("text")).alias("dl"))


def totals(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean number of tokens, avgdl."""
    return chunk_lengths(chunks).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """term, df: each chunk names a term once, so counts are reduced where the texts lie."""
    return chunks.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(frequencies: DataFrame, whole: DataFrame) -> DataFrame:
    """term, df, idf out of ``frequencies(term, df)`` and the one row of ``totals``. A negative idf becomes EPSILON times the mean over all terms, negative ones included."""
    df = frequencies.select("term", "df").crossJoin(F.broadcast(whole.select("n")))
    raw = df.select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of ``queries(query_id, question)``; repeated terms count."""
    return queries.select("query_id", F.explode(tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows to be broadcast if they are few enough: counted first, as far as it takes to know."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def weighed(met: DataFrame, k: int) -> DataFrame:
    """Ranked hits of postings that have met question terms: query_id, chunk_id, qtf, idf, tf, dl, avgdl."""
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    return top_k(scored, k, F.desc("score"), F.asc("chunk_id")).withColumn("method", F.lit("bm25"))


def scored(asked: DataFrame, chunks: DataFrame, avgdl: float, k: int, tokenised: bool = False, prune: bool = True) -> DataFrame:
    """Ranked hits of ``asked(query_id, term, qtf, idf)`` over postings (chunk_id, term, tf, dl) of its terms that are dealt by chunk, or over chunks with all their tokens if ``tokenised``.

    A chunk's score is added up in one task: pairs of a question and a chunk are never shuffled, and chunks with their tokens not at all.
    """
    kinds = dict(asked.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    if not tokenised:
        chunks = chunks.select("chunk_id", "term", "tf", "dl").sortWithinPartitions("chunk_id")

    def found(block: DataFrame) -> DataFrame:
        own = Scored(block.select("query_id", "term", "qtf", "idf").toArrow(), avgdl, k, prune)
        return chunks.mapInArrow(own.of_texts if tokenised else own.of_postings, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")

    hits = [top_k(found(b), k, F.desc("score"), F.asc("chunk_id")) for b in blocks_of(asked, asked.count(), MOST_ASKED)]
    return reduce(DataFrame.unionByName, hits).withColumn("method", F.lit("bm25"))


def counted_terms(chunks: DataFrame) -> DataFrame:
    """term, df, avgdl, written: document frequencies as of ``document_frequencies`` and, under the null term, the row of ``totals``; texts are tokenised once for both."""
    found = chunks.select(tokens("text").alias("__t"))
    # The null term stands for the chunk itself, so that chunks are counted with their terms.
    own = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("__t"), F.array().cast("array<string>")))
    each = found.select(F.size("__t").alias("dl"), F.explode(own).alias("term"))
    to = scratch_dir(chunks.sparkSession, "terms")
    each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("avgdl")).write.parquet(to)
    return chunks.sparkSession.read.schema("term string, df bigint, avgdl double").parquet(to)


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Okapi BM25 over all chunks; hits with a positive score. Without a stored index; no text and no posting is shuffled, but the terms' frequencies."""
    counts = counted_terms(chunks)
    whole = counts.where("term IS NULL").select(F.col("df").alias("n"), "avgdl")
    to = scratch_dir(chunks.sparkSession, "asked")
    stats = term_stats(counts.where("term IS NOT NULL"), whole)
    query_terms(queries).join(stats.select("term", "idf"), "term").crossJoin(F.broadcast(whole.select("avgdl"))).write.parquet(to)
    asked = chunks.sparkSession.read.parquet(to)
    avgdl = asked.agg(F.first("avgdl")).first()[0] or 1.0
    return scored(asked, chunks.select("chunk_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens")), avgdl, k, True)


def write_bm25(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the index: postings by bucket of their term, sorted by term within a file, term statistics and totals."""
    spark = chunks.sparkSession
    own = postings(chunks).withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    # A term of a third of all postings is many rows of one bucket; rebalancing splits it over files.
    own.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(own.schema).parquet(f"{path}/postings")
    totals(chunks).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/totals")
    whole = spark.read.parquet(f"{path}/totals")
    term_stats(stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")), whole).sort("term").write.mode("overwrite").parquet(f"{path}/terms")


def read_bm25(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Postings, term statistics and totals of a stored index; None where there is none."""
    try:
        return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "totals"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def bm25_stored(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The same hits from a stored index: question terms read their buckets only. Without an index there are no hits."""
    spark = queries.sparkSession
    stored = read_bm25(spark, path)
    if stored is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int, method string")
    posted, terms, whole = stored
    row = whole.first()
    asked = query_terms(queries).join(terms.select("term", "idf"), "term").withColumn("bucket", F.pmod(F.hash("term"), F.lit(row["buckets"])).cast("int"))
    to = scratch_dir(spark, "asked")
    asked.write.parquet(to)
    asked = spark.read.parquet(to)
    where = [r[0] for r in asked.select("bucket").distinct().collect()]  # buckets
    own = posted.where(F.col("bucket").isin(where)).join(small(asked.select("term").distinct()), "term", "left_semi")
    return scored(asked, own.select("chunk_id", "term", "tf", "dl").repartition("chunk_id"), row["avgdl"] or 1.0, k)


# --- dense ------------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def blocks_of(rows: DataFrame, size: int, most: int) -> list[DataFrame]:
    """``rows`` by blocks of about ``most`` at most, of ``size`` in all; all rows of a question are in one block."""
    n = 1 if size <= most else -(-2 * size // most)
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, most_bytes: int = 32 << 20) -> DataFrame:
    """The k nearest of ``vectors(chunk_id, embedding)`` by cosine distance for each of ``queries(query_id, embedding)``, exactly.

    A stated set of queries meets all vectors: blocks of queries of about ``most_bytes`` of vectors at most travel to the tasks, where they
    meet the vectors as matrix products, and each task keeps k hits for each query. Vectors that are null, zero or hold null or non-finite
    components take no part, and only vectors of as many components meet.
    """
    asked = queries.select("query_id", "embedding")
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0)).alias("n")).first()["n"]
    return near(blocks_of(asked, size, most_bytes), vectors.select("chunk_id", "embedding"), k)


def near(blocks: list[DataFrame], vectors: DataFrame, k: int) -> DataFrame:
    """Ranked hits of blocks of questions, each of bounded size."""
    kinds = dict(blocks[0].dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    met = [vectors.mapInArrow(Nearest(b.toArrow(), k).run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double") for b in blocks]
    hits = [top_k(m, k, F.asc("score"), F.asc("chunk_id")) for m in met]
    return reduce(DataFrame.unionByName, hits).withColumn("method", F.lit("vector"))


# --- entities ---------------------------------------------------------------------------------------------------------

ENTITY = r"\b([A-Z0-9_]{4,20})\b"


def query_entities(queries: DataFrame) -> DataFrame:
    """query_id, name, ord: distinct upper-case identifiers of a question in their order, without further checks."""
    names = F.array_distinct(F.regexp_extract_all("question", F.lit(ENTITY), F.lit(1)))
    return queries.select("query_id", F.posexplode(names).alias("ord", "name"))


def entity_retrieve(queries: DataFrame, located: DataFrame, k: int = 5) -> DataFrame:
    """Chunks that hold an identifier of the question, by ``located(entity_name, chunk_id)``; all score 1."""
    met = query_entities(queries).join(located.select(F.col("entity_name").alias("name"), "chunk_id"), "name")
    first = met.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"))
    hits = top_k(first, k, F.asc("ord"), F.asc("chunk_id"))
    return hits.select("query_id", "rank", "chunk_id", F.lit(1.0).alias("score"), F.lit("entity").alias("method"))


# --- fusion -----------------------------------------------------------------------------------------------------------


def rrf(lists: list[DataFrame], k: int = 5, constant: int = RRF_K, payload: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the lists.

    Methods are joined in list order, one that is already part of the text being left out; payload columns come from the first list
    that has the chunk; ties go by the first list and the rank there. Returned scores are min-max normalised over a query's k hits
    (unchanged where they are all alike); ``raw`` keeps the sum.
    """
    cols = ["query_id", "rank", "chunk_id", "method", *payload]
    each = reduce(DataFrame.unionByName, [x.select(*cols, F.lit(i).alias("list")) for i, x in enumerate(lists)])
    part = F.struct("list", "rank", "method", *payload)
    got = each.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 9).alias("raw"), F.sort_array(F.collect_list(part)).alias("__parts"))
    joined = F.aggregate("__parts", F.lit(""), lambda s, x: F.when(s == "", x["method"]).when(F.contains(s, x["method"]), s).otherwise(F.concat(s, F.lit("+"), x["method"])))
    first = F.element_at("__parts", 1)
    got = got.select("query_id", "chunk_id", "raw", joined.alias("method"), first["list"].alias("__list"), first["rank"].alias("__rank"), *[first[c].alias(c) for c in payload])
    best = top_k(got, k, F.desc("raw"), F.asc("__list"), F.asc("__rank"), F.asc("chunk_id"))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    score = F.when(hi == lo, F.col("raw")).otherwise(F.round((F.col("raw") - lo) / (hi - lo), 6))
    return best.select("query_id", "rank", "chunk_id", "raw", score.alias("score"), "method", *payload)
