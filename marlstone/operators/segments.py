"""A BM25 index that grows and shrinks in place: immutable segments of postings, marks of what is gone, and additive statistics.

Each change writes one segment: the postings of what it adds, marks of the chunks it takes away from earlier segments, and by how much
it changes the document frequency of each term, the number of chunks and their length. Nothing older is read but the term lists of the
chunks that go, out of the forward index, so a change costs what it changes, and no old text is tokenised again. What a reader needs
are sums over segments. ``totals`` is written last and names the segments that count, so a change that fails half-way is not there, and
is written over when it is tried again. ``merge`` makes one segment of all of them.

Postings lie in blocks: a term's postings within one window of chunks (``WINDOW`` of them at most, that lie together) with their greatest tf and
least dl, which bound what the term can add to a chunk of the window. ``blocks_read`` scores each question by its rarest terms alone, as
many as have ``RARE`` of its postings. The k-th of these scores is one that the k-th hit has at least, so windows whose bounds don't add up
to it hold no hit. A search bounds chunks in the same way, by what its task has found so far.

Tables below a path, all partitioned by ``segment``: ``forward`` (chunk_id, dl, terms; by bucket of the chunk), ``postings`` (term,
window, tf, dl, held; by bucket of the term), ``stats`` (term, df), ``marks`` (chunk_id) and ``totals`` (n, length, mean, buckets, base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.plans.scratch import scratch_dir

from .buckets import delete_path, keys_at_once
from .best import K1, B
from .retrieval import EPSILON, query_terms, scored, small, weighed

BUCKETS = 64
#: Chunks of a window, on average.
WINDOW = 64
#: Windows whose blocks are made at once.
WINDOWS_AT_ONCE = 32
#: Windows of a file of a bucket, about.
PART_WINDOWS = 1024
#: Windows whose blocks a task sorts, on average.
TASK_WINDOWS = 64
#: Share of a question's postings that are scored to learn its threshold; one term at least.
RARE = 0.25
#: Scores are rounded to a millionth; a window that comes nearer than this to the threshold is read.
_SLACK = 1e-5
#: Segments beyond which a change ends with a merge.
MOST_SEGMENTS = 8


def _bucket(col: str | Column, buckets: int) -> Column:
    return F.pmod(F.hash(col), F.lit(buckets))


def _totals(spark: SparkSession, path: str) -> list[Row]:
    """A row for each segment that counts, the oldest first; few, as merges see to it."""
    try:
        rows = spark.read.parquet(f"{path}/totals").orderBy("segment").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    base = max((r["segment"] for r in rows if r["base"]), default=-1)
    return [r for r in rows if r["segment"] >= base]


def _read(spark: SparkSession, path: str, name: str, schema: str, segments: list[int]) -> DataFrame:
    """A table's rows of the given segments; none where nothing was ever written."""
    own = spark.read.schema(schema)
    try:
        return own.parquet(f"{path}/{name}").where(F.col("segment").isin(segments))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _kind(spark: SparkSession, path: str) -> str:
    """The type of chunk ids."""
    return dict(spark.read.parquet(f"{path}/forward").dtypes)["chunk_id"]


#: Parallel arrays: a row for each term or posting would be several times as large on its way.
_TERMS = "struct<term: array<string>, tf: array<int>>"


def _held(kind: str) -> str:
    return f"struct<chunk_id: array<{kind}>, tf: array<int>, dl: array<int>>"


def _each(blocks: DataFrame, *cols: str) -> DataFrame:
    """``cols`` with chunk_id, tf and dl of each posting that blocks hold."""
    own = blocks.select(*cols, *[F.col(f"held.{c}").alias(c) for c in ("chunk_id", "tf", "dl")])
    return own.select(*cols, F.explode(F.arrays_zip("chunk_id", "tf", "dl")).alias("__x")).select(*cols, "__x.*")


def _forward(spark: SparkSession, path: str, segments: list[int], kind: str) -> DataFrame:
    return _read(spark, path, "forward", f"chunk_id {kind}, dl int, terms {_TERMS}, segment int, bucket int", segments)


def _marks(spark: SparkSession, path: str, segments: list[int], kind: str) -> DataFrame:
    """chunk_id, until: rows of a chunk in segments before ``until`` are gone."""
    own = _read(spark, path, "marks", f"chunk_id {kind}, segment int", segments)
    return own.groupBy("chunk_id").agg(F.max("segment").alias("until"))


def _alive(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows(chunk_id, segment, ...)`` that no later segment has marked."""
    gone = small(marks).withColumnRenamed("chunk_id", "__gone")
    return rows.join(gone, (F.col("chunk_id") == F.col("__gone")) & (F.col("segment") < F.col("until")), "left_anti")


def _lists(ends: np.ndarray, **values: pa.Array) -> pa.StructArray:
    """A struct of one list of each of ``values`` for each two neighbours of ``ends``."""
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in values.values()], names=list(values))


def _term_lists(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl, terms of ``chunks(chunk_id, text)``, counted where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["tokens"]
            dl = own.value_lengths().to_numpy(zero_copy_only=False)
            words = own.flatten().dictionary_encode()
            many = max(1, len(words.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(dl) + 1) * many)
            terms = _lists(ends, term=words.dictionary.take(pa.array(pair % many)), tf=pa.array(tf, pa.int32()))
            yield pa.RecordBatch.from_arrays([b["chunk_id"], pa.array(dl, pa.int32()), terms], names=["chunk_id", "dl", "terms"])

    own = chunks.select("chunk_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    return own.mapInArrow(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, dl int, terms {_TERMS}")


def _put(rows: DataFrame, path: str, name: str, segment: int, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}/segment={segment}")


#: Terms, postings and chunks of a bucket in up to ``WINDOWS_AT_ONCE`` windows, as they are shuffled: a row for each block would be several times as large.
_PACKED = "bucket int, window bigint, term array<string>, df array<int>, row array<smallint>, tf array<int>, chunk_id array<{0}>, dl array<int>".format


def _packed(lists: DataFrame, kind: str, buckets: int) -> DataFrame:
    """``lists(chunk_id, dl, terms)`` by bucket of the term: a window is ``WINDOW`` chunks that lie together, so it is made in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, WINDOWS_AT_ONCE * WINDOW):
                b = whole.slice(at, WINDOWS_AT_ONCE * WINDOW)
                terms, counts = b["terms"].field("term"), b["terms"].field("tf")
                words = terms.flatten().dictionary_encode()
                word = words.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
                bucket = np.zeros(len(words.dictionary), np.int64)
                bucket[word] = b["buckets"].flatten().to_numpy(zero_copy_only=False)
                by_bucket = np.argsort(bucket, kind="stable")
                nth = np.empty_like(by_bucket)
                nth[by_bucket] = np.arange(len(by_bucket))
                order = np.argsort(nth[word] * b.num_rows + row, kind="stable")
                df = np.bincount(nth[word], minlength=len(by_bucket))
                own, first = np.unique(bucket[by_bucket], return_index=True)
                if len(own):
                    ends = np.r_[first, len(by_bucket)]
                    postings = np.r_[0, np.cumsum(df)][ends]
                    each = np.arange(len(own) + 1) * b.num_rows
                    of = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
                    repeated = pa.array(np.tile(np.arange(b.num_rows), len(own)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int32()), pa.array(np.full(len(own), window)), of(ends, words.dictionary.take(pa.array(by_bucket))), of(ends, pa.array(df, pa.int32())),
                            of(postings, pa.array(row[order], pa.int16())), of(postings, pa.array(counts.flatten().to_numpy(zero_copy_only=False)[order], pa.int32())),
                            of(each, b["chunk_id"].take(repeated)), of(each, b["dl"].take(repeated)),
                        ],
                        names=["bucket", "window", "term", "df", "row", "tf", "chunk_id", "dl"],
                    )
                window += -(-b.num_rows // WINDOW)

    buckets_of = F.transform("terms.term", lambda t: _bucket(t, buckets))
    return lists.select("chunk_id", "dl", "terms", buckets_of.alias("buckets")).mapInArrow(run, _PACKED(kind))


def _blocks(packed: DataFrame, kind: str) -> DataFrame:
    """bucket, term, window, held of what ``_packed`` gives, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                of = lambda name: b[name].slice(k, 1).flatten()  # noqa: B023, E731
                row, chunks, dl = of("row").to_numpy().astype(np.int64), of("chunk_id"), of("dl").to_numpy()
                windows = -(-len(dl) // WINDOW)
                key = np.repeat(np.arange(len(of("df"))), of("df").to_numpy()) * windows + row // WINDOW
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                held = _lists(np.r_[starts, len(key)], chunk_id=chunks.take(pa.array(row)), tf=of("tf"), dl=pa.array(dl[row], pa.int32()))
                bucket = pa.array(np.full(len(starts), b["bucket"][k].as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [bucket, of("term").take(pa.array(key[starts] // windows)), pa.array(b["window"][k].as_py() + key[starts] % windows), held],
                    names=["bucket", "term", "window", "held"],
                )

    return packed.mapInArrow(run, f"bucket int, term string, window bigint, held {_held(kind)}")


def _put_postings(spark: SparkSession, path: str, segment: int, buckets: int, kind: str) -> None:
    lists = _forward(spark, path, [segment], kind)
    windows = max(1, lists.count() // WINDOW)
    # One shuffle, by bucket and part of it: a bucket is as many files as its windows need, and a term of most chunks is in all of them. The
    # number of tasks is given, since what is shuffled is much smaller than the blocks that a task makes of it and sorts.
    part = F.pmod(F.xxhash64("window"), F.lit(1 + windows // PART_WINDOWS))
    dealt = _packed(lists, kind, buckets).repartition(1 + windows // TASK_WINDOWS, "bucket", part)
    own = _blocks(dealt, kind).select("term", "window", F.array_max("held.tf").cast("bigint").alias("tf"), F.array_min("held.dl").alias("dl"), "held", "bucket")
    _put(own.sortWithinPartitions("bucket", "term", "window"), path, "postings", segment, "bucket")


def _mean(spark: SparkSession, path: str, segments: list[int], n: int) -> float:
    """The mean of the terms' idf before negative ones are lifted, over all terms that a chunk has."""
    held = _read(spark, path, "stats", "term string, df bigint, segment int", segments)
    if len(segments) > 1:  # a term is in a segment once
        held = held.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return held.agg(F.avg(F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))).first()[0] or 0.0


def change(spark: SparkSession, path: str, add: DataFrame | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Take the chunks of ``gone(chunk_id)`` out of the index, then put ``add(chunk_id, text)`` in; what ``gone`` names and isn't there is nothing.

    A chunk that changes is in both. A chunk that is added without being taken out must not be there yet.
    """
    whole = _totals(spark, path)
    held = [r["segment"] for r in whole]
    buckets = whole[0]["buckets"] if whole else buckets
    segment = max(held, default=-1) + 1
    if not whole and add is None:
        return
    kind = _kind(spark, path) if whole else dict(add.dtypes)["chunk_id"]
    added = spark.createDataFrame([], f"chunk_id {kind}, text string") if add is None else add.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    _put(_term_lists(added).withColumn("bucket", _bucket("chunk_id", buckets)), path, "forward", segment, "bucket")
    came = _forward(spark, path, [segment], kind)
    if gone is not None and held:
        # Term lists meet the ids where they lie, and the ids' marks, which are no more than the ids.
        delete_path(spark, f"{path}/leaving")
        for where, ids in keys_at_once(gone.select("chunk_id").distinct().withColumn("bucket", _bucket("chunk_id", buckets))):
            went = _forward(spark, path, held, kind).where(F.col("bucket").isin(where)).join(ids, ["chunk_id", "bucket"], "left_semi")
            marked = _marks(spark, path, held, kind).join(ids.select("chunk_id"), "chunk_id", "left_semi")
            _alive(went, marked).select("chunk_id", "dl", "terms").write.mode("append").parquet(f"{path}/leaving/segment={segment}")
        went = _read(spark, path, "leaving", f"chunk_id {kind}, dl int, terms {_TERMS}, segment int", [segment])
    else:
        went = spark.createDataFrame([], f"chunk_id {kind}, dl int, terms {_TERMS}")
    _put(went.select("chunk_id"), path, "marks", segment)
    _put_postings(spark, path, segment, buckets, kind)
    both = came.select("dl", "terms", F.lit(1).alias("sign")).unionByName(went.select("dl", "terms", F.lit(-1).alias("sign")))
    _put(both.select("sign", F.explode("terms.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0"), path, "stats", segment)
    net = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("length")).first()
    n = sum(r["n"] for r in whole) + net["n"]
    _commit(spark, path, segment, net["n"], net["length"], _mean(spark, path, [*held, segment], n), buckets, not held)
    delete_path(spark, f"{path}/leaving")
    if len(held) + 1 > MOST_SEGMENTS:
        merge(spark, path)


def _commit(spark: SparkSession, path: str, segment: int, n: int, length: int, mean: float, buckets: int, base: bool) -> None:
    _put(spark.createDataFrame([(n, length, mean, buckets, base)], "n bigint, length bigint, mean double, buckets int, base boolean").coalesce(1), path, "totals", segment)


def merge(spark: SparkSession, path: str) -> None:
    """One segment out of all that count; what it replaces is deleted once it counts."""
    whole = _totals(spark, path)
    if len(whole) < 2:
        return
    held, buckets, kind = [r["segment"] for r in whole], whole[0]["buckets"], _kind(spark, path)
    segment = held[-1] + 1
    lists = _alive(_forward(spark, path, held, kind), _marks(spark, path, held, kind))
    _put(lists.select("chunk_id", "dl", "terms", "bucket"), path, "forward", segment, "bucket")
    _put_postings(spark, path, segment, buckets, kind)
    stats = _read(spark, path, "stats", "term string, df bigint, segment int", held)
    _put(stats.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), path, "stats", segment)
    _commit(spark, path, segment, sum(r["n"] for r in whole), sum(r["length"] for r in whole), whole[-1]["mean"], buckets, True)
    for name in ("forward", "postings", "stats", "marks", "totals"):
        for old in held:
            delete_path(spark, f"{path}/{name}/segment={old}")


def _adds(avgdl: float) -> Column:
    """What tf and dl of a term's posting add to a score."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))


class _Search:
    """What a search reads: weighed question terms, their blocks, and the marks."""

    def __init__(self, queries: DataFrame, path: str, whole: list[Row]):
        spark = queries.sparkSession
        self.n, length = sum(r["n"] for r in whole), sum(r["length"] for r in whole)
        self.avgdl = length / self.n
        held, kind = [r["segment"] for r in whole], _kind(spark, path)
        asked = query_terms(queries)
        terms = small(asked.select("term").distinct())
        df = _read(spark, path, "stats", "term string, df bigint, segment int", held).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.ln(F.lit(self.n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        idf = df.select("term", "df", F.when(raw < 0, F.lit(EPSILON * whole[-1]["mean"])).otherwise(raw).alias("idf"))
        to = scratch_dir(spark, "asked")
        asked.join(idf, "term").withColumn("bucket", _bucket("term", whole[0]["buckets"])).write.mode("overwrite").parquet(to)
        self.weights = small(spark.read.parquet(to))
        self.buckets = [r[0] for r in self.weights.select("bucket").distinct().collect()]
        self.stored = _read(spark, path, "postings", f"term string, window bigint, tf bigint, dl int, held {_held(kind)}, segment int, bucket int", held)
        self.marks = _marks(spark, path, held, kind)

    def blocks(self, weights: DataFrame | None = None) -> DataFrame:
        return self.stored.join(self.weights if weights is None else weights, ["bucket", "term"])

    def postings(self) -> DataFrame:
        """The postings of question terms that are alive, dealt by chunk: each once, however many questions ask for it."""
        terms = small(self.weights.select("term").distinct())
        blocks = self.stored.where(F.col("bucket").isin(self.buckets)).join(terms, "term", "left_semi")
        each = _each(blocks, "segment", "term")
        return _alive(each.repartition("chunk_id"), self.marks)

    def opened(self, blocks: DataFrame) -> DataFrame:
        """The postings of blocks that are alive."""
        return _alive(_each(blocks, "query_id", "qtf", "idf", "segment"), self.marks).withColumn("avgdl", F.lit(self.avgdl))

    def thresholds(self, k: int) -> DataFrame:
        """query_id, least: the k-th score by the rarest terms alone, of questions none of whose terms takes away."""
        w = Window.partitionBy("query_id")
        by_rarity = w.orderBy(F.desc("idf"), "term")
        own = self.weights.withColumns({"__n": F.row_number().over(by_rarity), "__so_far": F.sum("df").over(by_rarity), "__all": F.sum("df").over(w), "__least": F.min("idf").over(w)})
        rarest = own.where((F.col("__least") >= 0) & ((F.col("__n") == 1) | (F.col("__so_far") <= RARE * F.col("__all")))).select(*self.weights.columns)
        return weighed(self.opened(self.blocks(small(rarest))), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))

    def windows(self, k: int) -> DataFrame:
        """query_id, segment, window whose bounds add up to the question's threshold."""
        most = self.blocks().groupBy("query_id", "segment", "window").agg(F.sum(_adds(self.avgdl)).alias("most"))
        met = most.join(self.thresholds(k), "query_id", "left")
        return met.where(F.col("most") >= F.coalesce("least", F.lit(0.0)) - _SLACK).select("query_id", "segment", "window")


def search(queries: DataFrame, path: str, k: int = 5, prune: bool = True) -> DataFrame:
    """The hits of ``retrieval.bm25`` over the chunks that are there now; question terms read their buckets only.

    Each posting of a question term is shuffled once, by its chunk, so that scores add up in one task. With ``prune`` a task leaves questions
    out whose k-th score so far the bounds of some chunks don't reach.
    """
    spark = queries.sparkSession
    whole = _totals(spark, path)
    if not sum(r["n"] for r in whole):
        return spark.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int, method string")
    own = _Search(queries, path, whole)
    return scored(own.weights, own.postings(), own.avgdl or 1.0, k, prune=prune)


def blocks_read(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """One row: blocks of the questions' terms, and how many of them a search opens after its threshold is known."""
    own = _Search(queries, path, _totals(queries.sparkSession, path))
    kept = own.windows(k).withColumn("kept", F.lit(1))
    met = own.blocks().select("query_id", "segment", "window").join(kept, ["query_id", "segment", "window"], "left")
    return met.agg(F.count(F.lit(1)).alias("blocks"), F.count("kept").alias("opened"))
