"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words (bytes between blanks, tabs, LF, VT, FF and CR, unchanged) of one document. Its minimiser is
the least hash among its ``GRAM``-word grams, the leftmost of equal ones. Consecutive windows with the same minimiser occurrence
form a super-k-mer, which travels as one packed string of its words to the bucket of its minimiser. Equal windows have equal
minimisers, at the same place within them, so

* a super-k-mer whose minimiser no other one has holds no repeated window: minimisers are counted first, over all documents, and
  only super-k-mers with a shared minimiser are packed at all;
* within a bucket, sorted by minimiser, the windows of one minimiser after another are counted exactly, as word sequences.

A minimiser that more than ``most`` super-k-mers share (a boilerplate line in a third of all documents) is not left to one task:
its packed strings are reduced to distinct ones with their number, and their windows are counted by a distributed aggregation.

Words covered by a window that starts anywhere else as well, in this document or another, are removed. Windows are judged on the
input. Intermediate rows carry (doc_id, text hash). Text moves three times: when texts meet the places of their super-k-mers that
share a minimiser, as packed strings of these, and when texts meet the words that go.

Defined results: a null text has no words; rows that repeat a document are documents of their own (so that windows of theirs
repeat); texts shorter than a window lose nothing; extra columns play no part (``dedup_texts`` keeps them); an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, settled, text_or_empty
from .word_shingles import WordHashes, windows

GRAM = 4
_KEY = "__id bigint, __fp bigint"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Where the (leftmost) least of each ``width`` neighbours stands."""
    at, done = np.arange(len(values)), 1
    values = values.copy()
    while done < width:
        step = min(done, width - done)
        n = len(values) - step
        right = values[step:] < values[:n]
        at = np.where(right, at[step:], at[:n])
        values = np.where(right, values[step:], values[:n])
        done += step
    return at


def super_kmers(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and number of windows of each super-k-mer."""
    if len(hashes) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = windows(hashes, GRAM)
    at = sliding_min(grams, size - GRAM + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[start]], start, np.diff(np.append(start, len(at)))


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("__id"), F.xxhash64(text).alias("__fp"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))


def find_super_kmers(docs: DataFrame, size: int) -> DataFrame:
    """__id, __fp, m, start, n of every super-k-mer of keyed documents."""

    def run(batches):
        memory = WordHashes()
        for b in batches:
            out, counts = [], []
            for text in b["text"].to_pylist():
                found = super_kmers(memory.of(text.encode().split()), size)
                out.append(found)
                counts.append(len(found[0]))
            if not sum(counts):
                continue
            m, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
            ids = [pa.array(np.repeat(b[c].to_numpy(), counts)) for c in ("__id", "__fp")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(m.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["__id", "__fp", "m", "start", "n"])

    return map_arrow(docs.select("__id", "__fp", "text"), run, f"{_KEY}, m bigint, start int, n int", heavy="text")


def pack(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """The spans' words as packed strings: __id, __fp, m, hot, start, n, words."""

    def run(batches):
        names = ["__id", "__fp", "m", "hot", "start", "n", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            out = [[] for _ in names]
            for k, fp, text, spans in zip(*(b[c].to_pylist() for c in ("__id", "__fp", "text", "spans")), strict=True):
                words = text.encode().split()
                for x in spans:
                    for col, v in zip(out, (k, fp, x["m"], x["hot"], x["start"], x["n"], b" ".join(words[x["start"] : x["start"] + x["n"] + size - 1])), strict=True):
                        col.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    by_doc = spans.groupBy("__id", "__fp").agg(F.collect_set(F.struct("m", "hot", "start", "n")).alias("spans"))
    return map_arrow(docs.join(by_doc, ["__id", "__fp"]).select("__id", "__fp", "text", "spans"), run, f"{_KEY}, m bigint, hot boolean, start int, n int, words binary", heavy="text")


def window_texts(words: bytes, n: int, size: int) -> list[bytes]:
    """The n windows of a packed string."""
    starts = [0]
    at = words.find(b" ")
    while at >= 0:
        starts.append(at + 1)
        at = words.find(b" ", at + 1)
    ends = [*(s - 1 for s in starts[1:]), len(words)]
    return [words[starts[k] : ends[k + size - 1]] for k in range(n)]


def ranges(found: list[bool], start: int, size: int) -> list[tuple[int, int]]:
    """Words covered by the windows that are marked, as (first, end)."""
    out: list[tuple[int, int]] = []
    for k, hit in enumerate(found):
        if hit:
            if out and out[-1][1] >= start + k:
                out[-1] = (out[-1][0], start + k + size)
            else:
                out.append((start + k, start + k + size))
    return out


def count_buckets(packed: DataFrame, size: int) -> DataFrame:
    """Ranges of words that repeated windows cover, for minimisers that few super-k-mers share."""

    def run(batches):
        m, held, out = None, [], []

        def close():
            own = [window_texts(w, n, size) for _, _, _, n, w in held]
            times = Counter(x for ws in own for x in ws)
            for (k, fp, start, _, _), ws in zip(held, own, strict=True):
                out.extend((k, fp, *r) for r in ranges([times[x] > 1 for x in ws], start, size))

        def flush():
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=["__id", "__fp", "first", "end"])

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("m", "__id", "__fp", "start", "n", "words")), strict=True):
                if row[0] != m:
                    close()
                    m, held = row[0], []
                    if len(out) > 10_000:
                        yield flush()
                held.append(row[1:])
        close()
        if out:
            yield flush()

    dealt = packed.repartition(F.col("m")).sortWithinPartitions("m")
    return map_arrow(dealt.select("m", "__id", "__fp", "start", "n", "words"), run, f"{_KEY}, first int, end int", heavy="words")


def count_hot(packed: DataFrame, size: int) -> DataFrame:
    """The same for minimisers that many share: distinct packed strings, named by their SHA-256, then a distributed count of their windows."""

    def explode(batches):
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
        for b in batches:
            out = []
            for k, (sid, n, words, c) in enumerate(zip(*(b[x].to_pylist() for x in ("sid", "n", "words", "c")), strict=True), 1):
                out += [(sid, i, w, c) for i, w in enumerate(window_texts(words, n, size))]
                if len(out) > 10_000 or (out and k == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["sid", "i", "w", "c"])
                    out = []

    sid = F.sha2("words", 256).alias("sid")
    distinct = packed.groupBy("words", "n").agg(F.count(F.lit(1)).alias("c")).select(sid, "n", "words", "c")
    each = materialize(map_arrow(distinct, explode, "sid string, i int, w binary, c bigint", heavy="words"), "hot-windows")
    # Written, so that both sides of the joins are plain exchanges and adaptive execution can split a line that nearly every text has.
    again = materialize(each.groupBy("w").agg(F.sum("c").alias("total")).where("total > 1").select("w"), "hot-again")
    hit = materialize(each.join(again, "w").groupBy("sid").agg(F.collect_set("i").alias("at")), "hot-hits")
    discard(each, again)
    rows = packed.select("__id", "__fp", "start", sid).join(hit, "sid")
    # Runs of neighbouring windows, told apart by their distance from their rank.
    rows = rows.select("__id", "__fp", "start", F.posexplode(F.array_sort("at")).alias("k", "i"))
    runs = rows.groupBy("__id", "__fp", "start", (F.col("i") - F.col("k")).alias("run")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return runs.select("__id", "__fp", (F.col("start") + F.col("lo")).alias("first"), (F.col("start") + F.col("hi") + size).alias("end"))


def repeated_ranges(docs: DataFrame, size: int, most: int) -> DataFrame:
    """__id, __fp, first, end: words of keyed documents that repeated windows cover; ranges may touch or overlap."""
    spans = materialize(find_super_kmers(docs, size), "super-kmers")
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot minimiser.
    shared = materialize(spans.groupBy("m").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("m", (F.col("times") > most).alias("hot")), "shared")
    packed = materialize(pack(docs, spans.join(shared, "m"), size), "packed")
    discard(spans, shared)
    found = count_buckets(packed.where("NOT hot").drop("hot"), size)
    if packed.where("hot").isEmpty():
        return found
    return found.unionByName(count_hot(packed.where("hot"), size))


def covered(found: list[dict] | None, n: int) -> np.ndarray:
    """Which of n words lie in some range."""
    step = np.zeros(n + 1, np.int32)
    for r in found or ():
        step[r["first"]] += 1
        step[r["end"]] -= 1
    return np.cumsum(step[:n]) > 0


def _with_ranges(docs: DataFrame, size: int, most: int, text: str = "text") -> DataFrame:
    own = docs.select("__id", "__fp", text_or_empty(text).alias("text"))
    by_doc = settled(lambda: repeated_ranges(own, size, most).groupBy("__id", "__fp").agg(F.collect_set(F.struct("first", "end")).alias("__ranges")), "ranges")
    return docs.join(by_doc, ["__id", "__fp"], "left")


def substring_dedup(docs: DataFrame, size: int = 35, most: int = 20_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by single blanks)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, found in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "__ranges")), strict=True):
                words = text.encode().split()
                gone = covered(found, len(words))
                kept = words if not found else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((doc, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = _with_ranges(keyed(docs), size, most)
    return map_arrow(own.select("doc_id", "text", "__ranges"), run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", heavy="text")


def dedup_texts(docs: DataFrame, size: int = 35, most: int = 20_000) -> DataFrame:
    """``docs`` without the repeated words; a text that loses any is its kept words joined by single blanks, others stay as they are."""

    # Columns go by place, so that their names may be any.
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))

    def run(batches):
        for b in batches:
            out = []
            for x, found in zip(b[text].to_pylist(), b["__ranges"].to_pylist(), strict=True):
                if found:
                    words = x.encode().split()
                    x = b" ".join(w for w, g in zip(words, covered(found, len(words)).tolist(), strict=True) if not g).decode()
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b[c] for c in names], names=names)

    own = docs.toDF(*names)
    schema = own.schema
    own = own.withColumns({"__id": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)), "__fp": F.xxhash64(text_or_empty(text))})
    own = _with_ranges(own, size, most, text).select(*names, "__ranges")
    return map_arrow(own, run, schema, heavy=text).toDF(*docs.columns)
