"""Token files: ids of all documents in doc_id order, as bit or byte planes under zstandard, with a chunk index.

A file (shard) is, in this order::

    magic "MSTP0001"
    chunks, each: the compressed planes of one block of at most ``block`` ids; an all-zero plane takes no bytes
    documents: zstandard of three little-endian arrays (known doc_id 1 byte, doc_id 8 bytes, tokens 4 bytes each)
    chunk index: for each chunk its offset (8 bytes), its ids (4 bytes) and the length of each plane (4 bytes each)
    footer: offset and length of the documents and of the index (8 bytes each), block, chunks, documents, planes (4 bytes each), magic

Plane k of a block holds byte k (``byte`` mode, 4 planes) or bit k (``bit`` mode, 32 planes, 8 ids to a byte) of its ids, one
after another. Reading a range of ids needs the footer, the index and the chunks that cover it.

Spark range-sorts the documents, every task streams its range into shards of at most ``shard_ids`` ids and a document longer
than what is left in a shard goes on in the next one, so memory is bounded whatever the texts. Shards are written by Spark, one to
a row of a Parquet table (task, shard, n_ids, payload), which any store that Spark writes to can hold and which lost
executors cannot leave half-written; ``payload`` is a complete file.

Defined results: a null or empty text is the end id alone; null doc_ids come first, repeated doc_ids follow each other
ordered by text hash; extra columns play no part; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_or_empty
from .token_ids import encoder

MAGIC = b"MSTP0001"
_FOOTER = struct.Struct("<4Q4I8s")
MODES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, planes: int) -> np.ndarray:
    """The planes of a block, one in each row."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return np.ascontiguousarray(by_byte.T)
    return np.packbits(np.unpackbits(by_byte, axis=1, bitorder="little").T, axis=1)


def from_planes(rows: np.ndarray, n: int) -> np.ndarray:
    if len(rows) == 4:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    return np.ascontiguousarray(np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little")).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, mode: str = "byte", block: int = 16_384, level: int = 1):
        self.planes, self.block, self.zip = MODES[mode], block, zstandard.ZstdCompressor(level=level)

    def write(self, ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
        """A shard of ``ids`` and of the documents (doc_id, tokens here) that they belong to."""
        out, index, at = [MAGIC], [], len(MAGIC)
        for k in range(0, len(ids), self.block):
            own = ids[k : k + self.block]
            packed = [self.zip.compress(r.tobytes()) if r.any() else b"" for r in to_planes(own, self.planes)]
            index.append(struct.pack(f"<QI{self.planes}I", at, len(own), *map(len, packed)))
            out += packed
            at += sum(map(len, packed))
        table = self.zip.compress(np.array([d is not None for d, _ in docs], "u1").tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([n for _, n in docs], "<u4").tobytes())
        whole = b"".join(index)
        footer = _FOOTER.pack(at, len(table), at + len(table), len(whole), self.block, len(index), len(docs), self.planes, MAGIC)
        return b"".join([*out, table, whole, footer])


class ShardReader:
    def __init__(self, data: bytes):
        *at, self.block, n, self.n_docs, self.planes, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.zip = data, zstandard.ZstdDecompressor()
        row = struct.Struct(f"<QI{self.planes}I")
        self.index = [row.unpack_from(data, at[2] + k * row.size) for k in range(n)]
        table = self.zip.decompress(data[at[0] : at[0] + at[1]])
        known = np.frombuffer(table, "u1", self.n_docs)
        ids = np.frombuffer(table, "<i8", self.n_docs, self.n_docs)
        self.docs = [(int(d) if k else None, int(t)) for k, d, t in zip(known, ids, np.frombuffer(table, "<u4", self.n_docs, 9 * self.n_docs), strict=True)]

    def chunk(self, k: int) -> np.ndarray:
        """The ids of one chunk."""
        at, n, *sizes = self.index[k]
        wide = n if self.planes == 4 else -(-n // 8)
        rows = np.zeros((self.planes, wide), np.uint8)
        for row, size in zip(rows, sizes, strict=True):
            if size:
                row[:] = np.frombuffer(self.zip.decompress(self.data[at : at + size], max_output_size=wide), np.uint8)
            at += size
        return from_planes(rows, n)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, out of those chunks that hold them."""
        stop = sum(x[1] for x in self.index) if stop is None else stop
        first = start // self.block
        found = [self.chunk(k) for k in range(first, min(-(-stop // self.block), len(self.index)))]
        return np.concatenate(found)[start - first * self.block : stop - first * self.block] if found else np.empty(0, "<u4")


SHARDS = "task int, shard int, n_ids bigint, payload binary"


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, mode: str = "byte", shard_ids: int = 1 << 19) -> DataFrame:
    """The shards of all documents; (task, shard) is the order of the ids. Write the result before it is read twice."""

    def run(batches):
        from pyspark import TaskContext

        task, enc, writer, n = TaskContext.get().partitionId(), encoder(tokenizer), ShardWriter(mode), 0
        end = np.array([end_id], "<u4").tobytes()
        held, docs, size = [], [], 0

        def shard():
            nonlocal held, docs, size, n
            ids = np.frombuffer(b"".join(held), "<u4")
            out = pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([writer.write(ids, docs)], pa.binary())], names=["task", "shard", "n_ids", "payload"])
            held, docs, size, n = [], [], 0, n + 1
            return out

        for b in batches:
            for doc, coded in zip(b["doc_id"].to_pylist(), enc.encode_all(b["text"].to_pylist()), strict=True):
                ids = coded + end
                while ids:
                    own, ids = ids[: 4 * (shard_ids - size)], ids[4 * (shard_ids - size) :]
                    held.append(own)
                    size += len(own) // 4
                    # A document that goes on in the next shard is there again; only its last part counts as its end.
                    docs.append((doc, (len(own) // 4) | (1 << 31 if ids else 0)))
                    if size == shard_ids:
                        yield shard()
        if size:
            yield shard()

    own = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The text's hash is part of the range key, so that rows that repeat a doc_id, or have none, are dealt to several tasks.
    order = ["doc_id", F.xxhash64("text")]
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return map_arrow(dealt, run, SHARDS, heavy="text")


def read_documents(shards: DataFrame) -> DataFrame:
    """From written shards, per document: doc_id, start, n_tokens, ids_crc32 over all its ids.

    A document's parts in several shards are put together by their CRCs, which combine without the ids.
    """

    def run(batches):
        for b in batches:
            for task, shard, data in zip(*(b[c].to_pylist() for c in ("task", "shard", "payload")), strict=True):
                r = ShardReader(data)
                ids, at, rows = r.read().tobytes(), 0, []
                for k, (doc, n) in enumerate(r.docs):
                    more, n = n >> 31, n & 0x7FFFFFFF
                    rows.append((task, shard, k, doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), bool(more)))
                    at += n
                names = ["task", "shard", "nth", "doc_id", "at", "n", "crc", "more"]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = map_arrow(shards.select("task", "shard", "payload"), run, "task int, shard int, nth int, doc_id bigint, at bigint, n bigint, crc bigint, more boolean")
    by_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each task that wrote, and for each shard within its task.
    tasks = by_task.select(F.col("task").alias("__task"), before("n", Window.orderBy("task")).alias("__before"))
    own = shards.select("task", "shard", before("n_ids", Window.partitionBy("task").orderBy("shard")).alias("__own"))
    base = own.join(tasks, own["task"] == tasks["__task"]).select(F.col("task").alias("__t"), F.col("shard").alias("__s"), (F.col("__own") + F.col("__before")).alias("__base"))
    placed = parts.join(base, (F.col("task") == F.col("__t")) & (F.col("shard") == F.col("__s")))
    placed = placed.select("doc_id", (F.col("__base") + F.col("at")).alias("start"), "n", "crc", "more", ((F.col("nth") == 0) & (F.col("shard") > 0)).alias("first"), "task")
    # Only a shard's last document may go on, and only a shard's first may be the rest of one.
    single = placed.where("NOT more AND NOT first").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    return single.unionByName(_joined(placed.where("more OR first")))


def _joined(parts: DataFrame) -> DataFrame:
    """Parts at the edges of shards (a row or two for each shard) put together to documents."""

    def run(batches):
        now, out = None, []
        for b in batches:
            for doc, start, n, crc, more in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "n", "crc", "more")), strict=True):
                now = [doc, start, n, crc] if now is None else [*now[:2], now[2] + n, crc32_combine(now[3], crc, 4 * n)]
                if not more:
                    out.append(now)
                    now = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = parts.repartition(F.col("task")).sortWithinPartitions("task", "start")
    return map_arrow(dealt.select("doc_id", "start", "n", "crc", "more"), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def crc32_combine(a: int, b: int, size: int) -> int:
    """CRC-32 of two byte strings after one another from their own CRCs and the second's size: ``a`` moved on by zero bytes, xor ``b``."""

    def times(matrix: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= matrix[k]
            v, k = v >> 1, k + 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, x) for x in step]  # 2, 4, 8 bits
    while size:
        if size & 1:
            a = times(step, a)
        size, step = size >> 1, [times(step, x) for x in step]
    return a ^ b


def write_and_read(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """The documents as the written token files give them back."""
    return read_documents(materialize(token_shards(docs, tokenizer, **how), "token-files", "none"))
