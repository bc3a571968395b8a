"""Best-fit packing of token pieces into sequences of fixed length, in bulk-synchronous rounds.

A document is its token ids and an end id; only a longer one than ``capacity`` is cut, from its end backwards, so that the
first piece may be shorter. A sequence is named by the key of the piece that opens it, and what is free in it is its gap.

Pieces come in bands of lengths, from the longest down. Pieces of more than half a sequence open one each; below that, a round

1. range-sorts the band's pieces and the gaps together, by size (a gap that holds several pieces of the band stands there as
   several slots, but the largest gaps no more than the band's pieces can need), so that each task has one range of sizes,
2. sweeps each range from the largest size down: a piece takes its successor, the smallest slot that holds it and is still
   free; of pieces with the same successor the one of the first rank (longer, then smaller key) gets it, the next one takes the
   next larger slot,
3. passes what a range leaves over on to the ranges that follow: free slots are a stack to which each range adds and of which
   the next ones take, so a left-over piece and a left-over slot meet at the same depth of that stack, whatever lies between
   them; depths come from prefix sums over one row for each range, and the pairs from a shuffle by depth,
4. updates the gaps.

Rounds repeat until no piece of the band finds a slot; those left then open new sequences, as many to one as always fit. The
driver sees how many rows a round has matched and left, never the rows. Rounds move keys and sizes alone (24 bytes); a piece's
other columns meet its place once at the end.

Defined results: a null or empty text is the end id alone; repeated rows and doc_ids are documents of their own; extra columns
play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_or_empty
from .token_ids import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, __key bigint"


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``n`` ids end."""
    return list(range(n, 0, -capacity))[::-1]


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with a key of its own; with_ids adds their ids (binary, 4 bytes each)."""

    def run(batches):
        from pyspark import TaskContext

        key, enc = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [[] for _ in range(7 if with_ids else 6)]
            for doc, coded in zip(b["doc_id"].to_pylist(), enc.encode_all(b["text"].to_pylist()), strict=True):
                ids, start = coded + end, 0
                for k, stop in enumerate(cut_points(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * stop]
                    row = (doc, k, start, stop - start, zlib.crc32(own), key)
                    for col, v in zip(out, row + ((own,) if with_ids else ()), strict=True):
                        col.append(v)
                    key += 1
                    start = stop
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "__key", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names=names[: len(out)])

    own = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    return map_arrow(own, run, PIECES + (", ids binary" if with_ids else ""), heavy="text")


#: What a row of a round is: a piece with the slot that it took, a piece without one, a free slot (seq, gap, no key).
TOOK, LEFT, FREE = 0, 1, 2
SWEPT = "kind int, seq bigint, gap bigint, key bigint, length bigint, part int, nth bigint"


def bands(capacity: int) -> list[tuple[int, int]]:
    """Lengths (more than, up to) that are placed together, below half a sequence: finer where few pieces fill a gap."""
    out, hi = [], capacity // 2
    while hi:
        lo = hi * 3 // 4 if hi > capacity // 8 else hi // 3
        out.append((lo, hi))
        hi = lo
    return out


def _swept(**columns: np.ndarray | int | None) -> pa.RecordBatch:
    """Rows of SWEPT; a single value stands for all rows, a column that is not given is null."""
    n = next(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    types, out = {"int": pa.int32(), "bigint": pa.int64()}, []
    for name, kind in (x.split() for x in SWEPT.split(", ")):
        c = columns.get(name)
        out.append(pa.nulls(n, types[kind]) if c is None else pa.array(np.broadcast_to(c, n), types[kind]))
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SWEPT.split(", ")])


def stacked(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots are laid on a stack, pieces take from it: places of the pieces that took and of what they took, of pieces that met an empty stack, and of the slots that stay."""
    height = np.cumsum(np.where(is_piece, -1, 1))
    least = np.minimum.accumulate(np.minimum(height, 0))
    lost = is_piece & (least < np.r_[0, least[:-1]])
    at = np.flatnonzero(~lost)
    # How high the slot lies that a row lays down or takes; at each height a slot is laid, taken, laid again ...
    level = (height - least)[at] + is_piece[at]
    at = at[np.argsort(level, kind="stable")]
    takes = is_piece[at]
    nth = np.flatnonzero(takes)
    free = ~takes & ~np.r_[takes[1:], False]
    return at[nth], at[nth - 1], np.flatnonzero(lost), at[free]


def sweep(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """One range, sorted from the largest size down: (size, is_piece, id, gap) -> pieces with their slots, then what is left over in its order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got).combine_chunks()
    size, own = (whole[c].to_numpy() for c in ("size", "id"))
    gap = pc.fill_null(whole["gap"], 0).to_numpy()
    took, slot, lost, free = stacked(whole["is_piece"].to_numpy() == 1)
    for i in range(0, len(took), 20_000):
        t, f = took[i : i + 20_000], slot[i : i + 20_000]
        yield _swept(kind=TOOK, seq=own[f], gap=gap[f], key=own[t], length=size[t], part=part, nth=0)
    if len(lost):
        yield _swept(kind=LEFT, key=own[lost], length=size[lost], part=part, nth=np.arange(len(lost)))
    if len(free):
        yield _swept(kind=FREE, seq=own[free], gap=gap[free], part=part, nth=np.arange(len(free)))


def between_ranges(swept: DataFrame) -> DataFrame:
    """The rows of a round after left-over pieces have met the slots that earlier ranges have left over."""
    rest = swept.where(F.col("kind") != TOOK)
    # One row for each range: how far the stack of free slots has changed before it.
    each = rest.groupBy("part").agg(F.count_if(F.col("kind") == LEFT).alias("lost"), F.count_if(F.col("kind") == FREE).alias("won"))
    before = F.sum(F.col("won") - F.col("lost")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("part", "lost", F.coalesce(before, F.lit(0)).alias("before"))
    # A range takes from the stack first and adds to it then; what is added at a depth goes when the stack comes down to it next.
    depth = F.when(F.col("kind") == LEFT, F.col("before") - F.col("nth")).otherwise(F.col("before") - F.col("lost") + F.col("nth") + 1)
    at = rest.join(F.broadcast(each), "part").withColumn("depth", depth)
    w = Window.partitionBy("depth").orderBy("part", "kind")
    prior, after = F.lag(F.struct("kind", "seq", "gap")).over(w), F.lead("kind").over(w)
    at = at.withColumns({"prior": prior, "after": after})
    met = (F.col("kind") == LEFT) & (F.col("prior.kind") == FREE)
    own = [F.when(met, F.lit(TOOK)).otherwise(F.col("kind")).cast("int").alias("kind"), *(F.when(met, F.col(f"prior.{c}")).otherwise(F.col(c)).alias(c) for c in ("seq", "gap")), "key", "length", "part", "nth"]
    # A slot that has been taken stands with the piece that took it.
    return swept.where(F.col("kind") == TOOK).unionByName(at.where(~((F.col("kind") == FREE) & F.coalesce(F.col("after") == LEFT, F.lit(False)))).select(*own))


def _gap_rows() -> list[Column]:
    """Gaps as rows of SWEPT that no piece has met."""
    return [F.lit(FREE).alias("kind"), F.col("seq"), F.col("gap"), *(F.lit(None).cast(t).alias(c) for c, t in (("key", "bigint"), ("length", "bigint"), ("part", "int"), ("nth", "bigint")))]


def offered(sizes: dict[int, int], hi: int, pieces: int) -> tuple[int, int]:
    """Of ``sizes`` (gap: how many), the largest gap that is needed for that many pieces of length ``hi`` at most, and how many slots a gap of it offers.

    Smaller gaps offer all their slots. What is offered never exceeds twice the pieces and one for each gap.
    """
    short = pieces
    for gap in sorted(g for g in sizes if g >= hi):
        if sizes[gap] * (gap // hi) >= short:
            return gap, -(-short // sizes[gap])
        short -= sizes[gap] * (gap // hi)
    return max(sizes, default=0), max(sizes, default=0)


def match(gaps: DataFrame, pieces: DataFrame, lo: int, hi: int, ranges: int, most: int | None = None, slots_of_most: int = 1) -> tuple[DataFrame, DataFrame]:
    """One round for ``pieces(key, length)`` of lengths in (lo, hi] and ``gaps(seq, gap)``: rows of SWEPT, materialised, and those of gaps that are too small for the band, or larger than ``offered`` has them."""
    many = F.greatest(F.floor(F.col("gap") / hi), F.lit(1))
    within = F.col("gap") > lo
    if most is not None:
        many = F.when(F.col("gap") == most, F.least(many, F.lit(slots_of_most).cast("bigint"))).otherwise(many)
        within &= F.col("gap") <= most
    slots = gaps.where(within).select("seq", "gap", many.alias("many"), F.explode(F.sequence(F.lit(1).cast("bigint"), many)).alias("k"))
    # All slots of a gap but one have just the size that each piece of the band fits into.
    size = F.when(F.col("k") < F.col("many"), F.lit(hi)).otherwise(F.col("gap") - (F.col("many") - 1) * hi).cast("bigint")
    rows = slots.select(size.alias("size"), F.lit(0).alias("is_piece"), F.col("seq").alias("id"), "gap")
    rows = rows.unionByName(pieces.select(F.col("length").alias("size"), F.lit(1).alias("is_piece"), F.col("key").alias("id"), F.lit(None).cast("bigint").alias("gap")))
    order = [F.desc("size"), "is_piece", "id"]

    def run(batches):
        from pyspark import TaskContext

        return sweep(batches, TaskContext.get().partitionId())

    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    kinds = {"took": F.count_if(F.col("kind") == TOOK), "left": F.count_if(F.col("kind") == LEFT), "least": F.min(F.when(F.col("kind") == LEFT, F.col("length")))}
    swept = materialize(map_arrow(dealt.sortWithinPartitions(*order), run, SWEPT), "swept", **kinds)
    small = gaps.where(~within).select(*_gap_rows())
    if ranges > 1:
        rows = materialize(between_ranges(swept), "round", **kinds)
        discard(swept)
        swept = rows
    return swept, small


def open_sequences(pieces: DataFrame, capacity: int, hi: int, ranges: int) -> DataFrame:
    """New sequences for ``pieces(key, length)`` of lengths up to ``hi``, as many to one as always fit: rows of SWEPT, materialised."""
    each = capacity // hi

    def run(batches):
        n, first = 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            key, nth = b["key"].to_numpy(), n + np.arange(b.num_rows)
            opens = nth - nth % each - n  # where the piece that opens the sequence stands in this batch
            seq = np.where(opens < 0, first, key[np.maximum(opens, 0)])
            n, first = n + b.num_rows, int(seq[-1])
            yield _swept(kind=TOOK, seq=seq, gap=capacity, key=key, length=b["length"].to_numpy(), part=0, nth=0)

    order = [F.desc("length"), "key"]
    dealt = pieces.select("key", "length").repartitionByRange(ranges, *order) if ranges > 1 else pieces.select("key", "length").coalesce(1)
    return materialize(map_arrow(dealt.sortWithinPartitions(*order), run, SWEPT), "opened")


def gaps_after(rows: DataFrame) -> DataFrame:
    """seq, gap: what is free in the sequences after a round."""
    left = F.min("gap") - F.coalesce(F.sum("length"), F.lit(0))
    return rows.where(F.col("kind") != LEFT).groupBy("seq").agg(left.alias("gap")).where("gap > 0")


def gaps_by_size(gaps: DataFrame) -> dict[int, int]:
    """How many gaps there are of each size: at most as many numbers as a sequence has places."""
    return {r["gap"]: r["n"] for r in gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect()}


def ranges_of(rows: int, range_rows: int) -> int:
    """How many ranges that many rows are dealt to: a range has ``range_rows`` at least and grows with the root of the rows, so that neither ranges nor their rows are ever very many."""
    return -(-rows // max(range_rows, 8 * math.isqrt(rows)))


def place(pieces: DataFrame, capacity: int, range_rows: int = 50_000) -> DataFrame:
    """Materialised ``pieces`` (with length and __key) with sequence_id and offset; a range has about ``range_rows`` rows, or more if there are very many."""
    items = pieces.select(F.col("__key").alias("key"), "length")
    in_band = bands(capacity)
    number = F.lit(-1)
    for k, (lo, hi) in enumerate(in_band):
        number = F.when((F.col("length") > lo) & (F.col("length") <= hi), F.lit(k)).otherwise(number)
    counts = {r["band"]: r["n"] for r in items.groupBy(number.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    alone = items.where(F.col("length") > capacity // 2)
    placed, done = [alone.select("key", F.col("key").alias("seq"))], []
    gaps = alone.select(F.col("key").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0")
    sizes = gaps_by_size(gaps)
    for k, (lo, hi) in enumerate(in_band):
        left, n_left, least = items.where((F.col("length") > lo) & (F.col("length") <= hi)), counts.get(k, 0), lo + 1
        while n_left:
            rows, small, took = None, gaps.select(*_gap_rows()), 0
            if max(sizes, default=0) >= least:  # else nothing that is left fits anywhere
                most, each = offered(sizes, hi, n_left)
                rows, small = match(gaps, left, lo, hi, ranges_of(n_left + sum(n for g, n in sizes.items() if lo < g <= most), range_rows), most, each)
                took, n_left, least = rows.seen["took"], rows.seen["left"], rows.seen["least"] or hi
                left = rows.where(F.col("kind") == LEFT)
                done.append(rows)
                if took:
                    placed.append(rows.where(F.col("kind") == TOOK).select("key", "seq"))
            after = small if rows is None else rows.unionByName(small)
            if n_left and not took:
                opened = open_sequences(left, capacity, hi, ranges_of(n_left, range_rows))
                done.append(opened)
                placed.append(opened.select("key", "seq"))
                after, n_left = after.unionByName(opened), 0
            # Written, so that no round's plan holds the rounds before it.
            before, gaps = gaps, materialize(gaps_after(after), "gaps")
            sizes = gaps_by_size(gaps)
            if hasattr(before, "_written_to"):
                discard(before)
    found = placed[0]
    for p in placed[1:]:
        found = found.unionByName(p)
    found = materialize(found, "placed")
    discard(*done, *([gaps] if hasattr(gaps, "_written_to") else []))
    out = pieces.join(found.select(F.col("key").alias("__key"), F.col("seq").alias("sequence_id")), "__key")
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__key").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("__key")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(materialize(encode_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity, **how)


def sequences(placed: DataFrame) -> DataFrame:
    """The filled sequences of pieces that carry their ids: sequence_id, n_tokens, ids. A sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("__parts"))
    whole = F.aggregate("__parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return out.select("sequence_id", "n_tokens", whole.alias("ids"))
