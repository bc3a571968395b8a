"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles (A-Z lower-cased; with fewer words the whole sequence is
the one shingle). Documents with equal sets form a class; one set of each class goes on. Two classes link when their Jaccard
similarity is at least ``percent`` / 100, checked on the sets themselves. The result is the components of the links and every document's number of links, which counts
documents: the copies in its own class and all documents of the classes that link with it.

With o(n) the least overlap that a set of n needs (the ceiling of n * percent / 100), two sets that link share at least c tokens
among the first n - o(n) + c of each, under whatever global order of all tokens and for every c. That gives the filters:

1. Order 1 is by hash. Each set gives its prefix for c = n - o(n) + 1, which keeps texts of a form apart whose common words are less
   than about half of each.
2. Order 2 ranks these prefixes by rarity: by the number of classes that have a token in their prefix. Prefixes that share c tokens
   share one among all but the c - 1 commonest of either, so only those make a class a candidate; a common line or passage, however
   many documents hold it, rarely is among them, and tokens of a single class leave at once. Classes with such a token in common form
   a bucket.
3. Orders 3 and 4 are by other hashes, each over whole sets and independent of the others, for c = (n - o(n)) * 5 // 16 + 1.

A pair of classes is a candidate only if it passes all of them: a token of order 2 in common and c tokens of either's prefix under
order 3 and under order 4, and sizes that can link. Only candidates are verified.

No pair travels or is written. A bucket's first class is its pivot, and the buckets with one pivot form a group, so that two classes
with a token of order 2 in common are in a group together. All groups are sorted by size of their classes at once, by a range
partitioning that cuts a large group wherever its task ends, and dealt into blocks of bounded size; every two blocks of a group whose
sizes can link are one piece of work. First only the tokens of orders 2 to 4 travel, and classes without any candidate leave the piece of
work; then the texts of the others do. Both steps count shared tokens of all pairs of a piece of work at once, as products of 0/1
matrices, and intersect what the orders leave. A piece of work gives out the links of a spanning forest and for each class the number of
documents it links with, so what comes out is never more than a few times what went in, while every link is counted and every link that
joins components is found. Two classes may meet in several groups; their link is counted in the first of these.

Defined results: a set without words is empty and links with nothing; rows with a null doc_id link as others do, and a component of
them alone has a null component_id; rows that repeat a document are documents of their own; extra columns play no part; an empty
table gives an empty table. A very long text is read whole and has one set like any other; its block holds fewer others. Set hashes have 64 bits for a shingle and 128 for a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, one_of_each, settled, text_or_empty
from .word_shingles import WordHashes, mix, windows

_NO_ID = (1 << 63) - 1
_TOKEN_BYTES = 6


def need(n: int, percent: int) -> int:
    """The least overlap that a set of n needs to link with anything."""
    return -(-n * percent // 100)


def shared_first(n: int, percent: int) -> int:
    """How many tokens the prefixes of a set of n must share under order 1."""
    return n - need(n, percent) + 1


def shared_third(n: int, percent: int) -> int:
    return (n - need(n, percent)) * 5 // 16 + 1


def shingle_set(words: list[bytes], memory: WordHashes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's lower-cased words."""
    return np.unique(windows(memory.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def signatures(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, fp (of the text), n, c1 and c2 (of the set), and the prefixes p1 (6 bytes a token), p3 and p4 (4 bytes) under orders 1, 3 and 4 of every row."""

    def run(batches):
        memory = WordHashes()
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                own = shingle_set(words_of(text), memory, size)
                n = len(own)
                short = n - need(n, percent)
                first = own[: short + shared_first(n, percent)]
                c1, c2 = (int(mix(own * np.uint64(a) + np.uint64(1)).sum(dtype=np.uint64)) for a in (1, 0xD6E8FEB86659FD93))
                rows.append((n, c1 - (1 << 64) * (c1 >> 63), c2 - (1 << 64) * (c2 >> 63), first.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES].tobytes(), *(short_tokens(own, percent, k).tobytes() for k in (3, 4))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["fp"], *made], names=["doc_id", "fp", "n", "c1", "c2", "p1", "p3", "p4"])

    own = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text_or_empty()).alias("fp"), text_or_empty().alias("text"))
    return map_arrow(own, run, "doc_id bigint, fp bigint, n bigint, c1 bigint, c2 bigint, p1 binary, p3 binary, p4 binary", heavy="text")


def classes(signed: DataFrame) -> DataFrame:
    """One row per non-empty distinct set: id, least (doc_id), fp, n, c1, c2, copies (rows that have it), p1, p3, p4."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.col("fp"))).alias("__first")
    own = signed.where("n > 0").groupBy("n", "c1", "c2").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("p1", "p3", "p4")])
    own = own.select(F.col("__first.d").alias("least"), F.col("__first.fp").alias("fp"), "n", "c1", "c2", "copies", "p1", "p3", "p4")
    # A doc_id stands for its class, unless none is known or rows of several classes repeat it.
    twice = own.select("least").groupBy("least").count().where(f"count > 1 OR least = {_NO_ID}").select(F.col("least").alias("__twice"))
    own = own.join(twice, own["least"] == twice["__twice"], "left")
    other = F.lit(-1) - F.pmod(F.xxhash64("c1", "c2"), F.lit(1 << 62))
    return own.select(F.when(F.col("__twice").isNull(), F.col("least")).otherwise(other).alias("id"), "least", "fp", "n", "c1", "c2", "copies", "p1", "p3", "p4")


def postings(own: DataFrame) -> DataFrame:
    """token, id, n: the prefixes under order 1."""

    def run(batches):
        for b in batches:
            held = b["p1"].to_pylist()
            count = [len(x) // _TOKEN_BYTES for x in held]
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, _TOKEN_BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 8 - _TOKEN_BYTES :] = raw
            yield pa.RecordBatch.from_arrays([pa.array(wide.view(">u8").reshape(-1).astype(np.int64)), *(pa.array(np.repeat(b[c].to_numpy(), count)) for c in ("id", "n"))], names=["token", "id", "n"])

    return map_arrow(own.select("id", "n", "p1"), run, "token bigint, id bigint, n bigint")


def rarest(found: DataFrame, percent: int) -> DataFrame:
    """token, id, n: what is left of the prefixes under order 2, without tokens of a single class."""
    n, need_of = F.col("n"), lambda c: F.ceil(c * percent / F.lit(100))
    prefix = 2 * (n - need_of(n)) + 1
    # A partner has at least need(n) tokens, and none of that many or more has to share fewer than this.
    least_shared = need_of(n) - need_of(need_of(n)) + 1
    prefix = F.least(prefix, n)
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot token.
    shared_by = materialize(found.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token-classes")
    held = found.join(shared_by.hint("merge"), "token")
    by_id = Window.partitionBy("id")
    nth = F.row_number().over(by_id.orderBy("df", "token"))
    single = prefix - F.count(F.lit(1)).over(by_id)
    kept = held.select("token", "id", "n", nth.alias("k"), single.alias("single"))
    return kept.where(F.col("k") + F.col("single") <= prefix - least_shared + 1).select("token", "id", "n")


def only(rows: DataFrame, keys: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """The rows that have one of ``keys``, found before the rows are shuffled if the keys are few enough to be broadcast."""
    keys = materialize(keys.distinct(), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, "left_semi")


def groups(kept: DataFrame) -> DataFrame:
    """g, id, n: the classes that may link, by the first class of their buckets."""
    sizes = kept.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("g")).where("held > 1")
    return kept.join(materialize(sizes.select("token", "g"), "buckets"), "token").select("g", "id", "n").distinct()


def work(grouped: DataFrame, percent: int, block_classes: int, block_tokens: int) -> DataFrame:
    """g, i, j, side, id: each class once for each pair of blocks (i, j) that it has a part in, on side 0, 1 or, for i = j, 0 alone.

    ``grouped`` is materialised. Blocks are numbered in the order of their classes' sizes.
    """

    def deal(batches):
        from pyspark import TaskContext

        block, group, classes, held = (TaskContext.get().partitionId() << 32) - 1, None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b["g"].to_pylist(), b["n"].to_pylist(), strict=True):
                if g != group or classes == block_classes or held + n > block_tokens:
                    block, group, classes, held = block + 1, g, 0, 0
                classes, held = classes + 1, held + n
                out.append(block)
            yield pa.RecordBatch.from_arrays([b["g"], b["id"], b["n"], pa.array(out, pa.int64())], names=["g", "id", "n", "block"])

    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_by_size = grouped.select("g", "id", "n").repartitionByRange(parts, "g", "n", "id").sortWithinPartitions("g", "n", "id")
    dealt = materialize(map_arrow(sorted_by_size, deal, "g bigint, id bigint, n bigint, block bigint"), "blocks")
    # A group that many tasks have dealt is in as many parts; those that lie one after the other are one block, of less than twice the bounds.
    in_order = Window.partitionBy("g").orderBy("block")
    parts_of = dealt.groupBy("g", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("tokens"))
    before = lambda c, most: F.floor((F.sum(c).over(in_order) - F.col(c)) / most)
    parts_of = materialize(parts_of.withColumn("whole", before("classes", block_classes) + before("tokens", block_tokens)), "blocks")
    blocks = parts_of.groupBy("g", "whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    a = blocks.select("g", F.col("whole").alias("i"), F.col("hi").alias("hi"))
    b = blocks.select("g", F.col("whole").alias("j"), F.col("lo").alias("lo"))
    met = a.join(b, "g").where((F.col("i") <= F.col("j")) & (F.col("hi") * 100 >= F.col("lo") * percent)).select("g", "i", "j")
    sides = met.select("g", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("whole")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("whole")), F.struct(F.lit(1).alias("side"), F.col("j").alias("whole"))))).alias("x"))
    sides = sides.select("g", "i", "j", "x.side", "x.whole").join(parts_of.select("g", "whole", "block"), ["g", "whole"])
    return dealt.join(sides.select("g", "i", "j", "side", "block"), ["g", "block"]).select("g", "i", "j", "side", "id")


#: What tells the hash orders 3 and 4 apart (fixed values).
_ORDERS = {3: np.uint64(0x5851F42D4C957F2D), 4: np.uint64(0x2545F4914F6CDD1D)}


def prefix(own: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The first tokens of a set under order 3 or 4."""
    n = len(own)
    k = min(n, n - need(n, percent) + shared_third(n, percent))
    return own[np.argpartition(mix(own ^ _ORDERS[order]), k - 1)[:k]] if k < n else own


def short_tokens(own: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The same in 4 bytes a token."""
    return (prefix(own, percent, order) >> np.uint64(32)).astype("<u4")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many tokens each set of ``a`` shares with each of ``b``: products of 0/1 matrices, so many tokens at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat)
        return row[hit], at[hit]

    if len(common):
        (ra, ca), (rb, cb) = places(a, flat_a), places(b, flat_b)
        for k in range(0, len(common), columns):
            wide = min(columns, len(common) - k)
            parts = []
            for n, r, c in (len(a), ra, ca), (len(b), rb, cb):
                own = (c >= k) & (c < k + wide)
                m = np.zeros((n, wide), np.float32)
                m[r[own], c[own] - k] = 1
                parts.append(m)
            out += parts[0] @ parts[1].T
    return out


def may_link(prefixes: list[list[np.ndarray]], rare: list[np.ndarray], size: np.ndarray, own: list[int], other: list[int], percent: int, lost: list[np.ndarray] | None = None) -> np.ndarray:
    """Which pairs are candidates: all orders and the bound on sizes let them pass. Of the pairs within one side, one of each two.

    ``prefixes`` has each set's tokens under orders 3 and 4, ``rare`` its tokens under order 2. ``lost`` is how many tokens of each prefix
    fell together when they were shortened, which the pair then need not share.
    """
    na, nb = size[own][:, None], size[other][None, :]
    may = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    if other is own:
        may &= np.tri(len(own), k=-1, dtype=bool)
    may &= shared_counts([rare[k] for k in own], [rare[k] for k in other]) > 0
    for k, tokens in enumerate(prefixes):
        if may.any():
            ask = np.array([shared_third(int(n), percent) for n in size]) - (lost[k] if lost else 0)
            may &= shared_counts([tokens[x] for x in own], [tokens[x] for x in other]) >= np.minimum(ask[own][:, None], ask[other][None, :])
    return may


def sides_of(sides: list[int]) -> tuple[list[int], list[int]]:
    own = [k for k, s in enumerate(sides) if s == 0]
    return own, [k for k, s in enumerate(sides) if s == 1] or own


def linking(sets: list[np.ndarray], rare: list[np.ndarray], sides: list[int], percent: int, copies: list[int], earlier: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between side 0 and side 1, or within side 0 if there is no other, and how many copies each set links with.

    Pairs that share a group in ``earlier`` have been counted there.
    """
    own, other = sides_of(sides)
    counts = np.zeros(len(sets), np.int64)
    if not own:
        return [], counts
    size = np.array([len(s) for s in sets])
    may = may_link([[prefix(s, percent, k) for s in sets] for k in (3, 4)], rare, size, own, other, percent)
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return [], counts
    na, nb = size[own][rows][:, None], size[other][cols][None, :]
    same = shared_counts([sets[own[k]] for k in rows], [sets[other[k]] for k in cols])
    found = may[np.ix_(rows, cols)] & (same * 100 >= (na + nb - same) * percent)
    at, to, many = np.array(own)[rows], np.array(other)[cols], np.array(copies, np.int64)
    first = found & (shared_counts([earlier[k] for k in at], [earlier[k] for k in to]) == 0)
    counts[at] += first @ many[to]
    counts[to] += many[at] @ first
    x, y = np.nonzero(found)
    up = list(range(len(sets)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for i, j in zip(rows[x].tolist(), cols[y].tolist(), strict=True):
        a, b = own[i], other[j]
        if (ra := root(a)) != (rb := root(b)):
            up[ra] = rb
            out.append((a, b))
            if len(out) == len(sets) - 1:
                break
    return out, counts


def by_piece(rows: DataFrame, payload: str) -> DataFrame:
    """Rows dealt out and sorted by piece of work: g, i, j, side, id and what they carry."""
    flat = rows.select("g", "i", "j", "side", "id", payload)
    return flat.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id")


def pieces(batches, payload: str):
    """The pieces of work of a sorted partition: key, ids, sides and what the classes carry; a class that comes twice counts once."""
    key, ids, sides, held = None, [], [], []
    for b in batches:
        for g, i, j, side, k, x in zip(*(b[c].to_pylist() for c in ("g", "i", "j", "side", "id", payload)), strict=True):
            if (g, i, j) != key:
                if len(ids) > 1:
                    yield key, ids, sides, held
                key, ids, sides, held = (g, i, j), [], [], []
            if not (ids and ids[-1] == k and sides[-1] == side):
                ids.append(k)
                sides.append(side)
                held.append(x)
    if len(ids) > 1:
        yield key, ids, sides, held


def rare_tokens(kept: DataFrame) -> DataFrame:
    """id, rare: the tokens of order 2 of each class, which are fewer than its prefix has."""
    return kept.groupBy("id").agg(F.collect_set("token").alias("rare"))


def with_partners(todo: DataFrame, own: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """The rows of ``todo`` whose class is one of a candidate pair in the piece of work."""

    def run(batches):
        for (g, i, j), ids, sides, held in pieces(batches, "x"):
            mine, other = sides_of(sides)
            if not mine:
                continue
            size = np.array([x["n"] for x in held])
            raw = [[np.frombuffer(x[c], "<u4") for x in held] for c in ("p3", "p4")]
            tokens = [[np.unique(t) for t in own] for own in raw]
            lost = [np.array([len(a) - len(b) for a, b in zip(*x, strict=True)]) for x in zip(raw, tokens, strict=True)]
            may = may_link(tokens, [np.array(x["rare"], np.int64) for x in held], size, mine, other, percent, lost)
            keep = sorted({mine[k] for k in np.flatnonzero(may.any(1))} | {other[k] for k in np.flatnonzero(may.any(0))})
            if keep:
                cols = [[g] * len(keep), [i] * len(keep), [j] * len(keep), [sides[k] for k in keep], [ids[k] for k in keep]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["g", "i", "j", "side", "id"])

    carried = only(own.select("id", "n", "p3", "p4"), todo.select("id"), ["id"]).join(rare, "id").select("id", F.struct("n", "p3", "p4", "rare").alias("x"))
    return map_arrow(by_piece(todo.join(carried, "id"), "x"), run, "g bigint, i bigint, j bigint, side int, id bigint")


def links_of(todo: DataFrame, percent: int, size: int) -> DataFrame:
    """a, b, n: links (a, b) and numbers n of documents that a links with, out of ``todo(g, i, j, side, id, x)``.

    Each (g, i, j) is one piece of work of bounded size; x has the text, the copies, the tokens of order 2 and the earlier groups of a class.
    """

    def run(batches):
        memory = WordHashes()
        for _, ids, sides, held in pieces(batches, "x"):
            sets = [shingle_set(words_of(x["text"]), memory, size) for x in held]
            found, counts = linking(sets, [np.array(x["rare"], np.int64) for x in held], sides, percent, [x["copies"] for x in held], [np.array(x["earlier"], np.int64) for x in held])
            counted = np.flatnonzero(counts).tolist()
            a, b = [ids[i] for i, _ in found] + [ids[k] for k in counted], [ids[j] for _, j in found] + [None] * len(counted)
            n = [None] * len(found) + counts[counted].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    return map_arrow(by_piece(todo, "x"), run, "a bigint, b bigint, n bigint")


def components(links: DataFrame) -> DataFrame:
    """id, comp: every linked class with the least of its component, by alternating large and small stars until nothing changes."""

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.where("v <= u") if small else both
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "stars")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = materialize(star(star(edges, False), True), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def find_links(own: DataFrame, docs: DataFrame, percent: int, size: int, block_classes: int, block_tokens: int) -> DataFrame:
    """a, b, n: links (a, b) that join the classes ``own`` to the components of all links, and numbers n of documents that a links with."""
    kept = materialize(rarest(postings(own), percent), "candidate-tokens")
    rare = materialize(rare_tokens(kept), "rare-tokens")
    grouped = materialize(groups(kept), "groups")
    laid_out = materialize(work(grouped, percent, block_classes, block_tokens), "work")
    todo = materialize(with_partners(laid_out, own, rare, percent), "work")
    discard(kept, grouped, laid_out)
    held = only(own.select("id", F.col("least").alias("__d"), F.col("fp").alias("__f"), "copies"), todo.select("id"), ["id"])
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("__d"), F.xxhash64(text_or_empty()).alias("__f"), text_or_empty().alias("text"))
    # One row for each document that is asked for, however often it is there.
    asked = only(keyed, held.select("__d", "__f"), ["__d", "__f"]).dropDuplicates(["__d", "__f"])
    texts = asked.join(held, ["__d", "__f"]).select("id", "text", "copies").join(rare, "id")
    # Two classes that link are candidates in every group they share, so the groups left are all that matter.
    todo = todo.join(todo.groupBy("id").agg(F.collect_set("g").alias("all")), "id").join(texts, "id")
    carried = F.struct("text", "copies", "rare", F.filter("all", lambda x: x < F.col("g")).alias("earlier"))
    return links_of(todo.withColumn("x", carried), percent, size)


def jaccard_components(docs: DataFrame, percent: int = 90, size: int = 3, block_classes: int = 2048, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (of its text), n_shingles, n_links, component_id and comp, which tells components apart."""
    docs = docs.select("doc_id", "text")
    large = materialize(signatures(docs, percent, size), "signatures")
    whole = materialize(classes(large), "classes")
    # Prefixes, the bulk of both tables, go as soon as nothing reads them.
    signed = materialize(large.select("doc_id", "fp", "n", "c1", "c2"), "documents")
    discard(large)
    found = settled(lambda: find_links(whole, docs, percent, size, block_classes, block_tokens), "links")
    own = materialize(whole.select("id", "least", "n", "c1", "c2", "copies"), "classes")
    discard(whole)
    comps = settled(lambda: components(found.where("b IS NOT NULL").select("a", "b")), "components")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    member = labelled(own.select("id", "least", "n", "c1", "c2", "copies"), comps).join(counts, "id", "left")
    member = member.withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    least = member.groupBy("comp").agg(F.min("least").alias("component_id"))
    member = member.join(least, "comp").select("n", "c1", "c2", "n_links", "comp", F.when(F.col("component_id") < _NO_ID, F.col("component_id")).alias("component_id"))
    full = signed.where("n > 0").select("doc_id", "fp", "n", "c1", "c2").join(member, ["n", "c1", "c2"]).select("doc_id", "fp", F.col("n").alias("n_shingles"), "n_links", "component_id", "comp")
    return full.unionByName(signed.where("n = 0").select("doc_id", "fp", F.col("n").alias("n_shingles"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("comp")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id, and all rows without words; all columns kept.

    Of rows that repeat this doc_id and text the least one stays, by its columns in their order.
    """
    found = settled(lambda: jaccard_components(docs, **how).select("doc_id", "fp", "comp"), "members")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.col("fp").alias("f"))).alias("first")
    chosen = found.where("comp IS NOT NULL").groupBy("comp").agg(first).select(F.col("first.d").alias("__d"), F.col("first.f").alias("__f"))
    alone = found.where("comp IS NULL").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__d"), F.col("fp").alias("__f")).distinct()
    # Columns go by place, so that their names may be any.
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    own = docs.toDF(*names).withColumns({"__d": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)), "__f": F.xxhash64(text_or_empty(text))})
    out = own.join(chosen.unionByName(alone), ["__d", "__f"], "left_semi")
    if not found.where("comp IS NOT NULL").groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        words = F.length(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]", "")) > 0
        out = one_of_each(out.where(words), ["__d", "__f"]).unionByName(out.where(~words))
    return out.select(*names).toDF(*docs.columns)
