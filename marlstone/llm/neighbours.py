"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a vector, padded with zeros to a power of two of
components; its code is the signed axis it comes to lie nearest to. ``tables`` such hashes are independent. Once a table of vectors has
more than ``PER_CODE`` for each code, a second rotation refines every code by the nearest of its first few signed axes, as many as bring
buckets back to that size. A query probes, in each table, the codes whose axes it lies nearest to. Candidates are the vectors under the
probed codes, and are ranked by their exact cosine in double precision; scores don't depend on which bucket a pair met in.

How many codes are probed is fitted: for at most ``sample`` query vectors (the first by hash) one pass over all vectors gives the exact
neighbours and, for each, in how many probes its bucket comes; ``probes`` is the least number that finds ``target`` of them. All vectors
are indexed and all queries asked. Queries that found fewer rows than they ask for, while there are more, probe every code, which is exact.

Vectors that are equal are one class, and of its rows only the ``k + 1`` least ids can be an answer, so a vector that a third of all rows
hold is searched, and searched for, once. Buckets are met in blocks: ``BLOCK`` classes against ``ASKING`` queries are one piece of work,
a matrix product, out of which the best ``k + 1`` of each query go on; a bucket of any size is as many pieces, and pairs are never rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; a row
that repeats another is a candidate of its own, and asks on its own; vectors are compared with those of as many components; an empty
table gives an empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

#: Vectors for each code, beyond which a second hash refines the codes; codes of a table at most.
PER_CODE, MOST_CODES = 4096, 1 << 16
#: Classes and queries of one piece of work.
BLOCK, ASKING = 2048, 512
#: Cosines by matrix product that are nearer than this are told apart by the exact ones.
CLOSE = 1e-9
_FOUND = pa.schema([("asking", pa.int64()), ("score", pa.float64()), ("least", pa.int64()), ("cls", pa.int64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast Hadamard transform of each row, of a power of two of components."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


class Hashes:
    """The codes of vectors of ``dim`` components when ``count`` vectors are indexed."""

    def __init__(self, dim: int, count: int, tables: int, seed: int):
        self.dim, self.size = dim, 1 << max(0, (dim - 1).bit_length())
        wanted = min(count // PER_CODE, MOST_CODES) // (2 * self.size)
        self.axes = min(self.size, 1 << (wanted.bit_length() - 1) >> 1) if wanted >= 2 else 0
        self.codes = 2 * self.size * max(1, 2 * self.axes)
        self.signs = [[np.random.default_rng([seed, t, which, self.size]).choice([-1.0, 1.0], (3, self.size)) for which in range(2 if self.axes else 1)] for t in range(tables)]

    def turned(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : self.dim] = unit
        for signs in self.signs[table][which]:
            x = hadamard(x * signs) / math.sqrt(self.size)
        return x if which == 0 else x[:, : self.axes]

    @staticmethod
    def nearest(y: np.ndarray) -> np.ndarray:
        at = np.abs(y).argmax(1)
        return 2 * at + (y[np.arange(len(y)), at] < 0)

    def code(self, unit: np.ndarray, table: int) -> np.ndarray:
        out = self.nearest(self.turned(unit, table, 0))
        return out * (2 * self.axes) + self.nearest(self.turned(unit, table, 1)) if self.axes else out

    def order(self, unit: np.ndarray, table: int) -> np.ndarray:
        """All codes for each vector, those of the nearest axes first."""
        loss = self._loss(self.turned(unit, table, 0))
        if self.axes:
            loss = (loss[:, :, None] + self._loss(self.turned(unit, table, 1))[:, None, :]).reshape(len(unit), -1)
        return np.argsort(loss, axis=1, kind="stable")

    @staticmethod
    def _loss(y: np.ndarray) -> np.ndarray:
        return (np.abs(y).max(1)[:, None] - np.stack([y, -y], 2).reshape(len(y), -1)) ** 2


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no cosine, such that no square overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _by_dim(vectors: pa.Array):
    """(rows' positions, their vectors as one scaled matrix) for each number of components."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths := vectors.value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, scaled(flat[(ends[at] - dim)[:, None] + np.arange(dim)])


def best_pairs(asking: np.ndarray, held: np.ndarray, least: np.ndarray, k: int):
    """For each row of ``asking`` the positions and exact cosines of its ``k`` best rows of ``held``, ties to the smaller ``least``."""
    near = _unit(asking) @ _unit(held).T
    norms, own = np.sqrt((held * held).sum(1)), np.sqrt((asking * asking).sum(1))
    from_ = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(1)
    for i in range(len(asking)):
        at = np.flatnonzero(near[i] >= from_[i] - CLOSE)
        score = (held[at] * asking[i]).sum(1) / (own[i] * norms[at])
        first = np.lexsort((least[at], -score))[:k]
        yield at[first], score[first]


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    held = F.col("`" + vector_col.replace("`", "``") + "`")
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"
    v = F.col("vec")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    ids = F.col("`" + id_col.replace("`", "``") + "`").cast("bigint")
    return df.select(ids.alias("vec_id"), held.cast(f"array<{kind}>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))


def _classes(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """One row for each distinct vector: cls, vec, members (its k + 1 least ids) and whether a query has it."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    members = rows.withColumn("__n", nth).where(F.col("__n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    asked = rows.where(asks).groupBy("vec").agg(F.lit(True).alias("asks"))
    return members.join(asked, "vec", "left").select(F.monotonically_increasing_id().alias("cls"), "vec", "members", F.coalesce("asks", F.lit(False)).alias("asks"))


def _fitted_probes(classes: DataFrame, count: int, k: int, tables: int, seed: int, sample: int, target: float) -> int:
    """The least number of probes that finds ``target`` of the exact neighbours of a sample of query vectors."""
    asked = classes.where("asks").orderBy(F.xxhash64("vec"), "cls").limit(sample).select("cls", "vec").toArrow().combine_chunks()
    if not len(asked):
        return 1
    asked_cls = asked["cls"].to_numpy()
    groups = {m.shape[1]: (asked_cls[at], m) for at, m in _by_dim(asked["vec"])}
    names = ["asking", "score", "least", "codes"]

    def run(batches):
        for b in batches:
            cls, least, out = b["cls"].to_numpy(), b["least"].to_numpy(), []
            for at, m in _by_dim(b["vec"]):
                if m.shape[1] not in groups:
                    continue
                h, (asking_cls, asking) = Hashes(m.shape[1], count, tables, seed), groups[m.shape[1]]
                for who, (pos, score) in zip(asking_cls, best_pairs(asking, m, least[at], k + 1), strict=True):
                    codes = np.stack([h.code(_unit(m[pos]), t) for t in range(tables)], 1)
                    out += [(int(who), float(s), int(least[at[p]]), c.tolist()) for p, s, c in zip(pos, score, codes, strict=True) if cls[at[p]] != who]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)

    met = map_arrow(classes.select("cls", "vec", F.col("members")[0].alias("least")), run, "asking bigint, score double, least bigint, codes array<bigint>")
    nth = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "least"))
    nearest: dict[int, list[list[int]]] = {}  # at most ``sample * k`` rows
    for who, codes in met.withColumn("__n", nth).where(F.col("__n") <= k).select("asking", "codes").collect():
        nearest.setdefault(who, []).append(codes)
    ranks = []
    for asking_cls, asking in groups.values():
        h = Hashes(asking.shape[1], count, tables, seed)
        for who, q in zip(asking_cls.tolist(), _unit(asking), strict=True):
            at = [np.argsort(h.order(q[None], t)[0]) for t in range(tables)]
            ranks += [min(int(at[t][c]) for t, c in enumerate(codes)) for codes in nearest.get(who, [])]
    return 1 + sorted(ranks)[math.ceil(target * len(ranks)) - 1] if ranks else 1


def _coded(classes: DataFrame, count: int, tables: int, seed: int, probes: int | None) -> DataFrame:
    """Classes with their code in each table, and for those that ask the codes they probe (all, without ``probes``): table * MOST_CODES * 2 + code."""

    def run(batches):
        for b in batches:
            n, asks = b.num_rows, b["asks"].to_numpy(zero_copy_only=False)
            codes, probed = np.zeros((n, tables), np.int64), [[] for _ in range(n)]
            for at, m in _by_dim(b["vec"]):
                h, unit = Hashes(m.shape[1], count, tables, seed), _unit(m)
                asking = np.flatnonzero(asks[at])
                for t in range(tables):
                    codes[at, t] = h.code(unit, t) + t * 2 * MOST_CODES
                for i in range(0, len(asking), 64):
                    own = asking[i : i + 64]
                    for t in range(tables if probes else 1):
                        for a, o in zip(at[own], h.order(unit[own], t)[:, :probes] + t * 2 * MOST_CODES, strict=True):
                            probed[a] += o.tolist()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b["cls"], b["vec"], b["least"], lists, pa.array(probed, pa.list_(pa.int64()))], names=["cls", "vec", "least", "codes", "probed"])

    kind = dict(classes.dtypes)["vec"]
    return map_arrow(classes.select("cls", "vec", F.col("members")[0].alias("least"), "asks"), run, f"cls bigint, vec {kind}, least bigint, codes array<bigint>, probed array<bigint>")


def _search(coded: DataFrame, k: int) -> DataFrame:
    """asking, cls, score: the best k + 1 classes under the codes that each asking class probes."""
    size = F.size("vec").alias("dim")
    held = coded.select(size, F.explode("codes").alias("code"), "cls", "least", "vec")
    asking = coded.where(F.size("probed") > 0).select(size, F.explode("probed").alias("code"), F.col("cls").alias("asking"), F.col("vec").alias("own"))
    blocks = held.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = asking.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("asked"))
    pieces = materialize(blocks.join(asked, ["dim", "code"]), "neighbours-pieces")
    left = held.join(pieces, ["dim", "code"]).select("dim", "code", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("part"), "cls", "least", "vec")
    right = asking.join(pieces, ["dim", "code"]).select("dim", "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("asking"), "asked").cast("int").alias("part"), "asking", "own")
    piece = ["dim", "code", "block", "part"]

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(held) or not len(asking):
            return _FOUND.empty_table()
        (_, m), (_, q) = next(_by_dim(held["vec"])), next(_by_dim(asking["own"]))
        cls, least, who = held["cls"].to_numpy(), held["least"].to_numpy(), asking["asking"].to_numpy()
        at, score = zip(*best_pairs(q, m, least, k + 1), strict=True)
        n, at = [len(x) for x in at], np.concatenate(at)
        return pa.Table.from_arrays([pa.array(np.repeat(who, n)), pa.array(np.concatenate(score)), pa.array(least[at]), pa.array(cls[at])], schema=_FOUND)

    met = left.groupBy(*piece).cogroup(right.groupBy(*piece)).applyInArrow(meet, "asking bigint, score double, least bigint, cls bigint")
    nth = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "least", "cls"))
    return met.distinct().withColumn("__n", nth).where(F.col("__n") <= k + 1).select("asking", "cls", "score")


def neighbours(df: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, sample: int = 100, target: float = 0.98, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that ``asks`` (a condition on vec_id), by cosine."""
    rows = _usable(df, id_col, vector_col)
    classes = materialize(_classes(rows, asks, k), "neighbours-classes")
    count = classes.count()
    probes = _fitted_probes(classes, count, k, tables, seed, sample, target)
    coded = materialize(_coded(classes, count, tables, seed, probes), "neighbours-coded")
    found = materialize(_search(coded, k), "neighbours-found")
    # Who lacks answers, by rows and not by classes: a class may have many rows.
    sizes = classes.groupBy(F.size("vec").alias("dim")).agg(F.sum(F.size("members")).alias("there"))
    got = found.join(classes.select("cls", F.size("members").alias("rows")), "cls").groupBy("asking").agg(F.sum("rows").alias("got"))
    short = classes.where("asks").join(got, F.col("cls") == F.col("asking"), "left").join(F.broadcast(sizes) if _few(sizes) else sizes, F.size("vec") == F.col("dim"))
    short = materialize(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("cls"), "neighbours-short")
    if not short.isEmpty():
        again = classes.join(short.withColumn("__short", F.lit(True)), "cls", "left").withColumn("asks", F.coalesce("__short", F.lit(False)))
        every = materialize(_coded(again, count, tables, seed, None), "neighbours-coded")
        found = materialize(found.join(short, found["asking"] == short["cls"], "left_anti").unionByName(_search(every, k)), "neighbours-found")
        discard(every)
    discard(coded, short)
    own = F.col("asking") == F.col("cls")
    named = found.join(classes.select("cls", "members"), "cls").select("asking", (-F.col("score")).alias("far"), F.explode("members").alias("vec_id"), own.alias("own"))
    # At most (k + 1) ** 2 rows for each asking class.
    lists = named.groupBy("asking").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "vec_id", "own"))), 1, k + 1).alias("near"))
    by_vec = lists.join(classes.select(F.col("cls").alias("asking"), "vec"), "asking").select("vec", "near")
    asking = rows.where(asks).select(F.col("vec_id").alias("query_id"), "vec").join(by_vec, "vec").select("query_id", "near")
    # A query's own row is the first of its class with its id.
    self_at = F.array_position(F.transform("near", lambda e: e["own"] & (e["vec_id"] == F.col("query_id"))), True)
    others = asking.select("query_id", "near", self_at.alias("self")).select("query_id", F.slice(F.filter("near", lambda _, i: i + 1 != F.col("self")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))


def _few(sizes: DataFrame) -> bool:
    """Whether there are at most 1,000 different numbers of components."""
    return sizes.limit(1001).count() <= 1000
