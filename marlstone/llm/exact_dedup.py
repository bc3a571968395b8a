r"""Exact dedup by content-defined chunk recipes, in DataFrame expressions only.

A text is normalised by deleting blanks, tabs, LF, VT, FF and CR (null counts as empty) and cut into chunks whose ends
depend on the content alone: after at least ``min_chunk`` characters a chunk ends behind the next of ``.!?;:``, and after
``max_chunk`` characters at the latest. Each distinct chunk gets a verified identifier: its 64-bit hash, and, for the few
hashes that two different chunks share, also the SHA-256 of the chunk. That no two chunks of a hash differ is checked on
the chunks themselves over the whole corpus: they are shuffled once, already reduced to distinct ones in each task. From
there on documents are ordered lists of identifiers (8 bytes for some hundred characters), and equal lists are equal
texts; whole texts are never shuffled or compared again.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id (a
null doc_id counts as the largest). Defined results: null and empty texts form one group; each row of the table has its
row in the result; of rows that repeat a doc_id and a text just one is kept; extra columns play no part; an empty table
gives an empty table. A very long text becomes many chunks, of which only identifiers travel on. A hot group is reduced in each task before the shuffle, and its rows then meet one row that says
who stays, a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, materialize, one_of_each, settled, text_or_empty

#: What stands for a null doc_id where the smallest wins.
_LAST = (1 << 63) - 1


def normalised(text: str | Column = "text") -> Column:
    out = text_or_empty(text)
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column, min_chunk: int = 512, max_chunk: int = 4096) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    end = f"(?s).{{{min_chunk},{max_chunk}}}?[.!?;:]|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(end), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    """bits under 64 are for tests: they make hashes collide."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def shared_hashes(docs: DataFrame, bits: int = 64, **sizes: int) -> DataFrame:
    """Hashes that two or more different chunks of the corpus have; next to none at 64 bits."""
    own = docs.select(F.explode(chunks(normalised(), **sizes)).alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk")
    return own.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def recipes(docs: DataFrame, shared: list[int] | DataFrame | None, bits: int = 64, **sizes: int) -> DataFrame:
    """doc_id, __len (code points of the original), text_sha256 and the recipe, a list of verified identifiers."""
    norm = docs.select("doc_id", F.length(text_or_empty()).alias("__len"), normalised().alias("__norm"))
    cut = norm.select("doc_id", "__len", F.sha2("__norm", 256).alias("text_sha256"), chunks(F.col("__norm"), **sizes).alias("__chunks"))
    plain = F.transform("__chunks", lambda c: chunk_hash(c, bits))
    if not shared:
        return cut.select("doc_id", "__len", "text_sha256", plain.alias("recipe"))
    known = F.array(*[F.lit(h) for h in shared])
    ids = F.transform("__chunks", lambda c: F.concat(chunk_hash(c, bits).cast("string"), F.when(F.array_contains(known, chunk_hash(c, bits)), F.concat(F.lit(":"), F.sha2(c, 256))).otherwise("")))
    return cut.select("doc_id", "__len", "text_sha256", ids.alias("recipe"))


def verified_recipes(docs: DataFrame, bits: int = 64, max_shared: int = 10_000, **sizes: int) -> DataFrame:
    """The recipes of all rows.

    Runs one job to verify the chunk hashes. Should more than ``max_shared`` hashes be shared by different chunks, every
    identifier is a SHA-256, so that the list of them need not travel to the tasks.
    """
    own = docs.select("doc_id", "text")
    found = shared_hashes(own, bits, **sizes).limit(max_shared + 1).collect()
    if len(found) > max_shared:
        norm = own.select("doc_id", F.length(text_or_empty()).alias("__len"), normalised().alias("__norm"))
        made = norm.select("doc_id", "__len", F.sha2("__norm", 256).alias("text_sha256"), F.transform(chunks(F.col("__norm"), **sizes), lambda c: F.sha2(c, 256)).alias("recipe"))
    else:
        made = recipes(own, [r["h"] for r in found], bits, **sizes)
    return made.withColumn("__by", F.coalesce("doc_id", F.lit(_LAST)))


def _decided(made: DataFrame) -> tuple[DataFrame, Column]:
    """Distinct (doc_id, text) with what stays of their group, and whether it is this one."""
    # Rows that repeat a document become one row with their number, so that one of them can stay.
    rows = materialize(made.groupBy("recipe", "text_sha256", "__len", "__by", "doc_id").agg(F.count(F.lit(1)).alias("__times")), "recipes")
    best = F.max(F.struct(F.col("__len").alias("l"), (-F.col("__by")).alias("b")))
    keep = rows.groupBy("recipe").agg(best.alias("__best"), F.sum("__times").alias("group_size"))
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot group.
    keep = materialize(keep.select(F.col("recipe").alias("__recipe"), "group_size", F.col("__best.l").alias("__best_len"), (-F.col("__best.b")).alias("__best_by")), "keepers")
    rows = rows.join(keep, rows["recipe"] == keep["__recipe"])
    return rows, (F.col("__len") == F.col("__best_len")) & (F.col("__by") == F.col("__best_by"))


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    made = verified_recipes(docs.select("doc_id", "text"), **how)
    rows, wins = _decided(made)
    out = rows.select("doc_id", F.when(F.col("__best_by") < _LAST, F.col("__best_by")).alias("keep_id"), "group_size", wins.alias("__wins"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__i"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("__wins") & (F.col("__i") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept; of rows that repeat its doc_id and text the least one, by its columns in their order."""

    def winners() -> DataFrame:
        rows, wins = _decided(verified_recipes(docs.select("doc_id", "text"), **how))
        return rows.where(wins).select(F.col("doc_id").alias("__doc_id"), F.col("text_sha256").alias("__sha"), F.col("__len").alias("__length"), "__times")

    kept = settled(winners, "kept")
    # Columns go by place, so that their names may be any.
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    own = docs.toDF(*names).withColumns({"__own_sha": F.sha2(normalised(text), 256), "__own_length": F.length(text_or_empty(text))})
    same = own[doc_id].eqNullSafe(kept["__doc_id"]) & (own["__own_sha"] == kept["__sha"]) & (own["__own_length"] == kept["__length"])
    out = own.join(kept, same, "left_semi")
    if not kept.where("__times > 1").isEmpty():
        out = one_of_each(out, [doc_id, "__own_sha", "__own_length"])
    return out.select(*names).toDF(*docs.columns)
