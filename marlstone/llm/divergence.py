"""How the sources of a language differ: divergences between them, and the terms that set each apart.

Terms are runs of letters A-Z and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms of at least ``least_docs`` of
its documents (rows). A group (language, source), or a whole language, gives a kept term the smoothed share
``p = 1 + floor(UNIT * (count + 1) / (N + V))``, N its occurrences of kept terms and V their number; two shares differ by
``f = floor((p - q)^2 / q)``. All of it is whole numbers.

``pair`` rows sum f over all kept terms for every two sources of a language, the group's share against the other's. Most terms occur in
neither or in one of the two, where f is a baseline of the two groups or depends on one count alone: the sum is V times the baseline,
plus a correction for each distinct count of either group (times the terms that have it), plus one for each term that both hold. So work
follows the occurring (group, term) rows, not the whole matrix.

``term`` rows are the ``k`` terms whose share in a group exceeds the language's, by f and then UTF-8 bytes. They are found by radix
selection: a round counts a group's candidates by the leading bits of their values, from its least to its greatest value, and keeps the
bin that holds the k-th; bins that hold one value are refined by bytes of the terms in the same way, from where these begin to differ.
Candidates above the bin stay, those below go. Rounds end when no group's bin has more than ``SMALL`` rows that are not all needed, and
only these few are sorted. No group is ever gathered in one task.

Defined results: null text, lang and source are ''; a text without terms adds nothing but its group; a language without kept terms has
pair values of 0; repeated rows are documents of their own; an empty table gives an empty one; a very long term is a term like others;
other columns are not looked at. Exact while a count is below 9e13 and V below 1e9.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

UNIT_A, UNIT_B = 100_000, 10_000  # whose product is the unit of shares
#: Bits of a value that one round of selection looks at, and bytes of a term.
BITS, BYTES = 10, 2
#: Rows of a bin that are few enough to be sorted.
SMALL = 2048
#: Terms and bytes of terms that a task counts before it passes the counts on.
HELD_TERMS, HELD_BYTES = 200_000, 8 << 20
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_GROUP = ["lang", "source"]


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8; separators are ASCII, so bytes split as characters do."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term, summed within tasks first."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted():
            for (lang, source), (n, docs) in held.items():
                own = list(n)
                size = len(own)
                words = pa.array(own, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), words, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in own], pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own = terms(text)
                n.update(own)
                docs.update(set(own))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS or sum(len(t) for n, _ in held.values() for t in n) > HELD_BYTES:
                yield from counted()
        yield from counted()

    blank = F.lit("")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")])
    each = map_arrow(own, run, "lang string, source string, term string, n bigint, docs bigint", heavy="text", most=2 << 20)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> str:
    """SQL for a smoothed share; two divisions, so that products stay within 64 bits."""
    a, b = f"(({n} + 1) * {UNIT_A}L)", f"greatest({total} + {kept}, 1)"
    return f"(1 + ({a} div {b}) * {UNIT_B}L + (({a} % {b}) * {UNIT_B}L) div {b})"


def differ(p: str, q: str) -> str:
    """SQL for how far two shares differ."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def _bin_sizes(open_: DataFrame, by: list[str], digit: str, down: bool) -> DataFrame:
    """Of each group's bins the one that holds the last row needed: its ``digit``, rows ``n``, and how many of them are needed."""
    order = F.desc(digit) if down else F.asc(digit)
    sofar = F.sum("n").over(Window.partitionBy(*by).orderBy(order))
    total = F.sum("n").over(Window.partitionBy(*by))
    own = open_.withColumns({"sofar": sofar, "total": total})
    own = own.where((F.col("sofar") - F.col("n") < F.col("need")) & ((F.col("sofar") >= F.col("need")) | (F.col("sofar") == F.col("total"))))
    return own.withColumn("need", F.col("need") - (F.col("sofar") - F.col("n"))).drop("sofar", "total")


def top_by_radix(rows: DataFrame, by: list[str], k: int, small: int = SMALL, bits: int = BITS) -> DataFrame:
    """``rows(*by, item, value)`` with the ``k`` greatest values of each group, ties to the least item in UTF-8, and their rank.

    Items are distinct within a group, values are not negative; ``rows`` is read in each round, so it is a table.
    """
    live, mine = rows, []
    bins = rows.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("need", F.lit(k).cast("bigint"))
    bins = materialize(bins, "radix-bins")
    mine.append(bins)
    while not bins.where(f"n > {small} AND n > need AND lo < hi").isEmpty():
        digit = F.expr(f"shiftright(value - lo, greatest(length(bin(hi - lo)) - {bits}, 0))").alias("digit")
        inside = live.join(bins.drop("n"), by).where("value BETWEEN lo AND hi")
        sizes = inside.groupBy(*by, digit, "need").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
        bins = materialize(_bin_sizes(sizes, by, "digit", True).drop("digit"), "radix-bins")
        live = materialize(live.join(bins.select(*by, "lo"), by).where("value >= lo").drop("lo"), "radix-live")
        mine += [bins, live]
    tied = materialize(live.join(bins.where(f"n > {small} AND n > need"), by).where("value = lo").groupBy(*by, "need", F.col("lo").alias("at")).agg(F.min("item").alias("first"), F.max("item").alias("last"), F.count(F.lit(1)).alias("n")), "radix-ties")
    mine.append(tied)
    while not tied.where(f"n > {small} AND n > need").isEmpty():
        # Bytes that the first and the last of the tied terms have in common, all of them have.
        alike = F.expr("transform(sequence(1, greatest(1, least(octet_length(first), octet_length(last)))), i -> substring(CAST(first AS binary), i, 1) = substring(CAST(last AS binary), i, 1))")
        same = F.array_position(alike, False)
        bounds = tied.where("n > need").select(*by, "at", "need", "first", "last", F.when(same > 0, same - 1).otherwise(F.expr("least(octet_length(first), octet_length(last))")).cast("int").alias("same"))
        key = F.expr(f"substring(CAST(item AS binary), same + 1, {BYTES})").alias("digit")
        inside = live.join(bounds, by).where("value = at AND item >= first AND item <= last")
        sizes = inside.groupBy(*by, "at", "need", key).agg(F.min("item").alias("first"), F.max("item").alias("last"), F.count(F.lit(1)).alias("n"))
        tied = materialize(_bin_sizes(sizes, by, "digit", False).drop("digit"), "radix-ties")
        live = materialize(live.join(tied.select(*by, "at", "last"), by, "left").where("at IS NULL OR value > at OR item <= last").drop("at", "last"), "radix-live")
        mine += [tied, live]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    out = materialize(live.withColumn("rank", nth).where(F.col("rank") <= k), "radix-top")
    discard(*mine)
    return out


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, of ``rows(lang, source, term, n)``."""
    own = groups.select("lang", "source", "kept", "total", F.expr(share("0L", "total", "kept")).alias("p0"))
    one, other = own.select("lang", "source", "kept", "p0"), own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    value = lambda sql: F.expr(sql).alias("value")
    base = one.join(other, "lang").where(apart).select("lang", "source", "item", value(f"kept * {differ('p0', 'q0')}"))
    shares = rows.join(own, _GROUP).select("lang", "source", "term", F.expr(share("n", "total", "kept")).alias("p"), "p0")
    shares = materialize(shares, "divergence-shares")
    # A group's terms of one count have one share.
    counts = materialize(shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")), "divergence-counts")
    first = counts.join(other, "lang").where(apart).select("lang", "source", "item", value(f"m * ({differ('p', 'q0')} - {differ('p0', 'q0')})"))
    second = counts.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "m").join(one.drop("kept"), "lang").where(apart)
    second = second.select("lang", "source", "item", value(f"m * ({differ('p0', 'q')} - {differ('p0', 'q0')})"))
    both = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).where(apart)
    both = both.select("lang", "source", "item", value(f"{differ('p', 'q')} - {differ('p', 'q0')} - {differ('p0', 'q')} + {differ('p0', 'q0')}"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (first, second, both)]
    whole = base.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, k: int = 200, least_docs: int = 3) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows of all other sources and the ``term`` rows to rank ``k`` of each group."""
    counts = materialize(term_counts(docs), "divergence-terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    vocabulary = materialize(vocabulary.select("lang", "term", "lang_n"), "divergence-vocabulary")
    rows = materialize(counts.drop("docs").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-rows")
    blank, none = F.lit(""), F.lit(0).cast("bigint")
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in _GROUP]).distinct()
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = there.join(rows.groupBy(*_GROUP).agg(F.sum("n").alias("total")), _GROUP, "left").join(langs, "lang", "left")
    groups = materialize(groups.select(*_GROUP, *[F.coalesce(c, none).alias(c) for c in ("total", "kept", "lang_total")]), "divergence-groups")
    discard(counts, vocabulary)
    p, q = share("n", "total", "kept"), share("lang_n", "lang_total", "kept")
    scored = rows.join(groups, _GROUP).select(*_GROUP, F.col("term").alias("item"), F.expr(p).alias("p"), F.expr(q).alias("q")).where("p > q")
    scored = materialize(scored.select(*_GROUP, "item", F.expr(differ("p", "q")).alias("value")), "divergence-scored")
    best = top_by_radix(scored, _GROUP, k)
    nth = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))
    pairs = _pairs(rows.select("lang", "source", "term", "n"), groups).withColumn("rank", nth)
    discard(scored)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
