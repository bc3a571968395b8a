"""Toxicity from class-conditional Kneser-Ney models.

Words are sequences of characters, and each class (toxic, ordinary) has an interpolated Kneser-Ney model over them: at the
highest order the counts of character n-grams in the distinct words of the class's texts, below it the numbers of distinct
characters in front of them, with absolute discounting. Orders up to ``SHARED`` pool both classes, so an expression that neither
class knows gets the same probability from either and says nothing. A word says the difference of its two log-likelihoods. A text's
features are that difference per character over all its distinct words, what its five most telling words say, how much its words
say beyond one, two and three, how many say more than two and three, and the length that all of this is to be measured against: a
long text has more words that say much by chance. A logistic fit turns them into a score; in it toxic rows weigh as much together as
all ordinary ones do, so that likelihoods decide and not the share of toxic rows among the labels.

Fitting uses labelled rows whose ``crc32(doc_id as text) mod 3`` is not 1, in ``PARTS`` parts. There is one model for each part, of the
counts of all the others, and one of all counts. The logistic fit compares rows (at most ``calibration_rows`` of them, the first by
hash of doc_id) by the model that lacks their part, so that it sees texts that the counts do not know under nearly as many counts as
the model of all has, which scores. All models are columns of the same tables, counted at once. Counting is distributed: word counts
by class and part first, n-grams from the distinct words. A model is tables of n-grams and contexts, as many as were counted.

Scoring joins with these tables under the n-grams themselves: distinct n-grams of words, then distinct words, then texts. What
nearly every text asks for comes first to the tasks, so that it is not joined: the likelihoods of the ``COMMON_GRAMS`` most counted
n-grams and of the ``COMMON_WORDS`` most counted words, exact like all others. Likelihoods are whole billionths, so that sums do not
depend on an order.

Defined results: a null or empty text (or one without words) has all features 0 and so the score that the fit gives them; a null
doc_id is not held out and never trains; conflicting labels count as toxic; repeated rows are scored one by one, and of several texts
of a doc_id the greatest calibrates; with no labelled rows of a class every score is 0; columns named held_out, score or predicted
are replaced, all others stay; an empty table gives an empty table. A very long text is read whole, as the set of its distinct words.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, map_arrow, materialize, release, resident, settled, text_or_empty

ORDER, SHARED, DISCOUNT = 5, 2, 0.75
#: Parts of the labelled rows; the models lack one part each, and the last one lacks none.
PARTS = 4
ALL = PARTS
MODELS = range(PARTS + 1)
#: How many of the most counted n-grams and words the tasks hold; all others are joined.
COMMON_GRAMS, COMMON_WORDS = 100_000, 100_000
#: Log-likelihoods are whole numbers of this part.
UNIT = 1e9
#: The least probability of a character in any context.
FLOOR = 1e-4
#: How many of a text's most telling words are features of their own.
TOP = 5
_PAD, _END = "\x02", "\x03"
_STRIP = ".,;:!?\"'()[]{}<>«»„“”…-–—*#$%&+=/\\|~^_`"
_COUNTS = [f"{c}{k}" for c in "to" for k in range(PARTS)]
_SAID = [f"said{m}" for m in MODELS]


class _Shared:
    """A compressed broadcast with an identity that reaches the workers."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(value), 1))
        self.id = self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(value)

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def value(self):
        return pickle.loads(zlib.decompress(self.held.value))


class Model(NamedTuple):
    """By order from SHARED + 1 to ORDER: for n-grams (g) the discounted share in their context, for contexts (h) the weight of what is below, by class and model."""

    shares: list[DataFrame]  # g, t0.., o0..
    weights: list[DataFrame]  # h, t0.., o0..
    base: DataFrame  # g, p0..: probability by the shared orders
    grams: _Shared  # the most counted n-grams: what they say
    words: _Shared | None  # the most counted words: what they say
    fit: np.ndarray | None  # intercept, then a weight for each feature


def _grams(word: str) -> list[str]:
    padded = _PAD * (ORDER - 1) + word + _END
    return [padded[k : k + ORDER] for k in range(len(word) + 1)]


def words_of(text: str) -> set[str]:
    """The distinct words of a text."""
    return {w.strip(_STRIP) for w in set(text.lower().split())} - {""}


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, t0.., o0..: in how many toxic and ordinary texts of each part each word comes."""

    def run(batches):
        for b in batches:
            by = [Counter() for _ in _COUNTS]
            for text, toxic, part in zip(*(b[c].to_pylist() for c in ("text", "toxic", "part")), strict=True):
                by[part + PARTS * (not toxic)].update(words_of(text))
            words = list(set().union(*by))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(list(map(c.__getitem__, words)), pa.int64()) for c in by)], names=["word", *_COUNTS])

    found = map_arrow(labelled.select("text", "toxic", "part"), run, "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS), heavy="text")
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def gram_counts(words: DataFrame) -> DataFrame:
    """g, t0.., o0..: counts of all n-grams of the highest order by class and model."""

    def run(batches):
        for b in batches:
            found = [_grams(w) for w in b["word"].to_pylist()]
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            at, of = coded.indices.to_numpy(), np.repeat(np.arange(len(found)), list(map(len, found)))
            sums = [np.bincount(at, b[c].to_numpy()[of], len(coded.dictionary)).astype(np.int64) if len(at) else np.empty(0, np.int64) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, sums)], names=["g", *_COUNTS])

    found = map_arrow(words, run, "g string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return by_model(found.groupBy("g").agg(*[F.sum(c).alias(c) for c in _COUNTS]))


def by_model(counted: DataFrame) -> DataFrame:
    """Counts by class and part turned into counts by class and model."""
    whole = {c: sum((F.col(f"{c}{k}") for k in range(1, PARTS)), F.col(f"{c}0")) for c in "to"}
    return counted.select("g", *[(whole[c] - F.col(f"{c}{m}") if m < PARTS else whole[c]).alias(f"{c}{m}") for c in "to" for m in MODELS])


_CLASSES = [f"{c}{m}" for c in "to" for m in MODELS]


def fit_counts(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The Kneser-Ney tables out of counts of n-grams of the highest order."""
    shares, weights, level = [], [], grams
    for k in range(ORDER, SHARED, -1):
        context = level.groupBy(F.substring("g", 1, k - 1).alias("h")).agg(*[x for c in _CLASSES for x in (F.sum(c).alias(f"n{c}"), F.count_if(F.col(c) > 0).alias(f"k{c}"))])
        share = lambda c: F.when(F.col(f"n{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0)
        rows = level.join(context, F.substring(level["g"], 1, k - 1) == context["h"])
        shares.append(materialize(rows.select("g", *[share(c).alias(c) for c in _CLASSES]), "toxic-shares"))
        weight = lambda c: F.when(F.col(f"n{c}") > 0, F.col(f"k{c}") * DISCOUNT / F.col(f"n{c}")).otherwise(1.0)
        weights.append(materialize(context.select("h", *[weight(c).alias(c) for c in _CLASSES]), "toxic-weights"))
        # One order down, a count is the number of distinct characters in front.
        level = level.groupBy(F.substring("g", 2, k - 1).alias("g")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in _CLASSES])
    level = level.select("g", *[(F.col(f"t{m}") + F.col(f"o{m}")).alias(f"n{m}") for m in MODELS])
    context = level.groupBy(F.substring("g", 1, SHARED - 1).alias("h")).agg(*[x for m in MODELS for x in (F.sum(f"n{m}").alias(f"total{m}"), F.count_if(F.col(f"n{m}") > 0).alias(f"kinds{m}"))])
    rows = level.join(context, F.substring(level["g"], 1, SHARED - 1) == context["h"])
    # Below the shared order all characters are alike.
    base = [((F.greatest(F.col(f"n{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds{m}") * FLOOR) / F.greatest(F.col(f"total{m}"), F.lit(1))).alias(f"p{m}") for m in MODELS]
    return shares[::-1], weights[::-1], materialize(rows.select("g", *base), "toxic-base")


def likelihoods(grams: DataFrame, model: Model, models) -> DataFrame:
    """g, said0..: toxic less ordinary log-likelihood of the last character of the distinct n-grams ``grams`` of the highest order, by each of ``models``."""

    def tail(k: int) -> DataFrame:
        return grams.select(F.substring("g", ORDER - k + 1, k).alias("g")).distinct()

    names = [f"{c}{m}" for c in "to" for m in models]
    p = {m: F.greatest(F.coalesce(f"p{m}", F.lit(FLOOR)), F.lit(FLOOR)) for m in models}
    level = tail(SHARED).join(model.base, "g", "left").select("g", *[p[int(c[1:])].alias(f"p{c}") for c in names])
    for k, (shares, weights) in enumerate(zip(model.shares, model.weights, strict=True), SHARED + 1):
        own = (tail(k) if k < ORDER else grams).withColumns({"h": F.substring("g", 1, k - 1), "low": F.substring("g", 2, k - 1)})
        own = own.join(shares.select("g", *[F.col(c).alias(f"s{c}") for c in names]), "g", "left")
        own = own.join(weights.select("h", *names), "h", "left").join(level.withColumnRenamed("g", "low"), "low")
        level = own.select("g", *[(F.coalesce(f"s{c}", F.lit(0.0)) + F.coalesce(c, F.lit(1.0)) * F.col(f"p{c}")).alias(f"p{c}") for c in names])
    return level.select("g", *[F.round((F.log(f"pt{m}") - F.log(f"po{m}")) * UNIT).cast("bigint").alias(f"said{m}") for m in models])


def _held(rows: DataFrame, key: str) -> _Shared:
    """A broadcast of what the keys of a table of bounded size say by every model."""
    got = rows.select(key, *_SAID).toArrow()
    shared = _Shared(rows.sparkSession, (got[key].to_pylist(), np.stack([got[c].to_numpy() for c in _SAID], 1)))
    del got
    release()  # the driver need not keep what it has sent
    return shared


def _known(held: _Shared) -> tuple[dict[str, int], np.ndarray]:
    """Place by key, and what the keys say; the last row is for keys that are not there."""

    def make():
        keys, said = held.value
        return {k: n for n, k in enumerate(keys)}, np.concatenate([said, np.zeros((1, said.shape[1]), np.int64)])

    return resident(("toxic-known", held.id), make)


def score_words(words: DataFrame, model: Model, models) -> DataFrame:
    """word, said0..: toxic less ordinary log-likelihood of the distinct words ``words`` by each of ``models``."""
    held, models = model.grams, list(models)
    names = [f"said{m}" for m in models]

    def run(batches):
        known, said = _known(held)
        for b in batches:
            found = [_grams(w) for w in b["word"].to_pylist()]
            flat = list(chain.from_iterable(found))
            at = np.array([known.get(g, -1) for g in flat], np.int64)
            bounds = np.cumsum([0, *map(len, found)])
            total = np.add.reduceat(said[at][:, models], bounds[:-1], axis=0) if len(found) else np.empty((0, len(models)), np.int64)
            missing = np.flatnonzero(at < 0)
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, bounds), pa.int32()), pa.array([flat[k] for k in missing.tolist()], pa.string()))
            yield pa.RecordBatch.from_arrays([b["word"], *(pa.array(np.ascontiguousarray(c)) for c in total.T), rest], names=["word", *names, "rest"])

    part = materialize(map_arrow(words.select("word"), run, "word string, " + ", ".join(f"{c} bigint" for c in names) + ", rest array<string>"), "toxic-word-parts")
    rest = part.select("word", F.explode("rest").alias("g"))
    grams = materialize(rest.select("g").distinct(), "toxic-rest-grams")
    if grams.isEmpty():
        return part.select("word", *names)
    # Plain exchanges on both sides: an n-gram of many words is split.
    more = rest.join(likelihoods(grams, model, models).hint("merge"), "g").groupBy("word").agg(*[F.sum(c).alias(f"more_{c}") for c in names])
    whole = part.where("size(rest) > 0").join(more, "word").select("word", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in names])
    return part.where("size(rest) = 0").select("word", *names).unionByName(whole)


class Lexicon:
    """Numbers for the words that a worker meets, with their places among the known ones; forgotten when there are too many."""

    def __init__(self, known: dict[str, int], limit: int = 250_000):
        self.known, self.limit = known, limit
        self.clear()

    def clear(self) -> None:
        # Number 0 is the word of which nothing is left.
        self.raw, self.number, self.words, self.place, self.chars = {}, {"": 0}, [""], [-1], [0]

    def _new(self, raw: str) -> int:
        own = raw.strip(_STRIP)
        if own not in self.number:
            self.number[own] = len(self.words)
            self.words.append(own)
            self.place.append(self.known.get(own, -1))
            self.chars.append(len(own) + 1)
        self.raw[raw] = got = self.number[own]
        return got

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The numbers of each text's distinct words, and how many words it has."""
        if len(self.raw) > self.limit:
            self.clear()
        raw, out, sizes = self.raw, [], []
        for t in texts:
            words = t.lower().split()
            found = {raw[w] if w in raw else self._new(w) for w in set(words)}
            found.discard(0)
            out.append(np.fromiter(found, np.int64, len(found)))
            sizes.append(len(words))
        return out, sizes


_READ = "k bigint, model int, n_words bigint, n bigint, chars bigint, total bigint, beyond1 bigint, beyond2 bigint, beyond3 bigint, over2 bigint, over3 bigint, top array<bigint>, rest array<string>"
_SUMS = ["total", "beyond1", "beyond2", "beyond3", "over2", "over3"]


def _sums(said):
    """What is added up over the words of a text, of what one says (a column or an array)."""
    if isinstance(said, np.ndarray):
        return [said, *(np.maximum(said - int(k * UNIT), 0) for k in (1, 2, 3)), *((said > k * UNIT).astype(np.int64) for k in (2, 3))]
    unit = lambda k: F.lit(int(k * UNIT)).cast("bigint")
    return [said, *(F.greatest(said - unit(k), unit(0)) for k in (1, 2, 3)), *((said > unit(k)).cast("bigint") for k in (2, 3))]


def read_texts(texts: list[str], models: np.ndarray, lexicon: Lexicon, said: np.ndarray) -> list[pa.Array]:
    """The columns of ``_READ`` from n_words on: sums and the top over known words, and the words that are not known."""
    found, n_words = lexicon.read(texts)
    place, chars = np.array(lexicon.place, np.int64), np.array(lexicon.chars, np.int64)
    size = np.array(list(map(len, found)), np.int64)
    flat = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)

    def per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.searchsorted(of, np.arange(len(texts) + 1))])

    at = place[flat]
    hit = at >= 0
    says, its = said[at[hit], models[of[hit]]], of[hit]
    # The most telling words of a text in front.
    order = np.lexsort((-says, its))
    rank = np.arange(len(its)) - np.searchsorted(its, its)
    first = order[rank < TOP]
    tops = pa.ListArray.from_arrays(pa.array(np.searchsorted(its[first], np.arange(len(texts) + 1)), pa.int32()), pa.array(says[first]))
    rest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.bincount(of[~hit], minlength=len(texts))]), pa.int32()), pa.array([lexicon.words[k] for k in flat[~hit].tolist()], pa.string()))
    columns = [np.array(n_words, np.int64), size, per_text(chars[flat], of), *(per_text(x, its) for x in _sums(says))]
    return [*(pa.array(c.astype(np.int64)) for c in columns), tops, rest]


N_FEATURES = 9 + TOP
_FEATURES = [f"x{k}" for k in range(N_FEATURES)]


def features(texts: DataFrame, model: Model, models) -> DataFrame:
    """k and x0.. for each distinct k of ``texts(k, model, text)``, where ``model`` is the number of the model to ask, one of ``models``."""
    held = model.words

    def run(batches):
        known, said = _known(held)
        lexicon = Lexicon(known)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part["k"], part["model"], *read_texts(part["text"].to_pylist(), part["model"].to_numpy(), lexicon, said)], names=[x.split()[0] for x in _READ.split(", ")])

    read = materialize(map_arrow(texts.select("k", "model", "text"), run, _READ, heavy="text"), "toxic-texts").dropDuplicates(["k"])
    models = list(models)
    # Where all texts ask one model its number need not travel with each word.
    rest = read.select("k", *(["model"] if len(models) > 1 else []), F.explode("rest").alias("word"))
    said = settled(lambda: score_words(rest.select("word").distinct(), model, models), "toxic-rest-words")
    own = F.coalesce(*[F.when(F.col("model") == m, F.col(f"said{m}")) for m in models]) if len(models) > 1 else F.col(f"said{models[0]}")
    # Plain exchanges on both sides: a word of many texts is split.
    joined = rest.join(said.hint("merge"), "word").select("k", own.alias("said"))
    more = joined.groupBy("k").agg(*[F.sum(x).alias(f"more_{c}") for c, x in zip(_SUMS, _sums(F.col("said")), strict=True)], F.slice(F.sort_array(F.collect_list("said"), False), 1, TOP).alias("others"))
    made = read.drop("rest").join(more, "k", "left")
    whole = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in _SUMS}
    best = F.slice(F.sort_array(F.concat("top", F.coalesce("others", F.array().cast("array<bigint>"))), False), 1, TOP)
    made = made.select("k", "n", "n_words", "chars", best.alias("best"), *[x.alias(c) for c, x in whole.items()])
    n = F.greatest("n", F.lit(1))
    of = [
        F.col("total") / UNIT / F.greatest("chars", F.lit(1)),
        *(F.coalesce(F.get("best", F.lit(k)), F.lit(0)) / UNIT for k in range(TOP)),
        *(F.col(f"beyond{k}") / UNIT for k in (1, 2, 3)),
        F.col("over3").cast("double"),
        F.log(n.cast("double")),
        F.when(F.col("n") > 0, F.col("n_words") / n).otherwise(0.0),
        F.col("over2") / n,
        F.col("beyond2") / UNIT / F.sqrt(n.cast("double")),
    ]
    return made.select("k", *[x.cast("double").alias(c) for x, c in zip(of, _FEATURES, strict=True)])


def text_key() -> Column:
    return F.xxhash64("doc_id", text_or_empty())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic fit on standardised columns by Newton's method, given for the columns as they are."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / std], 1)
    weight = np.ones(len(y)) if weight is None else weight * len(y) / weight.sum()
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * len(y) * np.r_[0, w[1:]]
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(y) * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / std).sum(), w[1:] / std]


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights of rows by which both classes weigh alike."""
    return np.where(y > 0, (1 - y).sum() / max(y.sum(), 1), 1.0)


def _crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string"))


def remainder(doc_id: str = "doc_id") -> Column:
    return _crc(doc_id) % 3


def part_of(doc_id: str = "doc_id") -> Column:
    return (F.floor(_crc(doc_id) / 3) % PARTS).cast("int")


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000) -> Model | None:
    """The model out of the labelled rows of ``docs``; None if there are none of a class."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder() != 1)
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(remainder() != 1)
    # Shuffled at every size, so that a small set of labels makes no other plan than a large one.
    counted = texts.join(known.hint("merge"), "doc_id").select("text", "toxic", part_of().alias("part"))
    words = materialize(word_counts(counted), "toxic-words")
    grams = materialize(gram_counts(words), "toxic-grams")
    seen = grams.agg(*[F.sum(f"{c}{ALL}").alias(c) for c in "to"]).first()
    if not seen["t"] or not seen["o"]:
        return None
    model = Model(*fit_counts(grams), None, None, None)
    most = materialize(grams.orderBy((F.col(f"t{ALL}") + F.col(f"o{ALL}")).desc(), "g").limit(COMMON_GRAMS).select("g"), "toxic-common")
    model = model._replace(grams=_held(likelihoods(most, model, MODELS), "g"))
    common = materialize(words.orderBy(sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0])).desc(), "word").limit(COMMON_WORDS).select("word"), "toxic-common")
    model = model._replace(words=_held(score_words(common, model, MODELS), "word"))
    discard(words, grams, most, common)
    # At most calibration_rows rows, so this side may be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = materialize(rows.select(F.col("doc_id").alias("k"), part_of().alias("model"), "text", F.col("toxic").cast("int").alias("toxic")), "toxic-calibration")
    got = rows.select("k", "toxic").join(features(rows, model, range(PARTS)), "k").orderBy("k").toArrow()
    y = got["toxic"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return model._replace(fit=logistic(np.stack([got[c].to_numpy() for c in _FEATURES], 1), y, balanced(y)))


def text_scores(docs: DataFrame, model: Model | None, last: bool = False) -> DataFrame:
    """__k and score of each distinct text key of ``docs``. With ``last`` the model isn't asked again, and its tables go."""
    if model is None:
        return docs.select(text_key().alias("__k"), F.lit(0.0).alias("score")).distinct()
    found = features(docs.select(text_key().alias("k"), F.lit(ALL).alias("model"), text_or_empty().alias("text")), model, [ALL])
    if last:
        # All words have been scored by now, and what is left to do reads what they say alone.
        discard(*model.shares, *model.weights, model.base)
    weighed = F.lit(float(model.fit[0]))
    for w, c in zip(model.fit[1:].tolist(), _FEATURES, strict=True):
        weighed = weighed + F.lit(w) * F.col(c)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(weighed, F.lit(40.0)), F.lit(-40.0))))
    return found.select(F.col("k").alias("__k"), score.alias("score"))


def with_scores(docs: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    own = docs.drop("held_out", "score", "predicted")
    own = own.withColumn("held_out", F.coalesce(remainder() == 1, F.lit(False)))
    scored = own.withColumn("__k", text_key()).join(scores, "__k").drop("__k")
    return scored.select(*columns_of(own), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_texts(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with held_out, score and predicted; without a model all scores are 0."""
    return with_scores(docs, settled(lambda: text_scores(docs, model), "toxic-scores"), threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, calibration_rows: int = 20_000) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score every row; the model goes when the scores are written."""
    return with_scores(docs, settled(lambda: text_scores(docs, train(docs, labels, calibration_rows), last=True), "toxic-scores"), threshold)
