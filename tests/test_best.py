"""Searches by matrix products against brute force: ties, odd vectors, many batches, and plans without pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import ivf, retrieval


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


def distance(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    return math.floor((1 - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))) * 1e6 + 0.5) / 1e6


def test_knn_of_copies_and_odd_vectors(spark, small_batches):
    """Copies rank by id over all batches; null and zero vectors, those with holes and those of another size take no part."""
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    own = {f"c{k:03}": base[k % 20] if k % 3 else [rng.gauss(0, 1) for _ in range(6)] for k in range(300)}
    odd = {"a": None, "b": [0.0] * 6, "c": [1.0, None, 0.0, 0.0, 0.0, 0.0], "d": [1.0] * 5, "e": [float("nan")] * 6}
    v = spark.createDataFrame([*own.items(), *odd.items()], "chunk_id string, embedding array<double>").repartition(3)
    q = v.where("chunk_id < 'c04' AND chunk_id <> 'd'").select(F.col("chunk_id").alias("query_id"), "embedding")
    asked = {k: x for k, x in own.items() if k < "c04"}
    want = []
    for name, x in asked.items():
        near = sorted((distance(x, y), k) for k, y in own.items())[:5]
        want += [(name, i + 1, k, d) for i, (d, k) in enumerate(near)]
    assert hits(retrieval.knn(q, v, 5)) == hits(retrieval.knn(q, v, 5, 200)) == sorted(want)


def test_searches_make_no_pairs(spark, tmp_path):
    """Neither exact nor list search joins questions with vectors, and BM25 shuffles no pair of a question and a chunk."""
    rng = random.Random(2)
    v = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(50)], "chunk_id bigint, embedding array<float>")
    q = v.limit(5).withColumnRenamed("chunk_id", "query_id")
    ivf.write(v, str(tmp_path), 4)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (retrieval.knn(q, v, 3), ivf.search(q, str(tmp_path), 3, 2))]
    assert not any("Join" in p for p in plans)
    assert ivf.vectors_read(q, str(tmp_path), 2).first()[0] == ivf.candidates(q, str(tmp_path), 2).count()
    chunks = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(40)], "chunk_id bigint, text string")
    asked = spark.createDataFrame([(k, f"a b{k} c{k + 9}") for k in range(4)], "query_id bigint, question string")
    assert not any(x in retrieval.bm25(asked, chunks, 3)._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))


def test_bm25_in_small_batches(spark, small_batches, tmp_path):
    """Chunks that are cut by batches, texts that are null or empty, and repeated questions' terms."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randrange(0, 30))) for _ in range(120)] + [None, ""]
    rows = list(enumerate(texts))
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3).withColumn("text", F.coalesce("text", F.lit("")))
    ask = {0: "w1 w2 w2", 1: "w3 w4 w11 nothing", 2: "", 3: "w7"}
    asked = spark.createDataFrame(list(ask.items()), "query_id bigint, question string")
    own = {k: (t or "").split() for k, t in rows}
    n, avgdl = len(own), sum(map(len, own.values())) / len(own)
    df = {}
    for t in own.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    want = []
    for q, text in ask.items():
        score = {k: round(sum((0.25 * mean if raw[w] < 0 else raw[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.split() if w in t), 6) for k, t in own.items()}
        want += [(q, i + 1, k, s) for i, (s, k) in enumerate(sorted(((s, k) for k, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:6])]
    retrieval.write_bm25(chunks, str(tmp_path), 4)
    assert hits(retrieval.bm25(asked, chunks, 6)) == hits(retrieval.bm25_stored(asked, str(tmp_path), 6)) == sorted(want)
