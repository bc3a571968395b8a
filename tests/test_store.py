"""The store and its parts through inserts, upserts and deletes, against the same tables made at once."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import ivf, retrieval, segments, store
from marlstone.plans import verbs
from tests.test_ingest import GOOD, make_pdf

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 10


def text(rng):
    return " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 30])))


def chunk_rows(spark, rows):
    return spark.createDataFrame([(c, d, t) for c, (d, t) in rows.items()], "chunk_id string, document_id string, text string")


def payload(spark, rows):
    vectors = spark.createDataFrame([(c, [float(len(t)), float(sum(map(ord, t)) % 97), 1.0]) for c, (_, t) in rows.items()], "chunk_id string, embedding array<float>")
    entities = spark.createDataFrame([(w.upper(), c) for c, (_, t) in rows.items() for w in sorted(set(t.split()))[:3]], "entity_name string, chunk_id string")
    return vectors, entities


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 the"), (2, "w3 w3 w39"), (3, "nothing"), (4, "the")], "query_id bigint, question string")


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def check(spark, path, rows):
    assert {(r.chunk_id, r.document_id, r.text) for r in store.table(spark, path, "chunks").collect()} == {(c, *x) for c, x in rows.items()}
    vectors, entities = payload(spark, rows)
    assert sorted((r.chunk_id, list(r.embedding)) for r in store.table(spark, path, "vectors").collect()) == sorted((r.chunk_id, list(r.embedding)) for r in vectors.collect())
    assert sorted((r.entity_name, r.chunk_id) for r in store.table(spark, path, "entities").collect()) == sorted(map(tuple, entities.collect()))
    assert hits(segments.search(asked(spark), f"{path}/bm25", 7)) == hits(retrieval.bm25(asked(spark), chunk_rows(spark, rows), 7))


def test_changes_in_place(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path)
    rows = {f"d{d}:{k}": (f"d{d}", text(rng)) for d in range(30) for k in range(4)}
    put = lambda new, **how: store.apply(spark, path, chunk_rows(spark, new), *payload(spark, new), buckets=8, **how)
    assert put(rows) == {"added": 120, "updated": 0, "skipped": 0, "deleted": 0}
    check(spark, path, rows)
    before = files(path)
    assert put(rows) == {"added": 0, "updated": 0, "skipped": 120, "deleted": 0}
    assert files(path) == before
    # One document changes and one comes: files of the other buckets keep their names.
    new = {"d3:1": ("d3", "w1 w2 w3 new"), "d3:9": ("d3", "w5"), "x:0": ("x", "the w39")}
    assert put(new) == {"added": 2, "updated": 1, "skipped": 0, "deleted": 0}
    rows |= new
    check(spark, path, rows)
    kept = [f for f in before if "/chunks/rows/" in f or "/vectors/rows/" in f]
    assert sum(Path(f).exists() for f in kept) >= len(kept) * 6 / 8 - 1
    # Inserting leaves what is there alone.
    assert put({"d3:1": ("d3", "other"), "y:0": ("y", "")}, replace=False) == {"added": 1, "updated": 0, "skipped": 1, "deleted": 0}
    rows["y:0"] = ("y", "")
    check(spark, path, rows)
    ids = lambda name, x: spark.createDataFrame([(i,) for i in x], f"{name} string")
    assert store.apply(spark, path, gone_documents=ids("document_id", ["d1", "d2", "none"]), gone_chunks=ids("chunk_id", ["d4:0", "d4:0", "none"]), buckets=8)["deleted"] == 9
    rows = {c: x for c, x in rows.items() if x[0] not in ("d1", "d2") and c != "d4:0"}
    check(spark, path, rows)
    # A document as a whole: what it no longer has goes.
    assert put({"d5:0": rows["d5:0"], "d5:7": ("d5", "w7")}, whole_documents=True) == {"added": 1, "updated": 0, "skipped": 1, "deleted": 3}
    rows = {c: x for c, x in rows.items() if x[0] != "d5" or c == "d5:0"} | {"d5:7": ("d5", "w7")}
    check(spark, path, rows)
    assert {r.chunk_id for r in store.chunks_of_document(spark, path, "d5", 8).collect()} == {"d5:0", "d5:7"}
    assert store.chunk_by_id(spark, path, "d5:7").first().text == "w7" and {r.chunk_id for r in store.entity(spark, path, "the").collect()} == {c for c, (_, t) in rows.items() if "the" in sorted(set(t.split()))[:3]}
    store.apply(spark, path, gone_documents=ids("document_id", {d for d, _ in rows.values()}), buckets=8)
    check(spark, path, {})
    put({"z:0": ("z", "w1")})
    check(spark, path, {"z:0": ("z", "w1")})


def test_segments_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    rng, path = random.Random(6), str(tmp_path)
    rows, none = {}, spark.createDataFrame([], "query_id bigint, question string")
    assert segments.search(asked(spark), path).collect() == [] and segments.search(none, path).collect() == []
    for step in range(5):
        new = {f"c{rng.randrange(60)}": ("d", text(rng)) for _ in range(12)}
        gone = rng.sample(sorted(rows), min(len(rows), 4)) + list(new)
        segments.change(spark, path, chunk_rows(spark, new), spark.createDataFrame([(c,) for c in gone], "chunk_id string"), buckets=4)
        rows = {c: x for c, x in rows.items() if c not in gone} | new
        if step == 2:
            assert hits(segments.search(asked(spark), path, 5)) == hits(retrieval.bm25(asked(spark), chunk_rows(spark, rows), 5))
    assert len(list((tmp_path / "totals").glob("segment=*"))) <= segments.MOST_SEGMENTS
    assert hits(segments.search(asked(spark), path, 5)) == hits(retrieval.bm25(asked(spark), chunk_rows(spark, rows), 5))


def test_inverted_lists(spark, tmp_path):
    """Vectors in clusters: a fifth of them is read and nine in ten neighbours are found; all lists give the exact answer; lists change in place."""
    rng, path = np.random.default_rng(4), str(tmp_path)
    centres = rng.normal(size=(40, 32))
    rows = [(int(i), (centres[i % 40] + rng.normal(size=32) * 0.4).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    queries = vectors.where("chunk_id % 60 = 0").withColumnRenamed("chunk_id", "query_id")
    ivf.write(vectors, path, 40, rounds=3)
    exact = retrieval.knn(queries, vectors, 10)
    assert ivf.recall(ivf.search(queries, path, 10, 5), exact).first().recall >= 0.9
    assert ivf.candidates(queries, path, 5).count() < 0.2 * 50 * 3000
    assert hits(ivf.search(queries, path, 10, 40)) == hits(exact)
    gone = vectors.where("chunk_id < 1000").select("chunk_id")
    ivf.remove(gone, path)
    ivf.add(vectors.where("chunk_id < 500"), path)
    left = vectors.where("chunk_id < 500 OR chunk_id >= 1000")
    assert hits(ivf.search(queries, path, 10, 40)) == hits(retrieval.knn(queries, left, 10))
    with pytest.raises(ValueError):
        ivf.train(vectors, ivf.MOST_LISTS + 1)


def test_ingest_again(spark, tmp_path):
    """The same folder twice, then with a file more, a file changed and a copy: nothing is lost, nothing is there twice."""
    root, path = tmp_path / "in", str(tmp_path / "index")
    root.mkdir()
    (root / "a[1].pdf").write_bytes(GOOD)
    (root / "b.pdf").write_bytes(make_pdf([[(18, "Head"), (11, "alpha beta")]]))
    (root / "bad.pdf").write_bytes(b"no")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id bigint, question string")
    words = lambda: {(r.query_id, "alpha" in r.text, "gamma" in r.text) for r in segment_hits()}

    def segment_hits():
        return segments.search(q, f"{path}/bm25", 5).join(store.table(spark, path, "chunks"), "chunk_id").collect()

    made = verbs.ingest_and_index(spark, str(root), path)
    assert made["documents"].count() == 2 and made["failures"].count() == 1
    first = verbs.stats(spark, path).first()
    assert (first.total_documents, words()) == (2, {(1, True, False)})
    again = verbs.ingest_and_index(spark, str(root), path)
    assert again["documents"].count() == 0 and again["failures"].count() == 0 and verbs.stats(spark, path).first() == first
    (root / "c.pdf").write_bytes(make_pdf([[(18, "Third"), (11, "gamma delta")]]))
    (root / "copy.pdf").write_bytes(GOOD)
    third = verbs.ingest_and_index(spark, str(root), path)
    assert [r.filename for r in third["documents"].collect()] == ["c.pdf"]
    assert verbs.stats(spark, path).first().total_documents == 3 and words() == {(1, True, False), (2, False, True)}
    verbs.train_lists(spark, path, 4)
    best = verbs.search(spark, path, q, 3, entities=True, probes=4).where("query_id = 2").orderBy("rank").first()
    assert "gamma" in best.text
    plan = verbs.search(spark, path, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
