"""The stages against what they should do, and the registered queries against their SQL, on the smallest tables."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from test_llm import BYTE, brute_components, corpus, norm
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import catalog, toxicity
from marlstone.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    as_rows = lambda f: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in f[cols].itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
    rows = left.collect()
    assert 0 < len(rows) < len(before) and len({r.doc_id for r in rows}) == len(rows)
    squeezed = [hashlib.md5("".join(before[r.doc_id].split()).encode()).hexdigest() for r in rows]
    assert len(set(squeezed)) == len(squeezed)
    windows: dict = {}
    for r in rows:
        w = r.text.split()
        assert r.n_chars == len(r.text)
        for k in range(len(w) - 34):
            windows.setdefault(tuple(w[k : k + 35]), set()).add((r.doc_id, k))
    source = [r.text.split() for r in docs.collect()]
    assert source  # windows that joining the rest makes are the only ones that may repeat
    assert sum(len(x) > 1 for x in windows.values()) <= 0.01 * max(1, len(windows))
    assert corpus_pipeline.run(spark, SF).groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


SCHEMA = "doc_id bigint, text string, score double, predicted int, rank string, n_chars int, `a.b` string"


@pytest.fixture(scope="module")
def rows():
    return [(d, t, 0.25, 1, "clash", None if t is None else len(t), f"x{k}") for k, (d, t, *_) in enumerate(corpus(3, 40))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_of_an_empty_table(spark, docs, name):
    out = stage(name)(spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_toxicity_stage_keeps_rows_as_they_are(spark, docs, rows):
    got = Counter(map(tuple, stage("toxicity")(spark, docs, SF).collect()))
    assert not got - Counter(rows) and sum(got.values()) >= 0.9 * len(rows)


def test_toxicity_stage_drops_the_toxic(spark):
    """Of the labelled documents of the tables most toxic ones go and hardly a clean one does, and those that go are those that score 0.7 or more."""
    larger = SF.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to learn from
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    kept = {r.doc_id for r in stage("toxicity")(spark, docs, larger).collect()}
    scored = {r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text"), labels).collect()}
    assert kept == {d for d, s in scored.items() if s < 0.7}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in scored}
    toxic, clean = ([d for d, t in marks.items() if t == x] for x in (1, 0))
    assert sum(d not in kept for d in toxic) >= 0.7 * len(toxic) and sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_exact_stage(spark, docs, rows):
    got = stage("exact_dedup")(spark, docs, SF).collect()
    best = {}
    for r in rows:
        key = (-len(r[1] or ""), (1 << 63) if r[0] is None else r[0])
        best[norm(r[1])] = min(best.get(norm(r[1]), key), key)
    assert not Counter(map(tuple, got)) - Counter(rows)
    assert sorted((norm(r.text), -len(r.text or ""), (1 << 63) if r.doc_id is None else r.doc_id) for r in got) == sorted((t, *k) for t, k in best.items())


def test_near_stage(spark, docs, rows):
    got = stage("ngram_jaccard_join")(spark, docs, SF).collect()
    want, n = brute_components(rows, 80, 5)
    assert len(got) == n and not Counter(map(tuple, got)) - Counter(rows)
    named = Counter(c for c in {c for _, size, c in want if size and c is not None})
    assert {r.doc_id for r in got if (r.text or "").split() and r.doc_id is not None} == set(named)


def test_substring_stage(spark, docs, rows):
    got = Counter(map(tuple, stage("substring_dedup")(spark, docs, SF).collect()))
    words = [(t or "").encode().split() for _, t, *_ in rows]
    times = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for j in range(35)}
        text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r[1]
        want[r[:1] + (text,) + r[2:5] + (None if text is None else len(text),) + r[6:]] += 1
    assert got == want


def test_packing_stage(spark, docs, rows):
    got = stage("best_fit_packing")(spark, docs, SF).collect()
    tk = Tokenizer.from_file(BYTE)
    sizes = Counter((r[0], len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    by_doc = Counter()
    for r in got:
        by_doc[r.doc_id] += r.length
    want = Counter()
    for (d, n), times in sizes.items():
        want[d] += n * times
    assert by_doc == want


def test_equal_rows_leave_the_least(spark):
    made = spark.createDataFrame([(1, "a b c d e f g", 0.5, 1, "z", 3, k) for k in ("q", "p", "r")] + [(2, "a b c d e f g", 0.1, 1, "a", 3, "a")], SCHEMA)
    for name in ("exact_dedup", "ngram_jaccard_join"):
        (r,) = stage(name)(spark, made, SF).collect()
        assert (r.doc_id, r["a.b"]) == (1, "p")
