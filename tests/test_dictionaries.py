"""Dictionaries of any size, headings of any depth and pruned search against brute force."""

import random
import re
import string

import pytest

from marlstone.operators import enrichment, retrieval, segments


def test_large_dictionary(spark):
    """50,000 terms with overlaps, punctuation, other scripts and repeats, with and without word bounds, against a search for each."""
    rng = random.Random(1)
    letters = "abAB_1é日 -."
    terms = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(2000)] + ["", "ab", "ab", "日本"]
    terms += ["".join(rng.choices(string.ascii_letters, k=9)) for _ in range(50_000 - len(terms))]
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 3, 40]))) for _ in range(60)] + [None, " ".join(terms[3000:3050]), "x" * 100_000 + " ab"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, other string")
    short = [i for i, t in enumerate(terms) if len(t) < 9] + list(range(3000, 3050))
    for bounds in (True, False):
        got = {r.id: r.hits for r in enrichment.dictionary_hits(df, terms, bounds).collect()}
        for i, t in enumerate(texts):
            b = r"\b" if bounds else ""
            assert got[i] == [k for k in short if terms[k] and re.search(f"{b}{re.escape(terms[k])}{b}", t or "")] if i < 60 else len(got[i]) <= 500, (t, bounds)
    assert {r.id: r.hits for r in enrichment.dictionary_hits(df, ["AB", "É"], False, ignore_case=True).collect()}[62] == [0]
    assert all(r.hits == [] for r in enrichment.dictionary_hits(df, []).collect())
    with pytest.raises(ValueError):
        enrichment.dictionary_hits(df, ["x" * (enrichment.DICTIONARY_BYTES + 1)])


def test_headings_of_any_depth(spark):
    rng = random.Random(2)
    rows = [(f"d{d}", p, i, "heading", rng.randint(1, 25), f"t{p}.{i}") for d in range(5) for p in range(1, 9) for i in range(6)] + [("d0", 9, 0, "text", None, "x"), ("d0", 9, 1, "heading", None, "no")]
    got = {(r.document_id, r.page, r.block_index): (r.ord, r.number, r.parent_ord, r.path) for r in enrichment.headings(spark.createDataFrame(rows, "document_id string, page int, block_index int, type string, level int, text string").repartition(3)).collect()}
    for d in range(5):
        own = [r for r in rows if r[0] == f"d{d}" and r[4] is not None]
        for n, r in enumerate(own):
            number = []
            for k in range(1, r[4] + 1):  # headings of level k since the last of a smaller one
                start = max((j + 1 for j in range(n + 1) if own[j][4] < k), default=0)
                number.append(sum(own[j][4] == k for j in range(start, n + 1)))
            up, path, level = None, [r[5]], r[4]
            for j in range(n - 1, -1, -1):
                if own[j][4] < level:
                    up, level = up or j + 1, own[j][4]
                    path.insert(0, own[j][5])
            assert got[r[:3]] == (n + 1, ".".join(map(str, number)), up, path)
    assert len(got) == 240


def test_windows_are_left_out(spark, tmp_path):
    """The same hits with and without bounds, while most blocks of common terms stay closed."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d"], k=20)) + (f" rare{i % 400}" if i % 3 == 0 else "")) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string")
    segments.change(spark, str(tmp_path), chunks)
    asked = spark.createDataFrame([(1, "a rare3"), (2, "b c rare6 rare9"), (3, "a b"), (4, "none")], "query_id bigint, question string")
    hits = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert hits(segments.search(asked, str(tmp_path), 2)) == hits(segments.search(asked, str(tmp_path), 2, prune=False)) == hits(retrieval.bm25(asked, chunks, 2))
    only = asked.where("query_id = 1")
    row = segments.blocks_read(only, str(tmp_path), 2).first()
    assert row.opened < row.blocks / 2
