"""Pinned behaviour on small inline tables."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import answers, chunking, context, enrichment, evaluation, index, parsing, retrieval
from marlstone.sources import corpus

MANUAL = [
    (1, 0, "heading", 1, "Chapter 1: Product Definition"),
    (1, 1, "heading", 2, "1.1 Product Code"),
    (1, 2, "text", None, "The product code identifies the product.\n\nRefer to STTM_PRODUCT for details."),
    (2, 0, "heading", 2, "1.2 Rate Code"),
    (2, 1, "text", None, "See Chapter 8 for interest rates.\n\nRate codes are defined in the system."),
    (3, 0, "heading", 1, "Chapter 2: Configuration"),
    (3, 1, "heading", 2, "2.1 Setup"),
    (3, 2, "text", None, "Follow these steps."),
]
BLOCKS = "document_id string, page int, block_index int, type string, level int, text string"


@pytest.fixture
def manual(spark):
    return spark.createDataFrame([("d", *r) for r in MANUAL], BLOCKS)


def test_headings(manual):
    got = enrichment.headings(manual).orderBy("ord").collect()
    assert [r.number for r in got] == ["1", "1.1", "1.2", "2", "2.1"]
    assert [r.parent_ord for r in got] == [None, 1, 1, None, 4]


def test_skipped_levels_count_zero(spark):
    rows = [("d", 1, k, "heading", lv, f"h{k}") for k, lv in enumerate([2, 3, 1, 3, 2, 3, 3])]
    got = enrichment.headings(spark.createDataFrame(rows, BLOCKS)).orderBy("ord").collect()
    assert [r.number for r in got] == ["0.1", "0.1.1", "1", "1.0.1", "1.1", "1.1.1", "1.1.2"]


def test_numbers_and_parents_follow_the_loop(spark):
    rng = random.Random(5)
    for _ in range(3):
        levels = [rng.randint(1, 4) for _ in range(30)]
        counters, stack, want = [0] * 7, [], []
        for i, lv in enumerate(levels, 1):
            counters[lv] += 1
            counters[lv + 1 :] = [0] * (6 - lv)
            while stack and levels[stack[-1] - 1] >= lv:
                stack.pop()
            want.append((".".join(map(str, counters[1 : lv + 1])), stack[-1] if stack else None))
            stack.append(i)
        rows = [("d", 1, k, "heading", lv, "h") for k, lv in enumerate(levels)]
        got = enrichment.headings(spark.createDataFrame(rows, BLOCKS).repartition(3)).orderBy("ord").collect()
        assert [(r.number, r.parent_ord) for r in got] == want


def test_sections_paths_and_blocks(manual):
    titles = manual.groupBy("document_id").agg(F.lit("Doc").alias("title"), F.max("page").alias("page_count"))
    got = enrichment.sections(manual, titles).orderBy("section_ord").collect()
    assert [(r.page_start, r.page_end) for r in got] == [(1, 1), (1, 1), (2, 2), (3, 3), (3, 3)]
    assert got[1].parent_id == "d:sec:1"
    assert enrichment.section_children(enrichment.sections(manual, titles)).where("parent_id = 'd:sec:1'").first().child_ids == ["d:sec:2", "d:sec:3"]
    own = {r.block_id: r for r in enrichment.enriched_blocks(manual).collect()}
    assert own["d:p3:b1"].heading_path == ["Chapter 2: Configuration", "2.1 Setup"] and own["d:p3:b2"].depth == 0
    assert enrichment.enriched_blocks(manual, inherit=True).where("block_id = 'd:p3:b2'").first().depth == 2


def test_document_without_headings_is_one_section(spark):
    blocks = spark.createDataFrame([("d", 1, 0, "text", None, "a b"), ("d", 2, 0, "text", None, "c")], BLOCKS)
    titles = spark.createDataFrame([("d", "Doc", 2)], "document_id string, title string, page_count int")
    (r,) = enrichment.sections(blocks, titles).collect()
    assert (r.number, r.title, r.page_end, r.word_count) == ("1", "Doc", 2, 3)


def test_references(manual):
    got = {(r.target, r.type) for r in enrichment.references(manual).collect()}
    assert got == {("STTM_PRODUCT", "entity_ref"), ("Chapter 8", "cross_ref")}


def test_text_tables(spark):
    rows = [("d", 1, 0, "text", None, "Name    Age    City\nAlice   30     NYC\nBob     25     LA"), ("d", 1, 1, "text", None, "just one line"), ("d", 1, 2, "text", None, "")]
    (t,) = enrichment.text_tables(spark.createDataFrame(rows, BLOCKS)).collect()
    assert t.headers == ["Name", "Age", "City"] and t.num_rows == 2 and t.num_cols == 3


def test_entities_and_modules(spark, manual):
    assert {r.name for r in enrichment.pattern_entities(manual).collect()} == {"STTM_PRODUCT"}
    docs = spark.createDataFrame([("a", "Lending and loans"), ("b", "nothing")], "document_id string, text string")
    assert {r.document_id: r.module for r in enrichment.classify_modules(docs).collect()} == {"a": "Loans", "b": "Unknown"}


def loop_pack(words, most, overlap):
    out, s, w = [], 0, 0
    for i, x in enumerate(words):
        if int(w * 1.3) + int(x * 1.3) > most and w > 0:
            out.append((s, i - 1))
            j, kept = i, 0
            while j - 1 >= s and (kept + words[j - 1]) * 1.3 <= overlap:
                j -= 1
                kept += words[j]
            s, w = j, kept
        w += x
    return out + [(s, len(words) - 1)] * (w > 0)


def test_packing_follows_the_loop(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0, 1, 3, 9, 20, 40, 70]) for _ in range(rng.randint(1, 25))]) for k in range(150)]
    got = spark.createDataFrame(rows, "k int, words array<int>").select("k", chunking.pack_ranges(F.col("words"), 90, 25).alias("r")).collect()
    assert {r.k: [(x.s, x.e) for x in r.r] for r in got} == {k: loop_pack(w, 90, 25) for k, w in rows}


def test_chunks_of_a_section(spark):
    text = [" ".join(f"W{c}{k}" for k in range(400)) for c in "AB"]
    blocks = parsing.with_block_ids(spark.createDataFrame([("d", 1, k, "text", None, t) for k, t in enumerate(text)], BLOCKS)).withColumn("section_ord", F.lit(1))
    got = chunking.assemble(blocks, chunking.pack(blocks)).orderBy("chunk_ord").collect()
    assert len(got) == 2 and all(r.token_count <= 900 for r in got) and got[0].chunk_id == "d:chunk:1"


def test_bm25(spark):
    rows = [(1, "FLEX STTM_PRODUCT module"), (2, "Retail Lending and CASA integration"), (3, "Some unrelated text without keywords")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string")
    asked = spark.createDataFrame([(0, "STTM_PRODUCT")], "query_id bigint, question string")
    assert [r.chunk_id for r in retrieval.bm25(asked, chunks).collect()] == [1]


def test_fusion(spark):
    hit = lambda *rows: spark.createDataFrame(list(rows), "query_id int, rank int, chunk_id string, method string")
    lists = [hit((0, 1, "A", "vector"), (0, 2, "B", "vector")), hit((0, 1, "B", "bm25"), (0, 2, "C", "bm25"))]
    got = retrieval.rrf(lists, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["B", "A", "C"] and got[0].method == "vector+bm25"
    assert (got[0].score, got[2].score) == (1.0, 0.0) and abs(got[1].score - (1 / 61 - 1 / 62) * 61) < 1e-5


def test_knn_in_blocks_is_the_same(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)], "chunk_id bigint, embedding array<float>")
    q = v.limit(12).select(F.col("chunk_id").alias("query_id"), "embedding")
    one, many = (sorted(map(tuple, retrieval.knn(q, v, 3, n).select("query_id", "rank", "chunk_id").collect())) for n in (1 << 20, 700))
    assert one == many and len(one) == 36


def hits(spark, *rows):
    made = [(0, k, c, d, p, h, f"t{k}", s, e) for k, (c, d, p, h, s, e) in enumerate(rows, 1)]
    return spark.createDataFrame(made, "query_id int, rank int, chunk_id string, document string, page int, heading string, text string, score double, entities array<string>")


def test_context_merges(spark):
    two = hits(spark, ("a", "GL", 5, "7 A", 0.9, ["X"]), ("b", "GL", 6, "7 A", 0.8, ["Y"]))
    (r,) = context.merge_adjacent(two).collect()
    assert r.page == 5 and r.text == "t1\n\nt2" and r.entities == ["X", "Y"]
    deep = hits(spark, ("a", "GL", 5, "7 A", 0.5, []), ("b", "GL", 3, "7.1 B", 0.8, ["Y"]), ("c", "GL", 9, "7.2 C", 0.1, []), ("d", "GL", 9, "8 D", 0.1, []))
    got = context.merge_hierarchical(deep).orderBy("rank").collect()
    assert [(r.heading, r.page, r.score) for r in got] == [("7 A", 3, 0.8), ("8 D", 9, 0.1)]


def test_empty_context(spark):
    asked = spark.createDataFrame([(7, "why?")], "query_id int, question string")
    none = context.assemble(hits(spark, ("a", "GL", 5, "7 A", 0.9, ["X"])))
    assert context.context_xml(asked, none).first().context == "<context>\n</context>"
    assert answers.confidence(asked, none).first().label == "Low"


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    judged = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 1, False)], "query_id int, rank int, matched boolean")
    got = {r.query_id: r for r in evaluation.per_query(q, judged).collect()}
    assert got[1].rr == 0.5 and got[1].hit_1 == 0 and got[1].hit_3 == 1 and got[1].ndcg_5 == 0.63093 and got[2].rr == got[3].rr == 0


def test_index_is_idempotent(spark):
    held = spark.createDataFrame([(1, "d1", "x")], "chunk_id int, document_id string, text string")
    new = spark.createDataFrame([(1, "d1", "y"), (2, "d2", "z")], held.schema)
    once = index.insert_absent(held, new)
    assert sorted(map(tuple, index.insert_absent(once, new).collect())) == sorted(map(tuple, once.collect())) == [(1, "d1", "x"), (2, "d2", "z")]
    assert sorted(r.text for r in index.upsert(held, new).collect()) == ["y", "z"]


def test_embedding_cache_and_failures(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "chunk_id int, text string")
    key = chunks.where("chunk_id = 1").select(index.cache_key("m", F.col("text"))).first()[0]
    cache = spark.createDataFrame([(key, [1.0])], "key string, embedding array<float>")
    hit, miss = index.split_by_cache(chunks, cache, "m")
    assert hit.count() == 1 and miss.count() == 2
    assert index.embed_cached(chunks, cache, "m").count() == 3

    def broken(texts):
        raise RuntimeError

    # The rows of a batch that fails for good stay, with their error.
    failed = index.embed(chunks, broken, retries=2, backoff=0.0).collect()
    assert len(failed) == 3 and all(r.embedding is None and r.error.startswith("RuntimeError") for r in failed)
    lost = index.embed_cached(chunks, cache, "m", broken, retries=1)
    (m,) = index.embed_metrics(lost).collect()
    assert (m.cache_hits, m.cache_misses, m.embedded, m.failures) == (1, 2, 0, 2) and index.cache_additions(lost).count() == 0
    assert index.embedded_chunks(lost, "m").count() == 1


def test_cache_is_written_back(spark, tmp_path):
    path = str(tmp_path / "cache")
    chunks = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c")], "chunk_id int, text string")
    for hits in (0, 3):
        out = str(tmp_path / f"embedded{hits}")
        index.embed_cached(chunks, index.cache_table(spark, path), "m").write.parquet(out)
        got = spark.read.parquet(out)
        assert got.where("hit").count() == hits and got.where("embedding IS NOT NULL").count() == 3
        index.write_back(got, path)
    assert index.cache_table(spark, path).count() == 2
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.parquet").write_bytes(b"nothing of the kind")
    assert index.cache_table(spark, str(tmp_path / "odd")).count() == 0
    spark.range(2).write.parquet(str(tmp_path / "legacy"))
    assert index.cache_table(spark, str(tmp_path / "legacy")).count() == 0


def test_stored_bm25_gives_the_same_hits(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "Refer to STTM_PRODUCT module"), ("c2", "Lending and CASA integration casa"), ("c3", "Some unrelated text"), ("c4", None)], "chunk_id string, text string").na.fill("")
    asked = spark.createDataFrame([(1, "STTM_PRODUCT"), (2, "casa casa lending text"), (3, "zzz")], "query_id bigint, question string")
    retrieval.write_bm25(chunks, str(tmp_path / "bm25"), buckets=3)
    got = sorted(map(tuple, retrieval.bm25_stored(asked, str(tmp_path / "bm25")).select("query_id", "rank", "chunk_id", "score").collect()))
    assert got == sorted(map(tuple, retrieval.bm25(asked, chunks).select("query_id", "rank", "chunk_id", "score").collect()))
    assert [(q, c) for q, _, c, _ in got] == [(1, "c1"), (2, "c2"), (2, "c3")]
    assert retrieval.bm25_stored(asked, str(tmp_path / "nothing")).count() == 0


def test_answers_stream(spark):
    from collections.abc import Iterator

    class Client:
        def __init__(self):
            self.calls = []

        def stream(self, prompt: str, **options) -> Iterator[str]:
            self.calls.append(options)
            if len(self.calls) < 3:
                raise ConnectionError("refused")
            yield from ("a", "", " b")

    client = Client()
    engine = answers.Engine(client, delays=(0,), temperature=0.5)
    assert engine.generate("p") == "a b" and len(client.calls) == 3 and client.calls[0]["temperature"] == 0.5 and client.calls[0]["num_ctx"] == 8192
    stream = engine.stream("p")
    assert list(stream) == ["a", " b"] and (stream.count, stream.text) == (2, "a b")
    with pytest.raises(ValueError):
        answers.Engine(type("Silent", (), {"stream": lambda self, p, **o: iter(())})()).generate("p")
    made = spark.createDataFrame([(2, "<text>\nhello there\n"), (1, "")], "query_id bigint, prompt string")
    got = [(q, "".join(s)) for q, s in answers.stream_answers(made)]
    assert got == [(1, "The context does not say."), (2, "hello there")]


def test_report_file(spark, tmp_path):
    q = spark.createDataFrame([(1,)], "query_id int")
    evaluation.write_report(evaluation.summary(evaluation.per_query(q, spark.createDataFrame([(1, 1, True)], "query_id int, rank int, matched boolean"))), str(tmp_path / "report"))
    assert "| MRR | 1.0000 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())


def test_context_carries_ids(spark):
    rows = [(1, 1, "a", "GL", 5, "7 A", "t1", 0.9, ["X"], "", "", "s1"), (1, 2, "b", "GL", 6, "7 A", "t2", 0.8, [], "d9", "GL & CASA", ""), (1, 3, "c", "GL", 2, "7.1 B", "t3", 0.7, [], "d8", "", "s3")]
    made = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, document string, page int, heading string, text string, score double, entities array<string>, document_id string, module string, section_id string")
    (r,) = context.assemble(made).collect()
    assert (r.document_id, r.module, r.section_id, r.page) == ("d9", "GL & CASA", "s1", 2)
    assert all(x in r.block for x in ("<document_id>d9</document_id>", "<module>GL &amp; CASA</module>", "<section_id>s1</section_id>", "<page_end></page_end>"))


def test_generator_retries(spark):
    made = spark.createDataFrame([(1, "<text>\nhello\n"), (2, "")], "query_id bigint, prompt string")
    got = {r.query_id: r.answer for r in answers.generate(made).collect()}
    assert got == {1: "hello", 2: "The context does not say."}


def test_text_functions(spark):
    row = spark.createDataFrame([("D:20230101120000+05'30'", "D:20230101120000", "7.1.2 Deep", "été x_1 A")], "a string, b string, h string, t string")
    got = row.select(T.pdf_date("a").cast("string").alias("a"), T.pdf_date("b").alias("b"), T.section_number("h").alias("h"), T.tokens("t").alias("t"), T.char_tokens(F.lit("ab")).alias("n")).first()
    assert got.a == "2023-01-01 12:00:00" and got.b is None and got.h == [7, 1, 2] and got.t == ["été", "x_1", "a"] and got.n == 1


def test_file_scan_skips_hidden(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / ".h").mkdir()
    (tmp_path / ".h" / "b.pdf").write_bytes(b"y")
    got = corpus.scan_files(spark, str(tmp_path)).collect()
    assert [(r.filename, r.file_size_bytes, r.mime_type) for r in got] == [("a.pdf", 1, "application/pdf")]


def test_eval_dataset(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text('[{"question": "q", "expected_document": "d", "expected_keywords": ["k"]}]')
    (r,) = corpus.read_eval_queries(spark, str(p)).collect()
    assert r.expected_document == "d" and r.expected_section is None
