import pytest
from pyspark.sql import functions as F

from marlstone.plans import verbs
from marlstone.sources import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    blocks = corpus.manual_blocks(spark, SF)
    titles = blocks.groupBy("document_id").agg(F.lit("Manual").alias("title"), F.max("page").alias("page_count"))
    verbs.index(blocks, titles, path)
    return path


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "Refer to STTM_BUILDING terms"), (2, "zzz qqq")], "query_id bigint, question string")


def test_search_and_stats(spark, built, asked):
    hits = verbs.search(spark, built, asked, 5, entities=True).where("query_id = 1").orderBy("rank").collect()
    assert len(hits) == 5 and "STTM_BUILDING" in hits[0].text and "STTM_BUILDING" in hits[0].entities
    (r,) = verbs.stats(spark, built).collect()
    assert r.total_documents == 5 and r.total_chunks > 100


def test_prompt_and_answer(spark, built, asked):
    got = {r.query_id: r for r in verbs.prompt(spark, built, asked, date=F.lit("2024-01-01")).collect()}
    assert got[1].prompt.startswith("<context>\n<context_block") and got[1].estimated_tokens > 20
    said = {r.query_id: r for r in verbs.ask(spark, built, asked).collect()}
    assert said[1].answer and said[1].label in ("High", "Medium", "Low") and said[1].sources


def test_benchmark(spark, built, asked):
    expected = asked.where("query_id = 1").select("*", F.lit(None).cast("string").alias("expected_document"), F.lit(None).cast("string").alias("expected_section"), F.lit(None).cast("int").alias("expected_page"), F.array(F.lit("sttm_building")).alias("expected_keywords"))
    got = verbs.benchmark(spark, built, expected).first()
    assert got.mrr == 1.0 and 0 <= got.embedding_latency <= got.retrieval_latency and got.failed_embeddings == 0
    with pytest.raises(ValueError):
        verbs.benchmark(spark, built, expected.limit(0))
