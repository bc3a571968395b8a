"""What is asked once is answered in one pass, and indexes are built with as few rows moved as they can be."""

from pyspark.sql import functions as F

from marlstone.operators import retrieval, segments
from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"


def hits(rows):
    return sorted(map(tuple, rows.collect()))


def test_hybrid_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_INDEXES", {})
    assert catalog.rrf_fuse(spark, SF).count()
    assert catalog._INDEXES == {}


def test_terms_and_totals_in_one_pass(spark):
    chunks = spark.createDataFrame([(1, "one two two"), (2, ""), (3, "two three"), (4, "!")], "chunk_id bigint, text string")
    got = retrieval.counted_terms(chunks)
    assert hits(got.where("term IS NOT NULL").select("term", "df")) == hits(retrieval.document_frequencies(chunks)) == [("one", 1), ("three", 1), ("two", 2)]
    assert hits(got.where("term IS NULL").select("df", "avgdl")) == hits(retrieval.totals(chunks)) == [(4, 1.25)]


def test_names_are_found_without_pages(spark):
    own = catalog.naming_chunks(spark, SF)
    assert hits(own) == hits(catalog.located_entities(spark, SF).select("entity_name", "chunk_id"))
    assert "Window" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_made_where_their_chunks_lie(spark, tmp_path):
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), F.concat(F.lit("often "), F.col("id") % 7, F.lit(" often once"), "id").alias("text"))
    segments.change(spark, str(tmp_path), chunks, buckets=4)
    blocks = segments._blocks(segments._forward(spark, str(tmp_path), [0], "bigint").coalesce(1), "bigint")
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Repartition" in plan
    own = blocks.where("term = 'often'").select(F.size("held.chunk_id").alias("n")).collect()
    assert len(own) == 8 and sum(r["n"] for r in own) == 500 and max(r["n"] for r in own) <= segments.WINDOW
    own = spark.read.parquet(f"{tmp_path}/postings").where("term = 'often'").collect()
    assert sum(len(r["held"]["tf"]) for r in own) == 500
    assert all(r["tf"] == max(r["held"]["tf"]) == 2 and r["dl"] == min(r["held"]["dl"]) for r in own)
    asked = spark.createDataFrame([(1, "often once77 3"), (2, "5")], "query_id bigint, question string")
    assert hits(segments.search(asked, str(tmp_path), 9)) == hits(retrieval.bm25(asked, chunks, 9))


def test_merged_index_is_not_copied_from_another(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_INDEXES", {})
    assert hits(catalog.bm25_merged_topk(spark, SF)) == hits(catalog.bm25_changed_topk(spark, SF))
    assert [name for *_, name in catalog._INDEXES] == ["merged", "segments"]
