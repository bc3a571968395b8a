"""What a change of the store moves: no text of a chunk that is skipped, no row of a block, and keys in parts of bounded size."""

from pathlib import Path

from pyspark.sql import functions as F

from marlstone.operators import buckets, retrieval, segments, store
from tests.test_store import asked, chunk_rows, hits


def made_tables(root):
    """The names of the columns of all Parquet tables below a folder."""
    import pyarrow.parquet as pq

    return {n for p in Path(root).rglob("*.parquet") for n in pq.read_schema(p).names}


def test_keys_go_in_parts_and_texts_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "KEYS_AT_ONCE", 12)
    kept, path = str(tmp_path / "work"), str(tmp_path / "store")
    monkeypatch.setattr(store, "scratch_dir", lambda spark, name: kept)
    monkeypatch.setattr(store, "delete_path", lambda spark, path: None)
    rows = {f"d{d}:{k}": (f"d{d}", f"w{d} w{k} the") for d in range(20) for k in range(2)}
    assert store.apply(spark, path, chunk_rows(spark, rows), buckets=8)["added"] == 40
    assert store.apply(spark, path, chunk_rows(spark, rows), buckets=8)["skipped"] == 40
    assert "text" not in made_tables(kept)
    # Most chunks change, one comes, some go: more ids than are sent at once, a skipped text among them.
    new = {c: (d, f"{t} again") if c != "d0:0" else (d, t) for c, (d, t) in rows.items() if d < "d6"} | {"d3:9": ("d3", "w5")}
    gone = spark.createDataFrame([("d7:0",), ("d8:1",)], "chunk_id string")
    got = store.apply(spark, path, chunk_rows(spark, new), gone_chunks=gone, buckets=8)
    assert got == {"added": 1, "updated": len(new) - 2, "skipped": 1, "deleted": 2}
    rows = {c: x for c, x in (rows | new).items() if c not in ("d7:0", "d8:1")}
    assert {(r.chunk_id, r.document_id, r.text) for r in store.table(spark, path, "chunks").collect()} == {(c, *x) for c, x in rows.items()}
    assert hits(segments.search(asked(spark), f"{path}/bm25", 7)) == hits(retrieval.bm25(asked(spark), chunk_rows(spark, rows), 7))


def test_blocks_are_dealt_by_bucket(spark):
    chunks = spark.range(150).select("id", F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), F.col("id") % 40)).alias("text")).coalesce(1).withColumnRenamed("id", "chunk_id")
    packed = segments._packed(segments._term_lists(chunks), "bigint", 4)
    assert packed.count() == 4  # 41 terms in three windows are more than 80 blocks
    got = {(r.bucket, r.term, r.window & 0xFF, c, tf, dl) for r in segments._blocks(packed, "bigint").collect() for c, tf, dl in zip(*r.held, strict=True)}
    bucket = {r.term: r.b for r in chunks.select(F.explode(F.split("text", " ")).alias("term")).distinct().select("term", F.pmod(F.hash("term"), F.lit(4)).alias("b")).collect()}
    assert got == {(bucket[t], t, i // 64, i, 1, 2) for i in range(150) for t in ("the", f"w{i % 40}")}
