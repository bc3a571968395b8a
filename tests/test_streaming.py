from pathlib import Path

from marlstone.operators import store
from marlstone.plans import verbs
from marlstone.streaming.ingest import index_stream, ingest_stream
from tests.test_ingest import GOOD, make_pdf


def test_stream_is_added_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "chunk_id int, text string"
    for k, rows in enumerate([[(1, "a"), (2, "b")], [(2, "again"), (3, "c"), (None, "x")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        index_stream(stream, table, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_files_stream_into_the_store(spark, tmp_path):
    """Two runs with a restart between them give what a batch gives; a batch run again changes nothing; no file is opened twice."""
    root, path, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.pdf").write_bytes(GOOD)
    (root / "bad.pdf").write_bytes(b"no")
    ingest_stream(spark, str(root), path, state).awaitTermination()
    (root / "b.pdf").write_bytes(make_pdf([[(18, "Head"), (11, "alpha beta")]]))
    (root / "copy.pdf").write_bytes(GOOD)
    ingest_stream(spark, str(root), path, state, files_at_once=1).awaitTermination()
    opened = spark.read.parquet(f"{path}/ingested/opened")
    assert sorted(r.filename for r in opened.collect()) == ["a.pdf", "b.pdf", "bad.pdf", "copy.pdf"]
    assert [r.filename for r in spark.read.parquet(f"{path}/ingested/failures").collect()] == ["bad.pdf"]
    verbs.ingest_and_index(spark, str(root), str(tmp_path / "batch"))
    rows = lambda p, name: sorted(map(str, store.table(spark, p, name).drop("latency").collect()))
    for name in ("chunks", "vectors", "entities"):
        assert rows(path, name) == rows(str(tmp_path / "batch"), name)
    # The last batch again, as after a failure before its commit.
    before = rows(path, "chunks"), {str(p) for p in Path(path).rglob("chunks/rows/**/*.parquet")}
    for commit in sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1:]:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    ingest_stream(spark, str(root), path, state).awaitTermination()
    assert (rows(path, "chunks"), {str(p) for p in Path(path).rglob("chunks/rows/**/*.parquet")}) == before
