"""Digests of files that no task reads whole."""

import hashlib
from pathlib import Path

import numpy as np
import pytest

from marlstone.sources import corpus


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_digests_by_parts(spark, tmp_path, small_splits, monkeypatch):
    rng = np.random.default_rng(7)
    some = lambda n, most=256: rng.integers(0, most, n, dtype=np.uint8).tobytes()
    bom = b"\xef\xbb\xbf"
    files = {
        "random": some(9000), "feeds": some(5000, 12), "ends": some(4000) + b"\n", "only feeds": b"\n" * 3000, "no feed": b"x" * 5000,
        "bom": bom + some(3000), "bom ends": bom + some(3000) + b"\n\n", "two boms": bom + bom + some(3000), "begins": b"\n" + some(3000), "crlf": b"a\r\n\r" * 900,
        "small": b"s", "brackets [1] {a} é": some(3000), "just": some(1000), "one more": some(1001), "after feed": b"x" * 699 + b"\n" + b"y" * 900,
    }
    (tmp_path / "k=1").mkdir()
    for name, data in files.items():
        (tmp_path / "k=1" / f"{name}.bin").write_bytes(data)
    (tmp_path / "k=1" / ".hidden.bin").write_bytes(some(3000))
    (tmp_path / "other.txt").write_bytes(some(3000))
    rounds = []
    was = corpus._large_digests

    def watched(session, sizes, *rest):
        rounds.append({size for _, size in sizes.values()})
        return was(session, sizes, *rest)

    monkeypatch.setattr(corpus, "_large_digests", watched)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    got = corpus.scan_digests(spark, str(tmp_path), "*.bin", f"{shared}/digests", 1000)
    plain = corpus.scan_files(spark, str(tmp_path), "*.bin").drop("content")
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.filename: r.sha256 for r in got.collect()} == {f"{n}.bin": hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert rounds == [{len(d) for d in files.values() if len(d) > 1000}]
    assert not Path(shared, "digests").exists()


def test_parts_are_bounded(spark, tmp_path, small_splits, monkeypatch):
    """The most that a task takes up of a file: what splits that start within 1,000 bytes have, and the lines that go on behind them."""
    data = np.random.default_rng(8).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    (tmp_path / "a.bin").write_bytes(data)
    kept = str(tmp_path / "kept")
    monkeypatch.setattr(corpus, "_dropped", lambda session, path: Path(path).rename(kept))
    (row,) = corpus.scan_digests(spark, str(tmp_path), "*.bin", str(tmp_path / "parts"), 1000).collect()
    assert row.sha256 == hashlib.sha256(data).hexdigest()
    parts = spark.read.parquet(kept).groupBy("part").sum("n").collect()
    assert len(parts) == 9 and max(r[1] for r in parts) < 3500


def test_packed_files_are_read_whole(spark, tmp_path):
    import gzip

    data = gzip.compress(b"a\nb\n" * 2000)
    (tmp_path / "a.gz").write_bytes(data)
    (tmp_path / "b.gz").write_bytes(b"no gzip\n" * 300)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    got = corpus.scan_digests(spark, str(tmp_path), "*.gz", f"{shared}/packed", 10).collect()
    assert {r.sha256 for r in got} == {hashlib.sha256(data).hexdigest(), hashlib.sha256(b"no gzip\n" * 300).hexdigest()}
