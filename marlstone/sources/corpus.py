"""Adapters that bring inputs into the shape of the pipeline: documents, blocks and table-of-contents rows.

Blocks are rows ``document_id, page, block_index, type, level, text``; block_index counts from 0 within a page, paragraphs are parted by a
blank line, level is known for headings only.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import is_hidden, mime_type

BLOCKS_ON_PAGE = 4


def scan_files(spark: SparkSession, root: str | list[str], glob: str = "*.pdf") -> DataFrame:
    """Files below a folder but hidden ones: path, filename, sha256, file_size_bytes, last_modified, mime_type, content.

    Only the columns that are asked for are read; a missing folder raises when the plan is built. Spark's scan gives no row for a file
    of no bytes.
    """
    return file_columns(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root))


def file_columns(found: DataFrame) -> DataFrame:
    """The columns of ``scan_files`` out of a scan of binary files, which may be a stream."""
    local = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~is_hidden(local)).select("path", name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("last_modified"), mime_type("path").alias("mime_type"), "content")


#: Files over so many bytes are hashed part by part; a part holds the splits that start within so many bytes.
PART_BYTES = 128 << 20
#: Bytes of a row of a part: Parquet's writer looks at its memory every hundred rows.
_ROW_BYTES = 64 << 10
#: Names of files that Spark's text reader would unpack.
_PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".passthrough")


class PartialSha256:
    """SHA-256 whose state can be taken from one task to the next: libcrypto's SHA256_CTX, a plain C struct."""

    SIZE = 112

    def __init__(self, state: bytes | None = None):
        self._lib, self._ctx = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3"), ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self._lib.SHA256_Init(self._ctx)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._ctx, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self._ctx.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, ctypes.create_string_buffer(self.state, self.SIZE))
        return out.raw.hex()


def _has_partial_sha256() -> bool:
    try:
        PartialSha256().hexdigest()
    except (OSError, AttributeError):
        return False
    return True


def _escaped(path: str) -> str:
    """A path that Spark reads as it is, and not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _dropped(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits in their order -> bytes of a split, by batches: each line with a line feed in front."""
    nth = 0
    for b in batches:
        if not b.num_rows:
            continue
        start, at = b["start"].to_numpy(), b["at"].dictionary_encode()
        ends = [*(np.flatnonzero((np.diff(start) != 0) | (np.diff(at.indices.to_numpy()) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip([0, *ends], ends, strict=False):
            data = b"\n" + b"\n".join(b["value"].slice(i, j - i).to_pylist())
            pieces = [data[k : k + _ROW_BYTES] for k in range(0, len(data), _ROW_BYTES)]
            numbers = np.arange(nth, nth + len(pieces))
            yield pa.RecordBatch.from_pydict({"at": [at[i].as_py()] * len(pieces), "start": np.full(len(pieces), start[i]), "nth": numbers, "n": list(map(len, pieces)), "bytes": pa.array(pieces, pa.binary())})
            nth += len(pieces)


def _large_digests(spark: SparkSession, sizes: dict[str, tuple[str, int]], scratch: str, part_bytes: int) -> dict[str, str]:
    """SHA-256 by path of large files, given as Spark's metadata have them: (path, size) by file_path; without those that can't be put together again.

    The text reader splits files at line feeds, so that tasks read them by ranges of bytes, which are written as parts. A digest is a chain
    over a file's bytes: each round takes it over the next part of every file, and only its state, 112 bytes, goes on.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text([_escaped(path) for path, _ in sizes.values()])
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"))
    staged = lines.mapInArrow(_joined_lines, "at string, start bigint, nth bigint, n bigint, bytes binary").withColumn("part", F.floor(F.col("start") / part_bytes).cast("int"))
    staged.write.partitionBy("part").options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}).parquet(scratch)
    staged = spark.read.schema(staged.schema).parquet(scratch)
    # The reader says neither whether the last line had a line feed nor whether it has left out a byte order mark; the size does.
    last = {r["at"]: (sizes[r["at"]][1] - r["n"], r["part"]) for r in staged.groupBy("at").agg(F.sum("n").alias("n"), F.max("part").alias("part")).collect()}
    last = {at: x for at, x in last.items() if x[0] in (-1, 0, 2, 3)}
    marked = {at for at, (more, _) in last.items() if more >= 2}
    states: dict[str, bytes] = {}
    for part in range(max((p for _, p in last.values()), default=-1) + 1):

        def go_on(batches, states=states):
            sums: dict[str, PartialSha256] = {}
            for b in batches:
                for at, data in zip(b["at"].to_pylist(), b["bytes"], strict=True):
                    data = data.as_py()
                    if at not in sums:
                        sums[at] = PartialSha256(states.get(at))
                        if at not in states:
                            data = (b"\xef\xbb\xbf" if at in marked else b"") + data[1:]
                    sums[at].update(data)
            yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.string()), "state": pa.array([x.state for x in sums.values()], pa.binary())})

        own = staged.where((F.col("part") == part) & F.col("at").isin(list(last))).select("at", "start", "nth", "bytes")
        own = own.repartition(F.col("at")).sortWithinPartitions("at", "start", "nth")
        states = states | {r["at"]: r["state"] for r in own.mapInArrow(go_on, "at string, state binary").collect()}
    _dropped(spark, scratch)
    out = {}
    for at, (more, _) in last.items():
        whole = PartialSha256(bytes(states[at]))
        whole.update(b"\n" if more in (0, 3) else b"")
        out[sizes[at][0]] = whole.hexdigest()
    return out


def scan_digests(spark: SparkSession, root: str | list[str], glob: str, scratch: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``scan_files`` without content, for files of any size: no task reads or holds more than about ``part_bytes`` of a file.

    Parts of larger files are written to ``scratch``, a folder that isn't there yet, and go when they have been read. Packed files (by their names), and all files where
    there is no libcrypto, are read whole by one task each.
    """
    read = lambda paths: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    found = read(root)
    large = {r["at"]: (r["path"], r["length"]) for r in found.where(F.col("length") > part_bytes).select("path", "length", F.col("_metadata.file_path").alias("at")).collect()}
    parted = {at: x for at, x in large.items() if not x[0].lower().endswith(_PACKED)} if large and _has_partial_sha256() else {}
    got = _large_digests(spark, parted, scratch, part_bytes) if parted else {}
    if not got:
        return file_columns(found).drop("content")
    listed = file_columns(found).drop("content", "sha256").join(spark.createDataFrame(list(got.items()), "path string, sha256 string"), "path")
    # A condition on the length alone keeps the scan from reading what the others hold.
    small = file_columns(found.where(F.col("length") <= part_bytes)).drop("content")
    out = small.unionByName(listed)
    left = [_escaped(path) for path, _ in large.values() if path not in got]
    return out.unionByName(file_columns(read(left)).drop("content")) if left else out


def line_blocks(documents: DataFrame) -> DataFrame:
    """Plain text as blocks: a line is a block, BLOCKS_ON_PAGE of them a page."""
    lines = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("i")) - 1
    own = lines.select("document_id", "text", nth.alias("k"))
    return own.select("document_id", (F.floor(F.col("k") / BLOCKS_ON_PAGE) + 1).cast("int").alias("page"), (F.col("k") % BLOCKS_ON_PAGE).cast("int").alias("block_index"), F.lit("text").alias("type"), F.lit(None).cast("int").alias("level"), "text")


#: A manual with nested headings, references, entities, steps and text tables, out of the star schema: a document for each region,
#: headings for region, nation and segment, a block for each customer. Both SQL dialects run it.
MANUAL_SQL = """
SELECT document_id, CAST(floor((ord - 1) / 4) + 1 AS INT) AS page, CAST((ord - 1) % 4 AS INT) AS block_index, type, level, text, CAST(ord AS INT) AS ord
FROM (
  SELECT document_id, type, level, text, row_number() OVER (PARTITION BY document_id ORDER BY nk, seg, ck) AS ord
  FROM (
    SELECT concat('R', r_regionkey) AS document_id, -1 AS nk, '' AS seg, -1 AS ck, 'heading' AS type, CAST(1 AS INT) AS level, concat('Manual of ', r_name) AS text FROM {region}
    UNION ALL
    SELECT concat('R', n_regionkey), n_nationkey, '', -1, 'heading', CAST(2 AS INT), concat('Accounts of ', n_name) FROM {nation}
    UNION ALL
    SELECT DISTINCT concat('R', n_regionkey), n_nationkey, c_mktsegment, -1, 'heading', CAST(3 AS INT), concat('Segment ', c_mktsegment) FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey
    UNION ALL
    SELECT concat('R', n_regionkey), n_nationkey, c_mktsegment, c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'list' ELSE 'text' END, CAST(NULL AS INT),
      CASE c_custkey % 5
        WHEN 0 THEN concat('Refer to STTM_', c_mktsegment, '. See Chapter ', n_nationkey, '.', c_custkey % 7, ' and Lending terms of ', c_name, '.')
        WHEN 1 THEN concat('As described in Section 2.', c_custkey % 9, ' the Treasury desk keeps CASA for ', c_name, '.', chr(10), chr(10), 'See Appendix A and Table ', c_custkey % 4, '.1 with Figure 3.')
        WHEN 2 THEN concat('Name    Amount    Kind', chr(10), c_name, '   ', c_custkey, '   A', chr(10), 'TOTAL   ', c_custkey % 100, '   B')
        WHEN 3 THEN concat('EOD runs before BOD & "close" < open > for ', c_mktsegment, ' of ', c_name, '. For more information on GL see Section ', c_custkey % 3, '.2')
        ELSE concat('Step ', c_custkey % 6, ' post the GL entry', chr(10), chr(10), 'Step ', c_custkey % 6 + 1, ' check LIMIT_', c_custkey % 11, ' again')
      END
    FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey
  ) parts
) numbered
"""


def manual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer")}
    return spark.sql(MANUAL_SQL, **named)


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of questions with their expectations; YAML is parsed on the driver if a parser is installed."""
    schema = "question string, expected_document string, expected_section string, expected_page int, expected_screen string, expected_keywords array<string>"
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    import yaml

    rows = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(rows, list):
        raise ValueError("the questions must be a list")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def manifest(files: DataFrame) -> DataFrame:
    """One row: totals over ``files(document_id, page_count, word_count, file_size_bytes)``."""
    return files.agg(F.count(F.lit(1)).alias("total_documents"), F.sum("page_count").alias("total_pages"), F.sum("word_count").alias("total_words"), F.sum("file_size_bytes").alias("total_bytes"))
