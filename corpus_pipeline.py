"""Corpus preparation: toxic documents go, then exact copies, near copies and repeated passages, and the rest is packed.

``run`` applies the stages to the documents of a folder of tables; each stage's result is written as Parquet to the shared folder and
read again as the next one's documents. Every stage but the last returns the columns of its input, whatever their names. A null text is
an empty one, an empty table gives an empty table, and no stage looks at other columns than doc_id and text; what rows with a null
doc_id, repeated rows and ties do is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import columns_of, materialize, table
from marlstone.llm.exact_dedup import drop_copies
from marlstone.llm.ngram_join import keep_one
from marlstone.llm.packing import pack_documents
from marlstone.llm.substring_dedup import dedup_texts
from marlstone.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go.

    Each row is judged by its own text, so repeated rows stay or go together; rows with a null doc_id are judged as well. An empty text
    has the score of a text that says nothing. Without labelled rows of both classes nothing is rejected.
    """
    rows = docs.select("doc_id", "text", F.struct(*columns_of(docs)).alias("row"))
    return toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the longest original text, then the least doc_id (null last).

    Empty and null texts are one group. Of rows that repeat that doc_id and text one stays, the least by its columns in their order.
    """
    return drop_copies(docs).select(*columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at a Jaccard similarity of 0.8 over five-word shingles stays, that of the least doc_id.

    Null doc_ids come last; rows that repeat a document are one component, of which the least row by its columns stays. Texts without
    words are linked with nothing and stay.
    """
    return keep_one(docs, percent=80, size=5).select(*columns_of(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 35 words that repeat, in one text or in several, are cut out of all of them; n_chars follows the text.

    No row goes, and a text that loses nothing stays as it is; one that loses all is empty. Rows that repeat a document repeat its
    windows, whatever their doc_id.
    """
    out = dedup_texts(docs, size=35)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as best fit finds, one row each, without texts.

    An empty text is a piece of the end id alone; repeated rows and null doc_ids have pieces of their own.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]

#: Toxicity scores, and ids by a tokenizer, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
