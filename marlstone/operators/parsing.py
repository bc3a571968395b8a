"""From font spans to blocks, pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import paragraphs, word_count

HEADING_RATIO, DEFAULT_FONT = 1.2, 12.0
_CLOSING = (".", ",", ":", ";", ")", "]", "}")


def median_fonts(spans: DataFrame) -> DataFrame:
    """document_id, page, median: of the font sizes of a page's spans."""
    return spans.groupBy("document_id", "page").agg(F.coalesce(F.median("size"), F.lit(DEFAULT_FONT)).alias("median"))


def heading_level(font: Column, median: Column) -> Column:
    ratio = F.when(median > 0, font / median).otherwise(F.lit(1.0))
    out = F.when(ratio >= 2.5, 1)
    for least, level in (2.0, 2), (1.6, 3), (1.3, 4), (1.1, 5):
        out = out.when(ratio >= least, level)
    return out.otherwise(6)


def span_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of ``spans(document_id, page, block, span, size, text)``: joined text, type and level.

    A span is set off by a blank unless it starts with closing punctuation. A block is a heading if its largest, or its first known,
    font is HEADING_RATIO times the page's median or more.
    """
    part = F.when(F.col("text").substr(1, 1).isin(*_CLOSING), F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))
    own = spans.where("text <> ''")
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span", part.alias("t")))), lambda x: x["t"]), ""))
    got = own.groupBy("document_id", "page", "block").agg(text.alias("text"), F.max("size").alias("largest"), F.expr("min_by(size, span) FILTER (WHERE size <> 0)").alias("first"))
    got = got.join(median_fonts(spans), ["document_id", "page"])
    least = F.col("median") * HEADING_RATIO
    heading = (F.col("largest") >= least) | (F.col("first") >= least)
    return got.select("document_id", "page", "block", "text", F.when(heading, "heading").otherwise("text").alias("type"), F.when(heading, heading_level(F.col("largest"), F.col("median"))).cast("int").alias("level"))


def kept_blocks(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """document_id, page, block_index, type, level, text of ``span_blocks`` and of image blocks (document_id, page, block), which have no text."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    each = texts.select("document_id", "page", "block", "type", "level", "text").unionByName(figures.select("document_id", "page", "block", F.lit("figure").alias("type"), none("int", "level"), F.lit("").alias("text")))
    nth = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("block")) - 1
    return each.select("document_id", "page", nth.alias("block_index"), "type", "level", "text")


def split_paragraphs(blocks: DataFrame) -> DataFrame:
    """One row per non-empty paragraph, numbered from 0 within its block; blocks without any vanish."""
    return blocks.select("document_id", "page", "block_index", F.posexplode(paragraphs("text")).alias("paragraph", "text"))


def page_counts(blocks: DataFrame) -> DataFrame:
    """page_id, document_id, page, word_count, character_count; a page's text is its paragraphs joined by blanks."""
    each = split_paragraphs(blocks)
    got = each.groupBy("document_id", "page").agg(F.sum(word_count("text")).alias("word_count"), (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("character_count"))
    return got.select(F.concat("document_id", F.lit(":p"), "page").alias("page_id"), "document_id", "page", "word_count", "character_count")


def with_block_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", F.concat("document_id", F.lit(":p"), "page", F.lit(":b"), "block_index"))


def document_order(*more: str) -> Window:
    return Window.partitionBy("document_id").orderBy("page", "block_index", *more)
