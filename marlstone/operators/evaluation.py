"""Retrieval metrics of ranked hits against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_match(document: Column, section: Column, page: Column, text: Column, want_document: Column, want_section: Column, want_page: Column, keywords: Column) -> Column:
    """All that is expected holds: the document, a part of the section's name and the page (if any), and every keyword."""
    empty = lambda c: c.isNull() | (c == "")
    return (
        (empty(want_document) | (document == want_document))
        & (empty(want_section) | F.contains(F.lower(section), F.lower(want_section)))
        & (want_page.isNull() | (want_page <= 0) | (page == want_page))
        & F.forall(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(F.lower(text), F.lower(k)))
    )


def per_query(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id with the first matching rank of ``judged(query_id, rank, matched)`` and its metrics; queries without hits count as 0."""
    first = judged.where("matched").groupBy("query_id").agg(F.min("rank").alias("first"))
    out = queries.select("query_id").join(first, "query_id", "left")
    within = lambda k: F.when(F.col("first") <= k, 1).otherwise(0)
    gain = lambda k: F.when(F.col("first") <= k, F.round(1 / F.log2(F.col("first") + 1), 6)).otherwise(0.0)
    metrics = {f"hit_{k}": within(k) for k in (1, 3, 5, 10)} | {"rr": F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)), "ndcg_5": gain(5), "ndcg_10": gain(10)}
    return out.select("query_id", "first", *[v.alias(k) for k, v in metrics.items()])


def summary(scored: DataFrame) -> DataFrame:
    """One row: the means over all queries."""
    mean = lambda c: F.round(F.avg(c), 6)
    return scored.agg(F.count(F.lit(1)).alias("total_queries"), *[mean(f"hit_{k}").alias(f"hit_{k}") for k in (1, 3, 5, 10)], mean("rr").alias("mrr"), mean("ndcg_5").alias("ndcg_5"), mean("ndcg_10").alias("ndcg_10"))


def report(means: DataFrame) -> DataFrame:
    """The summary row as a Markdown table."""
    text = F.format_string(
        "# Retrieval report\n\n| Metric | Score |\n| ------ | ----- |\n| Queries | %d |\n| Hit@1 | %.2f%% |\n| Hit@3 | %.2f%% |\n| Recall@5 | %.2f%% |\n| Recall@10 | %.2f%% |\n| MRR | %.4f |\n| NDCG@5 | %.4f |\n| NDCG@10 | %.4f |\n",
        "total_queries", *[F.col(f"hit_{k}") * 100 for k in (1, 3, 5, 10)], "mrr", "ndcg_5", "ndcg_10",
    )
    return means.select(text.alias("report"))


def write_report(means: DataFrame, path: str) -> None:
    """The report as a text file below ``path``."""
    report(means).coalesce(1).write.mode("overwrite").text(path)
