"""Comparing rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_at_k(left: DataFrame, right: DataFrame, k: int = 100) -> DataFrame:
    """Per query: documents that both rankings (query_id, rank, doc_id) have in their top k."""
    cut = lambda d: d.where(F.col("rank") <= k).select("query_id", "doc_id")
    both = cut(left).intersect(cut(right))
    return both.groupBy("query_id").agg(F.count("*").alias("overlap"))


def score_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (matches, sum_abs_diff) over (doc_id, score) lists; ids compare as strings.
    Repeated ids pair one to one in the order of the list: of ``position``, or else of
    ``rank``; by score only where a list has neither."""

    def numbered(d: DataFrame, name: str) -> DataFrame:
        key = F.col("doc_id").cast("string")
        order = next((c for c in ("position", "rank") if c in d.columns), "score")
        nth = F.row_number().over(Window.partitionBy("_key").orderBy("_at", "score"))
        return d.select(key.alias("_key"), F.col(order).alias("_at"), F.col("score").cast("double").alias("score")).select(
            "_key", nth.alias("_nth"), F.col("score").alias(name)
        )

    pairs = numbered(left, "_a").join(numbered(right, "_b"), ["_key", "_nth"])
    return pairs.agg(
        F.count("*").alias("matches"),
        F.coalesce(F.sum(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("sum_abs_diff"),
    )


def known_item_rank(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(query, rank, document) for ``expected(query, document)`` against
    ``results(query, rank, doc_id)``; rank -1 if the document was not returned. A line
    that occurs twice in ``expected`` gives two rows."""
    first = results.groupBy("query", F.col("doc_id").alias("document")).agg(F.min("rank").alias("rank"))
    return expected.join(first, ["query", "document"], "left").select(
        "query", F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"), "document"
    )
