"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_number(score: Column) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", score.cast("double"))
    return F.when(
        text.contains(".") & ~text.contains("e"), F.regexp_replace(text, r"\.?0+$", "")
    ).otherwise(text)


def result_lines(results: DataFrame) -> DataFrame:
    return results.select(
        F.concat(
            F.coalesce("query", F.lit("")), F.lit("|"), F.col("rank").cast("string"), F.lit("|"),
            F.col("doc_id").cast("string"), F.lit("|"), short_number(F.col("score")), F.lit("|"),
        ).alias("value")
    )


def write_results(results: DataFrame, folder: str, scoring: str) -> str:
    """``<folder>/<scoring>_result.tbl`` with one line ``query|rank|doc_id|score|`` per hit."""
    path = f"{folder}/{scoring}_result.tbl"
    order = [c for c in ("query_id", "rank") if c in results.columns]
    result_lines(results.orderBy(*order)).write.mode("overwrite").text(path)
    return path


def write_corpus(docs: DataFrame, path: str) -> None:
    """(text, id) as uncompressed Parquet."""
    docs.write.mode("overwrite").option("compression", "none").parquet(path)


def write_dense_ids(rows: DataFrame, path: str) -> None:
    """(text, Id) of ``dense_ids`` as Parquet, in the order of the ids."""
    rows.repartitionByRange("Id").sortWithinPartitions("Id").write.mode("overwrite").parquet(path)


def write_ranks(ranks: DataFrame, folder: str) -> str:
    path = f"{folder}/query_ranks.csv"
    ranks.select("query", "rank", "document").write.mode("overwrite").option("header", True).csv(path)
    return path
