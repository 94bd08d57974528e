"""Ranking queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.index import Index
from quarry.operators.search import search_batch
from quarry.sources.writers import result_lines


def rank_stream(
    index: Index, queries: DataFrame, out: str, checkpoint: str, scoring="bm25", k: int = 10
) -> StreamingQuery:
    """Rank each micro-batch of a streaming ``queries(query_id, content)`` and write its
    result lines to ``<out>/batch=<id>``; a batch that runs again overwrites its folder."""

    def rank(batch: DataFrame, number: int) -> None:
        ranked = search_batch(index, batch, scoring, k).orderBy("query_id", "rank")
        result_lines(ranked).write.mode("overwrite").text(f"{out}/batch={number}")

    return (
        queries.writeStream.foreachBatch(rank)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
