"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.line_dedup import line_dedup
from quarry.llm.mixing import mix
from quarry.llm.ngram_join import keep_one_of_each
from quarry.llm.packing import pack
from quarry.llm.shared import in_file_order, new_path, small_batches
from quarry.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    small_batches(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages are cut out; ``n_chars`` follows the text.
    A document of which nothing is left goes."""
    cut = line_dedup(docs).where("NOT (n_removed > 0 AND n_removed = n_lines)")
    if "n_chars" in docs.columns:
        cut = cut.selectExpr(
            "* EXCEPT (n_chars)", "CASE WHEN n_removed > 0 THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars"
        )
    return cut.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    small_batches(spark)
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out to the sources' targets, in training order."""
    return mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences. The mix left its part files in training
    order; blocks of documents are taken in that order, which the column ``block`` tells."""
    small_batches(spark)
    return pack(in_file_order(docs), order=("_file", "_row"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity scores, similarity components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
