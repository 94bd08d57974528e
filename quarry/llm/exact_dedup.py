"""Exact duplicates by progressive refinement.

Rows are grouped by length; rows of a length that occurs again are grouped by a hash of
a prefix; only rows that still have company are read in full and grouped by SHA-256.
Every grouping is a hash aggregate with a partial step, so a group of copies of any size
shuffles one row per task, and the joins have plain exchanges on both sides, which
adaptive execution splits where a key is hot. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

PREFIX_CHARS = 256


def normal_text(text: Column) -> Column:
    """Null counts as empty; nothing else changes."""
    return F.coalesce(text.cast("string"), F.lit(""))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """(id, keep_id, group_size, kept), one row per input row.

    Of equal texts the row with the largest id stays. Null texts equal empty ones. Rows
    that repeat an id and a text count in ``group_size`` each, and all of those that bear
    the largest id are kept. A null id sorts below all others; a group with null ids
    only has ``keep_id`` null and keeps its rows. An empty table gives an empty result.
    Other columns, whatever their names, are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), normal_text(F.col(text_col)).alias("_t"))
    coarse = base.select(
        "_id",
        F.octet_length("_t").cast("long").alias("_len"),
        F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_pre"),
    )
    lengths = written(
        coarse.groupBy("_len", "_pre").agg(F.count("*").alias("_c")), "dedup-prefix"
    )  # one row per (length, prefix); the length level is its roll-up
    again = lengths.groupBy("_len").agg(F.sum("_c").alias("_n")).where("_n > 1").select("_len")
    shared = written(
        lengths.where("_c > 1").join(again, "_len", "left_semi").select("_len", "_pre"), "dedup-survivors"
    )
    full = base.select(
        "_id",
        F.octet_length("_t").cast("long").alias("_len"),
        F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_pre"),
        F.unhex(F.sha2("_t", 256)).alias("_full"),
    )
    survivors = full.join(shared, ["_len", "_pre"], "left_semi").select("_id", "_len", "_full")
    groups = written(
        survivors.groupBy("_len", "_full")
        .agg(F.count("*").alias("_size"), F.max("_id").alias("_keep"))
        .where("_size > 1"),
        "dedup-groups",
    )
    return full.join(groups, ["_len", "_full"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
    )
