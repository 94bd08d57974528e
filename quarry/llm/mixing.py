"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral gives the
source's share; shares are limited to a number of passes over the source, the excess
going to the others by weight. A document copy that starts at a given amount of its
source's cumulative demand gets the time at which the schedule's integral reaches that
amount, and the mix is range-sorted by this time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Change of a source's weight over training, by the same repeating index: weight(t) =
#: weight * (1 + slope * (2 t - 1)). The integral over [0, 1] is the weight itself.
SLOPES = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"
#: Least number of documents in one block of the two-level running sum; blocks grow with
#: the square root of the largest source, so that neither level gets too long.
BLOCK_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"({WORD})")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) -> source, source_size, place, target.

    Sources in code point order, null last, get the weights in turn. Sources reach their
    limit in the order of limit / weight, so the level at which the others share the rest
    is found by running sums over one row per source.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    placed = sizes.withColumn("place", ((F.row_number().over(names) - 1) % n).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("place") + 1)
    limited = placed.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_passes)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = limited.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))),
    ).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    # Once a source is not full none after it is, and later levels only fall: the first
    # such level, the largest, holds for all.
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return levelled.select(
        "source",
        "source_size",
        "place",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"),
    )


def _time(share: Column, place: Column, slopes) -> Column:
    """Invert the integral of 1 + s (2 t - 1), which is (1 - s) t + s t^2, at ``share``."""
    s = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), place + 1)
    root = F.sqrt((1 - s) * (1 - s) + 4 * s * share)
    return F.when(F.abs(s) < 1e-9, share).otherwise(F.abs(root - (1 - s)) / F.abs(2 * s))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """Rows (doc_id, source, size, _ord, _tie) and ``more``: ``_ord`` orders a source's rows
    by the hash of their id, or of their text where the id is null."""
    ident, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    tie = F.xxhash64(text)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(ident, F.concat(F.lit("null "), tie.cast("string"))).cast("binary")).alias("_ord"),
        tie.alias("_tie"),
        *more,
    )


def _planned(rows: DataFrame, slim: DataFrame, weights, max_passes: int, block_rows: int) -> DataFrame:
    """``rows`` of ``_keyed`` with source_size, place, target, full, part, taken and ``at``,
    the words of the source before the row. ``slim`` are the same rows' (source, size, _ord).

    Running sums are made in two levels: within (source, block of the order) and over the
    sums of blocks, so no task holds a source. Rows are dealt once, by source and block.
    """
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(by_source.drop("_rows"), weights, max_passes)
    most = by_source.agg(F.max("_rows").alias("m")).first()["m"] or 0
    blocks = most / max(block_rows, math.sqrt(most))
    digits = min(8, math.ceil(math.log(blocks, 16))) if blocks > 1 else 0
    # null sources under a name of their own, so that keys compare by plain equality
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_src")
    block = (F.substring("_ord", 1, digits) if digits else F.lit("")).alias("_block")
    block_sums = slim.select("source", name, block, "size").groupBy("source", "_src", "_block").agg(F.sum("size").alias("_bsize"))
    before_block = Window.partitionBy("_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = block_sums.select(
        "source", "_src", "_block", F.coalesce(F.sum("_bsize").over(before_block), F.lit(0)).alias("_start")
    )
    facts = written(
        starts.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("_src", "_block", "_start", "source_size", "place", "target"),
        "mix-blocks",
    )
    within = (
        Window.partitionBy("_src", "_block")
        .orderBy("_ord", "size", "doc_id", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ordered = rows.select("*", name, block).withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    rest = F.floor(F.col("target") - F.col("full") * F.col("source_size"))
    return (
        ordered.join(facts, ["_src", "_block"])
        .withColumn("at", F.col("_start") + F.col("_in"))
        .withColumn("full", F.coalesce(passes, F.lit(0)).cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at"))).cast("long"))
        .withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
        .drop("_src", "_block", "_start", "_in", "_ord", "_tie")
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_passes: int = MAX_PASSES,
    slopes=SLOPES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, full, part, position.

    ``taken`` words are ``full`` whole copies and ``part`` words of one more. Documents of
    a source stand in the order of the MD5 of their id; whole passes are taken first and
    the rest from the start of that order, the last document in part, so a source's taken
    words miss its target by less than one. ``position`` is the time of the first copy,
    null if none is taken. The order depends on ids alone, so reruns agree.

    A null text has size 0 and is taken 0 times. A null source is a source of its own. Rows
    that repeat an id are documents of their own, ordered by size and then by their text's
    hash; rows with a null id stand in the order of the MD5 of their text's hash. An empty
    table gives an empty result; if all sizes are 0, targets are 0.
    """
    sized = written(_keyed(docs, id_col, text_col, source_col), "mix-sizes")
    share = F.least(F.col("at") / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0))
    return _planned(sized, sized, weights, max_passes, block_rows).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "full", "part", "at", "place",
        F.when(F.col("taken") > 0, _time(share, F.col("place"), slopes)).alias("position"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_passes: int = MAX_PASSES,
    slopes=SLOPES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The mix itself: the input's rows, one per copy taken, in training order. The copy
    that is taken in part holds the document's first ``part`` words with what stands
    between them. Columns are those of the input and ``position``, by which the rows are
    range-partitioned and sorted. A document's copies keep its text otherwise untouched.

    Every input row follows its own row of ``mix_plan``, with which it travels: rows that
    repeat an id, rows with a null id and rows with a null source too."""
    whole = F.struct(*docs.columns).alias("r")  # the input's names clash with none here
    slim = written(_keyed(docs, id_col, text_col, source_col).select("source", "size", "_ord"), "mix-sizes")
    planned = _planned(_keyed(docs, id_col, text_col, source_col, whole), slim, weights, max_passes, block_rows)
    text = F.col("r")[text_col]
    copies = F.sequence(F.lit(0), (F.col("full") + (F.col("part") > 0).cast("long") - 1).cast("int"))
    several = planned.where("taken > 0").withColumn("copy", F.explode(copies))
    share = F.least((F.col("copy") * F.col("source_size") + F.col("at")) / F.col("target"), F.lit(1.0))
    lead = F.regexp_extract(text, r"^([\x20\x09-\x0D]*)", 1)
    words = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), 1)
    cut = F.concat(lead, F.array_join(F.slice(words, 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), ""))
    in_part = (F.col("copy") == F.col("full")) & (F.col("part") < F.col("size"))
    kept = F.when(in_part, cut).otherwise(text)
    out = several.select(
        *[(kept if c == text_col else F.col("r")[c]).alias(c) for c in docs.columns if c != "position"],
        _time(share, F.col("place"), slopes).alias("position"),
    )
    return out.repartitionByRange("position").sortWithinPartitions("position", id_col)
