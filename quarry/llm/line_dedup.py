"""Repeated passages of three lines.

Every three consecutive lines of a document are hashed together; windows that occur
again anywhere are found by one hash aggregate; each occurrence but the first covers its
three lines, and the covered positions, merged, are removed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

WINDOW = 3


def _with(value: Column, use) -> Column:
    """Bind a value inside an expression, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _window_hashes(text: Column) -> Column:
    """``array<struct<pos, h1, h2>>`` of the windows that are not all blank. Two 64-bit
    hashes make false matches vanishingly rare at any corpus size."""

    def windows(ls: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(ls) - WINDOW, F.lit(0)))

        def one(i: Column) -> Column:
            a, b, c = (F.get(ls, i + k) for k in range(WINDOW))
            blank = F.length(F.trim(F.concat_ws("", a, b, c))) == 0
            return F.when(
                ~blank,
                F.struct(
                    i.alias("pos"),
                    F.xxhash64(a, b, c).alias("h1"),
                    F.xxhash64(F.lit(1), c, a, b).alias("h2"),
                ),
            )

        found = F.filter(F.transform(at, one), lambda w: w.isNotNull())
        return F.when(F.size(ls) >= WINDOW, found)

    return _with(_lines(text), windows)


def _kept(ls: Column, starts: Column) -> Column:
    """The lines outside ``[s, s + 3)`` for each start; starts are sorted. Linear."""
    before = F.concat(F.array(F.lit(-WINDOW)), starts)
    after = F.concat(starts, F.array(F.size(ls)))
    gaps = F.zip_with(before, after, lambda p, n: F.struct((p + WINDOW).alias("a"), (n - p - WINDOW).alias("n")))
    runs = F.filter(gaps, lambda g: g["n"] > 0)
    return F.flatten(F.transform(runs, lambda g: F.slice(ls, g["a"] + 1, g["n"])))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``text`` replaced by what is left, and ``n_lines``, ``n_removed``
    appended (replaced, if the input has such columns).

    Lines are what stands between line feeds; they are compared as they are. The first
    occurrence of a window is the one with the smallest (id, line number) and stays, as
    do windows of blank lines only and documents under three lines. Null texts stay null
    with n_lines 0; an empty text is one line. Rows that repeat an id with one text count
    as one document; with unlike texts they are documents of their own, in the order of
    their texts' hash. Rows with a null id come first and are never cut. An empty table
    gives an empty result.
    """
    digest = F.xxhash64(F.col(text_col).cast("string"))
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    if ids.where(F.col("_id").isNotNull() & (F.col("lo") != F.col("hi"))).isEmpty():
        digest = F.lit(0).cast("long")  # an id tells its text, and need not be joined with its hash
    base = docs.select(F.col(id_col).alias("_id"), digest.alias("_h"), _window_hashes(F.col(text_col)).alias("_w"))
    windows = base.where(F.col("_w").isNotNull()).select("_id", "_h", F.inline("_w"))
    repeated = written(
        windows.groupBy("h1", "h2")
        .agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_h", "pos")).alias("_first"))
        .where("_n > 1")
        .select(
            "h1", "h2", F.col("_first._id").alias("_fid"), F.col("_first._h").alias("_fh"), F.col("_first.pos").alias("_fpos")
        ),
        "line-windows",
    )
    later = (
        windows.where(F.col("_id").isNotNull())
        .join(repeated, ["h1", "h2"])
        .where(
            ~(F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_h") == F.col("_fh")) & (F.col("pos") == F.col("_fpos")))
        )
    )
    covered = written(
        later.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("pos")).alias("_starts")), "line-covered"
    )
    # the input's names clash with none here
    rows = docs.select(F.struct(*docs.columns).alias("r"), digest.alias("_own"))
    text = F.col("r")[text_col].cast("string")
    cut = _with(_lines(text), lambda ls: F.struct(F.size(ls).alias("n"), _kept(ls, F.col("_starts")).alias("k")))
    own = (F.col("r")[id_col] == F.col("_id")) & (F.col("_own") == F.col("_h"))
    joined = rows.join(covered, own, "left").withColumn(
        "_cut", F.when(F.col("_starts").isNotNull(), cut)
    )
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    )
    left = F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(F.col("_cut.k"), "\n"))
    return joined.select(
        *[
            (left if c == text_col else F.col("r")[c]).alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.col("_cut.n") - F.size("_cut.k"), F.lit(0)).cast("long").alias("n_removed"),
    )
