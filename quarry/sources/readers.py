"""Sources: corpora, queries, result lists. Everything is read by Spark, so any store
that Spark reaches will do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STEM = r"([^/]*)\.[^./]*$"

#: Stands for null where Spark would else take every empty field for it; in no text.
NO_TEXT = "\ue000null\ue001"


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, read by position: the first column is the text, the
    second the integer id; names do not matter. Subfolders and other files are left out."""
    raw = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(path)
    if len(raw.columns) < 2:
        raise ValueError(f"two columns (text, id) are needed, {path} has {raw.columns}")
    (text, kind), (ident, id_kind) = raw.dtypes[:2]
    if kind not in ("string", "binary"):
        raise ValueError(f"the first column must hold text, {text} is {kind}")
    if id_kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the second column must hold integer ids, {ident} is {id_kind}")
    return raw.select(
        F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )


def read_corpus_csv(spark: SparkSession, path: str, text_col: str, id_col: str) -> DataFrame:
    """CSV with a header, quoted line breaks allowed -> (text, id). A field without quotes and
    characters is null, ``""`` is an empty text."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue=NO_TEXT)
    missing = {text_col, id_col} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} has no column {sorted(missing)}")
    return raw.select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").try_cast("long").alias("id")
    )


def dense_ids(spark: SparkSession, path: str, text_col: str) -> DataFrame:
    """(text_col, Id): ids count from 0 without gaps over files sorted by name, in row
    order. Only one count per file passes through a single task."""
    raw = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    if text_col not in raw.columns:
        raise ValueError(f"{path} has no column {text_col!r}")
    rows = raw.select(
        F.col(f"`{text_col}`"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select(f"`{text_col}`", (F.col("_start") + F.col("_row")).alias("Id"))


def read_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per line of every ``*.txt``: (query_id, file, line, content). Blank lines
    are empty queries; a carriage return stays; the last line break ends the last line.
    Files are read whole (query files are small), so that lines keep their numbers."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), _STEM, 1).alias("file"), "value")
    body = F.regexp_replace("value", r"\n\z", "")
    lines = named.where(F.length("value") > 0).select("file", F.posexplode(F.split(body, "\n", -1)))
    return lines.select(
        F.concat_ws(":", "file", F.lpad((F.col("pos") + 1).cast("string"), 9, "0")).alias("query_id"),
        "file",
        (F.col("pos") + 1).alias("line"),
        F.col("col").alias("content"),
    )


def prompt_queries(ask=input) -> Iterator[tuple[str, str]]:
    """(id, text) from a prompt until ``!q`` or the end of input."""
    number = 0
    while True:
        try:
            line = ask("> ")
        except EOFError:
            return
        if line == "!q":
            return
        yield str(number), line
        number += 1


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A ranked result table ``query|rank|doc_id|score|``."""
    raw = spark.read.option("sep", "|").schema(
        "query string, rank int, doc_id long, score double, _end string"
    ).csv(path)
    return raw.drop("_end")


def read_known_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "|").schema("query string, document long").csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``doc_id,score`` lines -> (position, doc_id, score); ids stay strings, and
    positions count the lines from 1, over files in the order of their names. Files are read
    in blocks; only one count per block passes through a single task."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", r"\r\z", "").alias("_line"),
    )
    counted = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    parsed = F.from_csv("_line", F.lit("doc_id string, score double"))
    return lines.join(F.broadcast(starts), ["_file", "_block"]).select(
        (F.col("_start") + F.col("_id") - F.col("_first") + 1).cast("long").alias("position"), parsed.alias("_p")
    ).select("position", "_p.doc_id", "_p.score")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("doc_id"))


def read_search_dump(spark: SparkSession, path: str) -> DataFrame:
    """``hits.hits[]._source.column1`` of a saved search response, in order: (pos, column1).
    Triple-quoted strings are turned into JSON strings first."""
    raw = spark.read.text(path, wholetext=True)
    parts = F.split("value", '"""', -1)
    rebuilt = F.array_join(
        F.transform(
            parts,
            lambda x, i: F.when(i % 2 == 0, x).otherwise(
                F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
            ),
        ),
        "",
    )
    shape = "hits struct<hits: array<struct<_source: struct<column1: string>>>>"
    parsed = raw.select(F.from_json(rebuilt, shape).alias("j"))
    return parsed.select(F.posexplode("j.hits.hits").alias("pos", "hit")).select(
        "pos", F.col("hit._source.column1").alias("column1")
    )
