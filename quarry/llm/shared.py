"""What several corpus operators need: a place that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Only a
    local session without that setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = getattr(spark.sparkContext, "_quarry_shared", None)
    if found is None:
        found = spark.sparkContext._quarry_shared = tempfile.mkdtemp(prefix="quarry-")
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back. A lost
    executor then costs the tasks it ran, not the plan before them; and a join on the
    result has a plain exchange on each side, which adaptive execution can split."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the folders of ``written`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quarry_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows that one Arrow batch between the JVM and a Python worker holds, or one row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows travel to Python workers in batches of ``BATCH_BYTES``,
    not of 64 MB. Each task holds a batch on both sides, with copies; the workers stand beside
    the JVM, which keeps what its largest batches took. No result depends on it but which
    documents share a block of the packing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def in_file_order(docs: DataFrame, names: tuple[str, str] = ("_file", "_row")) -> DataFrame:
    """``docs`` with two columns, file and row, that give the order in which Spark wrote its
    part files; nulls where it is not read from files."""
    if not docs.inputFiles():
        return docs.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("long")})
    name = F.col("_metadata.file_name")
    part = F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 10, "0")
    return docs.select("*", F.concat(part, F.lit("-"), name).alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
