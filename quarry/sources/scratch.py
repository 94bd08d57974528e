"""Places for tables that are written and read back within one query, and the size of what
travels to Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, which driver and executors share; a local
    session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that one Arrow batch between the JVM and a Python worker holds, or one row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows travel to Python workers in batches of ``BATCH_BYTES``,
    not of 64 MB; a worker holds a batch with several copies."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
