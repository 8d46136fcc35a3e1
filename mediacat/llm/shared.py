"""Intermediate tables in the folder that the driver and all executors share, and keys that bear nulls."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts below every id, so that rows without an id come first.
NO_ID = -(2**63)

#: Rows of an Arrow batch where the session sets none: a task and its worker each hold whole texts of more than one batch.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's 10 000 rows of an Arrow batch, which are meant for short rows; a size that the session sets stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a local folder only where that is unset and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows starts from files, not from lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, for a query; the session's Arrow batches are bounded from here on."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
