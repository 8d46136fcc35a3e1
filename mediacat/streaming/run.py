"""Runs a stream over what its source holds now, and reads the rows it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input once and return the output as a batch table.

    Rows and the query's checkpoint go below ``spark.checkpoint.dir``, which all executors share; below a local folder
    only where that is unset and Spark is one process.
    """
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stream-")
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
