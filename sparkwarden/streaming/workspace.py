"""Where bounded streaming queries keep what they write: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session, as tests have, gets a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkwarden-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def by_batch(folder: str):
    """A sink that writes each micro-batch to a folder of its number, so a batch that is done again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a bounded stream, run to its end: all that its source has now."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    query = stream.writeStream.foreachBatch(by_batch(f"{folder}/rows")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
