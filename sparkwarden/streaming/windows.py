"""Windows, sessions and joins of streams by event time, and a way for what comes too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(keys, start, end, n): runs of events of a key with less than gap between them. A stream gives a session once the watermark has passed its end; a batch gives all."""
    window = F.session_window(ts, gap).alias("w")
    return _timed(df, ts, late).groupBy(window, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """left with the rows of right of the same keys that come within the time after it, edges included. The names of both sides must differ but for the keys.

    On streams both sides' rows are state until the watermarks say that no partner can come; then outer joins give what had none. Null keys meet nothing.
    """
    a, b = _timed(left, left_ts, late), _timed(right.withColumnsRenamed({k: f"_{k}" for k in keys}), right_ts, late)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    met = a.join(b, [*same, F.col(right_ts) >= F.col(left_ts), F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}")], how)
    return met.drop(*[f"_{k}" for k in keys])


def split_late(stream: DataFrame, ts: str, late: str, on_time: Callable[[DataFrame, int], None], too_late: Callable[[DataFrame, int], None], folder: str, once: bool = False) -> StreamingQuery:
    """Sends the rows that are older than the newest row of the batches before by more than ``late`` to too_late, and the others to on_time; rows without a time are on time.

    Spark's own operators drop such rows without a word. The newest time of each batch is written below folder (shared by driver and executors) under the batch's number, so a
    batch that is done again is split as it was.
    """
    spark = stream.sparkSession
    marks = f"{folder}/marks"

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{marks}/batch={number}")
        before = spark.read.schema("newest timestamp, batch long").parquet(marks).where(F.col("batch") < number).agg(F.max("newest").alias("_newest"))
        rows = batch.crossJoin(F.broadcast(before))  # one row
        old = F.coalesce(F.col(ts).cast("timestamp") < F.col("_newest") - F.expr(f"INTERVAL {late}"), F.lit(False))
        on_time(rows.where(~old).drop("_newest"), number)
        too_late(rows.where(old).drop("_newest"), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
