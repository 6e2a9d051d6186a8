"""Streaming queries: archive and scoring, each on its own checkpoint, with dead letters.

A broker's source and sink are a matter of options (``sources.config.kafka_options``); any streaming frame with
envelope columns will do. Delivery is at least once, and the archive inserts by reference, so reruns add nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.functions.refs import index_day, raw_log_ref
from sparkwarden.operators import archive
from sparkwarden.operators.normalize import normalize
from sparkwarden.operators.redact import Policy, redact
from sparkwarden.operators.scoring import score
from sparkwarden.streaming.breaker import CircuitBreaker


def with_ref(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_log_ref", raw_log_ref(*[F.col(c) for c in ("raw", "source_type", "host", "ingest_ts")]))


def score_lines(df: DataFrame, classifier: Callable[[DataFrame], F.Column]) -> DataFrame:
    """Envelopes to scored events; classifier gives a score column of normalised rows."""
    named = with_ref(df).withColumnRenamed("source_type", "_hint").withColumnRenamed("host", "_host")
    rows = normalize(named, hint="_hint").withColumn("host", F.when(F.col("host") == "unknown", F.coalesce("_host", "host")).otherwise(F.col("host"))).drop("_hint", "_host")
    return score(rows.withColumn("classifier_score", classifier(rows)))


def spool(batch: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, for ``archive.drain_spool`` to read when the broker is back."""
    batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("append").text(path)


def stop_all(spark: SparkSession, wait_s: float = 30.0) -> list[str]:
    """Stops every streaming query of the session: each ends the batch that it is in, if it can in time. Returns their names or ids."""
    stopped = []
    for q in spark.streams.active:
        end = time.monotonic() + wait_s
        while q.isActive and q.status["isTriggerActive"] and time.monotonic() < end:
            time.sleep(0.1)
        q.stop()
        stopped.append(q.name or q.id)
    return stopped


def _guarded(write: Callable[[DataFrame], None], letters: str, topic: str, breaker: CircuitBreaker):
    def run(batch: DataFrame, epoch: int) -> None:
        try:
            breaker.call(write, batch)
        except Exception as e:  # a failed batch goes to dead letters, and the stream goes on
            archive.dead_letters(batch, F.lit(str(e)), topic, F.lit(epoch).cast("string")).write.mode("append").parquet(letters)

    return run


def archive_stream(stream: DataFrame, path: str, letters: str, checkpoint: str, policy: Policy | None = None, once: bool = False) -> StreamingQuery:
    """Redacted raw events by day of ingestion, one for each reference."""

    def write(batch: DataFrame) -> None:
        rows = with_ref(batch).withColumn("raw", redact(F.col("raw"), policy))
        archive.write(rows, path, index_day(F.timestamp_micros((F.col("ingest_ts") * 1_000_000).cast("long"))))

    return _start(stream, _guarded(write, letters, "raw-logs", CircuitBreaker()), checkpoint, once)


def scoring_stream(stream: DataFrame, classifier: Callable[[DataFrame], F.Column], sink: Callable[[DataFrame], None], letters: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(stream, _guarded(lambda batch: sink(score_lines(batch, classifier)), letters, "raw-logs", CircuitBreaker()), checkpoint, once)


def _start(stream: DataFrame, run, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, ts: str, labels: list[str], window: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window), *labels).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *labels, "n")
