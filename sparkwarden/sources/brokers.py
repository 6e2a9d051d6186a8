"""Streams of a broker for each consumer group, as options of Spark's source: the connector is not part of this environment.

Offsets are the checkpoint's: a query goes on where its checkpoint ends, and ``start`` counts only for a new one. Delivery is at least
once; the archive inserts by reference, so what comes twice adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """A consumer group: its topics, where a new checkpoint starts, and how many records a micro-batch takes at most (a pace: the rest follows)."""

    name: str
    topics: tuple[str, ...]
    start: str = "latest"
    most: int = 100_000


# --- fixed values: groups and topics ---
RAW, SCORED, DEAD = "raw-logs", "scored-logs", "raw-logs-dlq"
ARCHIVE = Group("log-archive", (RAW,), "earliest")
SCORER = Group("log-scorer", (RAW,), "earliest")
REPLAY = Group("log-scorer-dlq-replay", (DEAD,), "earliest")


def reader_options(group: Group, broker: dict[str, str]) -> dict[str, str]:
    """Options for ``readStream.format("kafka")``; broker: ``config.kafka_options``. Lost offsets fail the query: nothing is skipped silently."""
    if group.start not in ("latest", "earliest"):
        raise ValueError(f"unknown start {group.start}")
    return broker | {"subscribe": ",".join(group.topics), "startingOffsets": group.start, "maxOffsetsPerTrigger": str(group.most), "groupIdPrefix": group.name, "failOnDataLoss": "true", "includeHeaders": "true"}


def stream(spark: SparkSession, group: Group, broker: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**reader_options(group, broker)).load()


def trace_parent(headers: Column, ref: Column) -> Column:
    """The trace that a record belongs to: the header that came with it, or one that follows from its reference, so reruns agree."""
    came = F.try_element_at(F.filter(headers, lambda h: h["key"] == "traceparent"), F.lit(1))["value"].cast("string")
    own = F.concat(F.lit("00-"), F.left(ref, F.lit(32)), F.lit("-"), F.substring(ref, 33, 16), F.lit("-01"))
    return F.coalesce(F.when(came.rlike("^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"), came), own)


def scored_records(scored: DataFrame, headers: str | None = None) -> DataFrame:
    """(topic, key, value, headers) of scored events for the scored topic, to be written once the record has gone to its sink."""
    kept = [c for c in scored.columns if c not in ("raw", headers)]
    given = F.col(headers) if headers else F.array().cast("array<struct<key:string,value:binary>>")
    trace = F.array(F.struct(F.lit("traceparent").alias("key"), F.encode(trace_parent(given, F.col("raw_log_ref")), "UTF-8").alias("value")))
    return scored.select(F.lit(SCORED).alias("topic"), F.col("host").cast("string").alias("key"), F.to_json(F.struct(*kept)).alias("value"), trace.alias("headers"))
