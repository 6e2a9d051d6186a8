"""Writers: files by source type, reports, brokers and response counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.output import envelope


def by_type(df: DataFrame, path: str, column: str = "source_type") -> None:
    """JSON lines in a folder for each source type; rows of a type are brought together first, so each has few files."""
    df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(column).json(path)


def report(metrics: DataFrame, path: str) -> None:
    """One JSON object of a one-row frame."""
    metrics.limit(1).coalesce(1).write.mode("overwrite").json(path)


def to_broker(df: DataFrame, topic: str, options: dict[str, str], key: str = "host") -> None:
    """Rows as JSON, keyed by host; needs the broker's connector. Options as ``config.kafka_options`` gives them."""
    sent = {"kafka.acks": "all", "kafka.compression.type": "lz4", "kafka.retries": "3"} | options
    envelope(df, key).write.format("kafka").options(**sent).option("topic", topic).save()


def response_counts(scored: DataFrame, latency: str = "scoring_latency_ms") -> DataFrame:
    """One row of a batch's answer: total, high, medium and the whole latency."""
    priority: Column = F.col("ai_priority")
    return scored.agg(F.count("*").alias("total"), F.count_if(priority == "HIGH").alias("high"), F.count_if(priority == "MEDIUM").alias("medium"), F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency_ms"))


def rounded(scored: DataFrame, digits: int = 4) -> DataFrame:
    """The public view of scored events: numbers rounded (latency to 2), without raw text and internal flags."""
    kept = [c for c in scored.columns if c not in ("raw", "score_degraded")]
    kinds = dict(scored.dtypes)
    show = lambda c: F.round(c, 2 if c == "scoring_latency_ms" else digits).alias(c) if kinds[c] == "double" else F.col(c)
    return scored.select(*[show(c) for c in kept])
