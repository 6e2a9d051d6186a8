"""Tables, and log lines derived from them: the tables hold none themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL, by the function's name."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def props_k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """events (or rows of that table, as a stream has them) with k, a score in [0, 1) and a message that now and then tells of an attack."""
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed password for invalid user admin from 10.0.0."), F.col("user_id") % 250))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("payment accepted k="), F.col("k")))
        .when((F.col("event_type") == "click") & (F.col("k") < 5), F.lit("GET /?q=1 UNION  SELECT pass"))
        .otherwise(F.concat(F.lit("session opened for user u"), F.col("user_id")))
    )
    rows = table(spark, sf_dir, "events") if rows is None else rows
    return rows.withColumn("k", props_k()).withColumn("score", F.col("value") / (F.col("value") + 50)).withColumn("message", message)


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("<13>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host-"), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit("["), F.col("event_id"), F.lit("]: "))
    return events(spark, sf_dir).withColumn("raw", F.concat(head, "message"))


EVENTS = r"""
e AS (
  SELECT *, value / (value + 50) AS score,
    CASE WHEN event_type = 'error' THEN 'Failed password for invalid user admin from 10.0.0.' || (user_id % 250)
         WHEN event_type = 'purchase' THEN 'payment accepted k=' || k
         WHEN event_type = 'click' AND k < 5 THEN 'GET /?q=1 UNION  SELECT pass'
         ELSE 'session opened for user u' || user_id END AS message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
LINES = EVENTS + r""",
lines AS (SELECT *, '<13>' || strftime(ts, '%b %d %H:%M:%S') || ' host-' || user_id || ' ' || event_type || '[' || event_id || ']: ' || message AS raw FROM e)"""
