"""What the operators need of a session: durable intermediate results and small parts of Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that Python works on at a time. Spark bounds the batches themselves by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
TEXT_ROWS = 256


def parts(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows; no session setting is touched."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, as tests have, gets a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="sparkwarden-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut; the rows survive the loss of executors.

    Start Spark with ``spark.cleaner.referenceTracking.cleanCheckpoints=true`` to have them removed once nothing refers to them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_few(df: DataFrame, files: int = 8) -> DataFrame:
    """durable(df) in a few files, for what is small beside the tables that it comes from: sums by list, hot keys."""
    return durable(df.repartition(files))


def durable_alone(df: DataFrame) -> DataFrame:
    """durable(df), and the shuffles that went into it leave no files behind: for large ones that nothing else will read."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name)
    conf.set(name, "true")
    try:
        return durable(df.select("*"))  # a plan of its own, which takes the setting in
    finally:
        conf.set(name, was)


#: Rows of one key from which on they are spread over several tasks, and keys and rows of small tables (some 100 bytes each) up to which they are broadcast.
HOT, FEW = 500, 250_000


def many_to_one(rows: DataFrame, table: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """rows with what table says of their key, if anything; key columns aren't null, and table has one row for each key.

    counts (key, rows): how many rows a key has, for hot ones at least. Rows of hot keys are dealt to several places,
    and the table's row goes to each. Hot keys are broadcast behind a check of their number; beyond it each of
    them is a small part of the rows, and skew is left to the adaptive join.
    """
    hot = durable_few(counts.where(F.col("rows") >= HOT).select(*key, F.ceil(F.col("rows") / HOT).cast("int").alias("_places")))
    n = hot.count()
    if n == 0 or n > FEW:
        return rows.join(table, key, "left")
    known = F.broadcast(hot)
    places = F.coalesce("_places", F.lit(1))
    dealt = rows.join(known, key, "left").withColumn("_place", F.pmod(F.xxhash64(F.monotonically_increasing_id()), places).cast("int")).drop("_places")
    copies = table.join(known, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    return dealt.join(copies, [*key, "_place"], "left").drop("_place")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate results, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
