"""The archive of raw events, dead letters and the spool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.operators.ordered import running


def new_rows(batch: DataFrame, known: DataFrame, ref: str = "raw_log_ref") -> DataFrame:
    """Rows of batch, one for each ref, whose ref isn't known: insert-if-absent."""
    return batch.dropDuplicates([ref]).join(known.select(ref), ref, "left_anti")


def bulk_outcome(batch: DataFrame, known: DataFrame, ref: str = "raw_log_ref") -> DataFrame:
    """(ref, outcome) of each row: created, or conflict where the ref is known or repeats in the batch."""
    first = F.row_number().over(Window.partitionBy(ref).orderBy(*[c for c in batch.columns if c != ref]))
    tagged = batch.withColumn("_n", first).join(known.select(ref, F.lit(True).alias("_known")).distinct(), ref, "left")
    return tagged.select(ref, F.when(F.col("_known").isNotNull() | (F.col("_n") > 1), "conflict").otherwise("created").alias("outcome"))


def write(batch: DataFrame, path: str, day: Column, ref: str = "raw_log_ref") -> None:
    """Appends the new rows under their day. Only the days of the batch are read to find known refs."""
    dated = batch.withColumn("ingest_date", day)
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path).join(F.broadcast(dated.select("ingest_date").distinct()), "ingest_date", "left_semi")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = dated.limit(0)
    new_rows(dated, known, ref).write.mode("append").partitionBy("ingest_date").parquet(path)


def get(archive: DataFrame, ref: str, day: str | None = None) -> DataFrame:
    """The event of a ref; a day prunes to its partition."""
    found = archive.where(F.col("raw_log_ref") == ref)
    return (found.where(F.col("ingest_date") == day) if day else found).limit(1)


def recent(archive: DataFrame, as_of: str, minutes: int, host: str | None = None, source_type: str | None = None, size: int = 100) -> DataFrame:
    """Events of the minutes before as_of, the newest first, at most size."""
    end = F.lit(as_of).cast("timestamp")
    rows = archive.where((F.col("ingest_ts") >= end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (F.col("ingest_ts") <= end))
    for name, value in (("host", host), ("source_type", source_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("ingest_ts"), "raw_log_ref").limit(size)


def expired(archive: DataFrame, as_of: str, keep_days: int = 90) -> DataFrame:
    """Days to delete."""
    return archive.select("ingest_date").distinct().where(F.to_date("ingest_date", "yyyy.MM.dd") < F.date_sub(F.to_date(F.lit(as_of)), keep_days))


def phases(archive: DataFrame, as_of: str, hot_days: int = 7, keep_days: int = 90) -> DataFrame:
    """(ingest_date, phase): hot for the last days, warm up to the last that is kept, then delete."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("ingest_date", "yyyy.MM.dd"))
    return archive.select("ingest_date").distinct().withColumn("phase", F.when(age > keep_days, "delete").when(age > hot_days, "warm").otherwise("hot"))


def dead_letters(failed: DataFrame, error: Column, topic: str, at: Column) -> DataFrame:
    """Envelopes of failed rows; the count of tries goes on from the row's own."""
    tries = F.col("retry_count") if "retry_count" in failed.columns else F.lit(0)
    keep = [c for c in failed.columns if c != "retry_count"]
    return failed.select(F.to_json(F.struct(*keep)).alias("original"), error.alias("error"), F.lit(topic).alias("original_topic"), at.alias("timestamp"), (F.coalesce(tries, F.lit(0)) + 1).alias("retry_count"))


def replay(letters: DataFrame, most: int = C.MAX_REPLAYS, counter: str = C.REPLAY_COUNTER) -> DataFrame:
    """(topic, value, replay_count) of letters whose original is an object and that weren't replayed ``most`` times yet. The counter is a field of the object itself; fields of that name deeper down stay."""
    fields = F.try_variant_get(F.try_parse_json("original"), "$", "map<string,variant>")
    count = F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(counter)), "$", "int"), F.lit(0)) + 1
    kept = F.map_filter(fields, lambda k, v: k != counter)
    value = F.to_json(F.map_concat(kept, F.create_map(F.lit(counter), F.parse_json(count.cast("string")))))
    objects = letters.where(F.schema_of_variant(F.try_parse_json("original")).startswith("OBJECT"))
    return objects.select(F.col("original_topic").alias("topic"), value.alias("value"), count.alias("replay_count")).where(F.col("replay_count") <= most)


def replay_stored(spark: SparkSession, letters: str, sink, checkpoint: str, most: int = C.MAX_REPLAYS):
    """A bounded query over stored letters (Parquet files below a path): what came since the last run goes to sink(batch), then it stops."""
    schema = "original string, error string, original_topic string, timestamp string, retry_count int"
    stream = spark.readStream.schema(schema).parquet(letters)
    return stream.writeStream.foreachBatch(lambda batch, _: sink(replay(batch, most))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bulk_errors(answers: DataFrame, status: str = "status") -> DataFrame:
    """answers with ``outcome``: created (below 300), conflict (there already: no failure) or failed; no status is a failure."""
    code = F.col(status)
    return answers.withColumn("outcome", F.when(code == C.ALREADY_EXISTS, "conflict").when(code < 300, "created").otherwise("failed"))


def bound_spool(lines: DataFrame, order: str, max_bytes: int, line: str = "value") -> DataFrame:
    """The newest lines that fit into max_bytes with their line ends. Bytes run along the order by ranges, so no task holds the spool."""
    size = F.octet_length(line) + 1
    whole = lines.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_whole"))
    return running(lines, order, {"_before": size}).crossJoin(F.broadcast(whole)).where(F.col("_whole") - F.col("_before") <= max_bytes).select(*lines.columns)  # one row


def drain_spool(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes of a spool's lines with their own ingest_ts, and the lines that are none."""
    lines = spark.read.text(path)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return lines.where(good).select(F.from_json("value", schema).alias("e")).select("e.*"), lines.where(~good)
