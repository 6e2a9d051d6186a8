"""Streams by event time against batches, late rows, and the table function of SQL."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.sources import framing, tables
from sparkwarden.streaming import windows
from sparkwarden.streaming.workspace import by_batch, drained

SCHEMA = "n long, user string, t long"


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=SCHEMA, ts="at"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn(ts, F.timestamp_seconds("t"))


def test_sessions_are_the_batchs(spark, tmp_path):
    rng, t, rows = random.Random(2), 1_700_000_000, []
    for i in range(200):
        t += rng.choice([1, 5, 40])
        rows.append((i, rng.choice("abc"), t - rng.choice([0, 3])))
    for s in range(0, 200, 50):
        put(spark, tmp_path / "in", rows[s : s + 50])
    put(spark, tmp_path / "in", [(999, "flush", t + 10_000)])  # the watermark passes all others
    put(spark, tmp_path / "in", [(1000, "flush", t + 20_000)])
    got = drained(windows.sessions(stream(spark, tmp_path / "in"), "at", ["user"], "30 seconds", "1 minute"), "sessions").where("user != 'flush'").collect()
    batch = windows.sessions(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("t")), "at", ["user"], "30 seconds", "1 minute").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(batch) > 20


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_interval_join_is_the_batchs(spark, tmp_path, how):
    rng, t, asks, answers = random.Random(3), 1_700_000_000, [], []
    for i in range(120):
        t += rng.choice([1, 10])
        asks.append((i, rng.choice(["a", "b", None]), t))
        if rng.random() < 0.6:
            answers.append((i, rng.choice("ab"), t + rng.choice([0, 2, 20, 21])))
    for s in range(0, 120, 40):
        put(spark, tmp_path / "a", asks[s : s + 40])
        put(spark, tmp_path / "b", [x for x in answers if s <= x[0] < s + 40])
    for k in (1, 2):
        put(spark, tmp_path / "a", [(900 + k, "z", t + k * 10_000)])
        put(spark, tmp_path / "b", [(900 + k, "y", t + k * 10_000)])
    sides = lambda a, b: (a.withColumnRenamed("n", "ask").drop("t"), b.select(F.col("n").alias("answer"), "user", F.col("at").alias("then")))
    join = lambda a, b: windows.interval_join(*sides(a, b), ["user"], "at", "then", "20 SECONDS", "1 minute", how).select("ask", "user", "answer")
    got = drained(join(stream(spark, tmp_path / "a"), stream(spark, tmp_path / "b")), "joined").where("ask < 900").collect()
    whole = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("t"))
    want = join(whole(asks), whole(answers)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.answer is not None for r in want)


def test_late_rows_have_a_way_of_their_own(spark, tmp_path):
    batches = [[(0, "a", 1000), (1, "a", 1100)], [(2, "a", 1030), (3, "a", 1045), (4, "a", None)], [(5, "a", 1300)], [(6, "a", 1239), (7, "a", 1240), (8, "a", 900)]]
    for rows in batches:
        put(spark, tmp_path / "in", rows)
        windows.split_late(stream(spark, tmp_path / "in"), "at", "60 SECONDS", by_batch(str(tmp_path / "good")), by_batch(str(tmp_path / "late")), str(tmp_path / "q"), once=True).awaitTermination()
    read = lambda name: sorted(r.n for r in spark.read.schema(f"{SCHEMA}, at timestamp").parquet(str(tmp_path / name)).collect())
    assert read("good") == [0, 1, 3, 4, 5, 7] and read("late") == [2, 6, 8]


def test_deframe_in_sql(spark):
    rng, rows = random.Random(4), []
    for conn in ("a", "b", "c"):
        data = b"".join(rng.choice([b"5 hello", b"line one\n", "8 éééé".encode(), b"\n", b"9 a\nb 3 xyz"]) for _ in range(60)) + b"no end"
        cuts = sorted(rng.sample(range(len(data)), 25))
        rows += [(conn, k, data[s:e]) for k, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    df = spark.createDataFrame(rows, "conn string, seq long, data binary").repartition(4)
    tables.register(spark)
    got = spark.sql("SELECT * FROM deframe(TABLE({chunks}))", chunks=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, framing.deframe(df).collect())) and len(got) > 150
    short = spark.sql("SELECT * FROM deframe(TABLE({chunks}), 4)", chunks=df).collect()
    assert sorted(map(tuple, short)) == sorted(map(tuple, framing.deframe(df, 4).collect())) and len(short) < len(got)
    with pytest.raises(Exception, match="deframe needs a table"):
        spark.sql("SELECT * FROM deframe(TABLE({chunks}))", chunks=df.drop("seq"))
