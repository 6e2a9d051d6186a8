"""The streaming cascade against the batch one, with restarts, and the folds against walks."""

import json
import math
import random
from collections import deque
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import cascade, drift, folds, models, rules, scoring, similarity
from sparkwarden.streaming import cascade as streams
from sparkwarden.streaming.workspace import by_batch

SCHEMA = "n long, at timestamp, raw string, text string, source_type string, p1 double, p2 double, tenant string, embedding array<double>"
RULES = [("r-a", 0, "CommandLine", "contains", "admin from 10.0.0.9"), ("r-b", 1, "Details", "endswith", "k=7")]
DRIFT = folds.Drift(window=40, interval=20, limit=0.3)
NOVELTY = folds.Novelty(window=30, warmup=10, baseline=5)


def some_events(n, seed=3):
    """Scores shift in the middle third, so the second tier goes off and on again."""
    import datetime

    rng, t, out = random.Random(seed), 1_700_000_000, []
    base = [np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)]
    for i in range(n):
        t += rng.choice([1, 7, 40, 400])
        v = rng.choice(base) + np.array([rng.gauss(0, 0.05) for _ in range(4)])
        text = rng.choice([f"Failed password for admin from 10.0.0.{i % 12}", f"paid k={i % 9}", "session opened", "GET /?q=1 UNION  SELECT pass"])
        low = rng.random() * 0.4 + (0.55 if n // 3 <= i < 2 * n // 3 else 0.0)
        second = None if i % 11 == 0 else min(1.0, low + rng.random() * 0.05)
        at = datetime.datetime.fromtimestamp(t, datetime.timezone.utc).replace(tzinfo=None)
        out.append((i, at, text, text, rng.choice(["endpoint", "syslog"]), low if i % 13 else None, second, rng.choice(["x", "y", None]), None if i % 17 == 5 else (v / np.linalg.norm(v)).tolist()))
    return out


def the_models(split):
    one = lambda c, s: F.struct(c["no"].alias("no"), c["technique_id"].alias("id"), s.alias("score"))
    return cascade.Models(
        syslog=lambda d: d["p1"], event=lambda d: d["p1"], second=lambda d: d["p2"], entities=lambda d: F.when(d["n"] % 19 != 0, models.rule_entities(d["text"])),
        cross=lambda d: F.transform(F.slice(d["candidates"], 1, 1), lambda c: one(c, d["n"] / 500.0)), band=scoring.Band(0.0, 1.0), split=split,
    )


WANTED = ["n", "classifier_score", "tier2_used", "drifting", "is_duplicate", "dedup_similarity", "novelty_score", "ai_entities", "ai_mitre_technique", "sigma_rule_ids", "score_degraded", "ai_threat_score", "ai_priority", "ai_confidence"]


def plain(row):
    return [round(v, 9) if isinstance(v, float) else v for v in row]


def tables(spark):
    techniques = spark.createDataFrame([(i, f"T{i}", [float(i == k) for k in range(4)]) for i in range(4)], "no int, technique_id string, vector array<double>")
    return spark.createDataFrame(RULES, rules.RULE_SCHEMA), techniques


def read_stream(spark, folder: Path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(folder))


def put(spark, folder: Path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("split", [True, False])
def test_stream_is_the_batch_also_after_a_restart(spark, tmp_path, split):
    rows = some_events(300)
    r, t = tables(spark)
    batch = cascade.score_events(spark.createDataFrame(rows, SCHEMA), "n", "at", the_models(split), r, t, seq="n", novelty={"window": 30, "warmup": 10, "baseline": 5}, monitor=DRIFT)
    want = sorted(map(plain, batch.select(*WANTED).collect()))
    assert {w[3] for w in want} == {True, False} and {w[2] for w in want} == {True, False} and any(w[4] for w in want)
    seen, numbers = [], []

    def sink(part, number):
        numbers.append(number)
        seen.extend(map(plain, part.select(*WANTED).collect()))

    def run():
        scored = streams.score_stream(read_stream(spark, tmp_path / "in"), "n", "at", the_models(split), r, t, memory=streams.Memory(novelty=NOVELTY, drift=DRIFT))
        streams.start_scoring(scored, sink, str(tmp_path / "ck"), once=True).awaitTermination()

    for cut in ((0, 70), (70, 130), (130, 300)) if split else ((0, 130), (130, 300)):  # each part by a query of its own, from the checkpoint of the one before
        put(spark, tmp_path / "in", rows[slice(*cut)])
        run()
    assert sorted(seen) == want and len(set(numbers)) == len(numbers)


def test_what_a_failed_batch_did_is_done_again(spark, tmp_path):
    rows = some_events(120)
    r, t = tables(spark)
    put(spark, tmp_path / "in", rows[:60])
    seen, fail = {}, [True]

    def sink(part, number):
        got = list(map(plain, part.select(*WANTED).collect()))
        if number == 1 and fail[0]:
            raise RuntimeError("the sink is down")
        seen[number] = got

    def run():
        scored = streams.score_stream(read_stream(spark, tmp_path / "in"), "n", "at", the_models(False), r, t, memory=streams.Memory(novelty=NOVELTY, drift=DRIFT))
        return streams.start_scoring(scored, sink, str(tmp_path / "ck"), once=True)

    run().awaitTermination()
    put(spark, tmp_path / "in", rows[60:])
    with pytest.raises(Exception, match="the sink is down"):
        run().awaitTermination()
    fail[0] = False
    run().awaitTermination()
    batch = cascade.score_events(spark.createDataFrame(rows, SCHEMA), "n", "at", the_models(False), r, t, seq="n", novelty={"window": 30, "warmup": 10, "baseline": 5}, monitor=DRIFT)
    assert sorted(sum(seen.values(), [])) == sorted(map(plain, batch.select(*WANTED).collect()))


def test_records_are_published_after_the_sink(spark, tmp_path):
    rows = some_events(60)
    r, t = tables(spark)
    for s in (0, 30):
        put(spark, tmp_path / "in", rows[s : s + 30])
    order = []

    def noted(name, sink):
        return lambda batch, number: (order.append((number, name)), sink(batch, number))

    coming = read_stream(spark, tmp_path / "in").withColumns({"host": F.concat(F.lit("h"), "n"), "raw_log_ref": F.sha2("raw", 256)})
    scored = streams.score_stream(coming, "n", "at", the_models(False), r, t, memory=streams.Memory(novelty=NOVELTY))
    publish = streams.published(lambda records: records.write.mode("append").parquet(str(tmp_path / "topic")))
    sink = streams.in_turn(noted("events", by_batch(str(tmp_path / "events"))), noted("topic", publish))
    streams.start_scoring(scored, sink, str(tmp_path / "ck"), once=True).awaitTermination()
    assert order == [(0, "events"), (0, "topic"), (1, "events"), (1, "topic")]
    records = spark.read.parquet(str(tmp_path / "topic")).collect()
    assert sorted(x.key for x in records) == sorted(f"h{i}" for i in range(60)) and {x.topic for x in records} == {streams.brokers.SCORED}
    events = {e.n: e for e in spark.read.parquet(str(tmp_path / "events")).collect()}
    assert len(events) == 60
    for x in records:
        told = json.loads(x.value)
        assert told["ai_priority"] == events[told["n"]].ai_priority and "raw" not in told and x.headers[0].key == "traceparent"


def drained(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}").collect(), q


def test_signals_by_scope(spark, tmp_path, monkeypatch):
    rows = [e for e in some_events(200, 8) if e[8] is not None]
    for s in range(0, len(rows), 60):
        put(spark, tmp_path / "in", rows[s : s + 60])
    df = spark.createDataFrame(rows, SCHEMA)
    got, _ = drained(spark, streams.novelty_stream(read_stream(spark, tmp_path / "in"), "n", "at", scope="tenant", novelty=NOVELTY), tmp_path / "a", "by_tenant")
    want = {r.n: r for r in similarity.novelty(df, "n", scope=["tenant"], window=30, warmup=10, baseline=5).collect()}
    assert len(got) == len(rows) and all(math.isclose(r.novelty_score, want[r.n].novelty_score, abs_tol=1e-9) and r.baseline_size == want[r.n].baseline_size for r in got)
    got, _ = drained(spark, streams.duplicates_stream(read_stream(spark, tmp_path / "in"), "n", "at", scope="tenant"), tmp_path / "b", "dups_by_tenant")
    want = {r.n: r for r in similarity.mark_duplicates(df, "n", "at", scope=["tenant"]).collect()}
    assert all(r.is_duplicate == want[r.n].is_duplicate and math.isclose(r.dedup_similarity, want[r.n].dedup_similarity, abs_tol=1e-9) for r in got) and any(r.is_duplicate for r in got)
    assert {r.tenant for r in got} == {"x", "y", None}


def test_a_batch_writes_what_came(spark, tmp_path):
    """State that is written follows a micro-batch's events, not the windows."""
    wide = folds.Novelty(window=3000, warmup=10, baseline=5)
    rows = some_events(2_600, 5)
    for s, e in ((0, 2500), (2500, 2520), (2520, 2600)):
        put(spark, tmp_path / "in", rows[s:e])
    _, q = drained(spark, streams.novelty_stream(read_stream(spark, tmp_path / "in"), "n", "at", novelty=wide), tmp_path, "written")
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in (q.recentProgress) if p["numInputRows"]]
    vectors = [sum(e[8] is not None for e in rows[s:e]) for s, e in ((0, 2500), (2500, 2520), (2520, 2600))]
    assert len(updated) == 3
    for n, v in zip(updated, vectors, strict=True):
        assert n <= 2 + v // streams.CHUNK + 2  # sums, the monitor's row and the chunks that the events fill


def walk(rows, monitor, resets=()):
    """What counts for each event, one by one."""
    held, state, out, seen, first_window = deque(maxlen=monitor.window), False, [], 0, []
    begin = max(monitor.window + 1, monitor.interval)

    def shares(xs):
        return np.maximum(np.bincount([min(int(x * 10), 9) for x in xs], minlength=10) / len(xs), 1e-10)

    for n, a, b in rows:
        if n in resets:
            held.clear()
            state, seen, first_window = False, 0, []
        final = a if b is None or state else b
        seen += 1
        held.append(final)
        if len(first_window) < monitor.window:
            first_window.append(final)
        was, psi, edge = state, None, None
        if seen >= begin and (seen - begin) % monitor.interval == 0:
            p, q = shares(held), shares(first_window)
            psi = float(((p - q) * np.log(p / q)).sum())
            state = psi > monitor.limit
            edge = None if state == was else "start" if state else "end"
        out.append((n, was, final, psi, edge))
    return out


@pytest.mark.parametrize("resets", [(), (50, 51, 400)])
def test_fallback_is_the_walk(spark, tmp_path, resets):
    rng = random.Random(12)
    rows = [(i, rng.random() * 0.5, None if rng.random() < 0.4 else 0.5 * rng.random() + (0.5 if 150 <= i < 260 else 0.0)) for i in range(450)]
    want = walk(rows, DRIFT, resets)
    assert {w[4] for w in want} == {None, "start", "end"}
    schema = "n long, a double, b double"
    df = spark.createDataFrame(rows, schema).withColumn("again", F.col("n").isin(*resets))
    got = [tuple(r) for r in drift.fallback(df.repartition(5), "n", "a", "b", DRIFT, reset="again").orderBy("n").collect()]
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and all((a is None) == (b is None) and (a is None or math.isclose(a, b)) for a, b in zip((g[3] for g in got), (w[3] for w in want), strict=True))
    for s in range(0, 450, 97):
        spark.createDataFrame(rows[s : s + 97], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("again", F.col("n").isin(*resets)).withColumn("at", F.timestamp_seconds("n"))
    told, _ = drained(spark, streams.drift_stream(stream, "n", "at", "a", "b", DRIFT, reset="again"), tmp_path, f"fell_back_{len(resets)}")
    assert sorted((r.n, r.drifting, r.final_score, r.edge) for r in told) == sorted((w[0], w[1], w[2], w[4]) for w in want)


def test_fallback_by_scope_and_empty(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.random(), None if i % 3 else rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "n long, tenant string, a double, b double")
    got = {r.n: r for r in drift.fallback(df, "n", "a", "b", DRIFT, scope="tenant").collect()}
    for tenant in "ab":
        for n, was, final, _, edge in walk([(n, a, b) for n, s, a, b in rows if s == tenant], DRIFT):
            assert (got[n].drifting, got[n].final_score, got[n].edge) == (was, final, edge)
    assert drift.fallback(df.limit(0), "n", "a", "b", DRIFT).count() == 0
