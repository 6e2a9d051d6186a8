from collections import deque
"""Window forms against a walk through the events, and streams against batches."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import drift, similarity
from sparkwarden.streaming import stateful
from sparkwarden.streaming.breaker import CircuitBreaker, CircuitOpen


def stream_of(rng, n=150, width=3):
    t, out = 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([1, 40, 120, 290, 700])
        v = np.array([rng.gauss(0, 1) for _ in range(width)])
        out.append((i, t, (v / np.linalg.norm(v)).tolist()))
    return out


@pytest.mark.parametrize("mode", ["window", "lag"])
def test_dedup_is_the_walk(spark, mode):
    rows = stream_of(random.Random(4))
    df = spark.createDataFrame(rows, "n long, t double, embedding array<double>").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.n: r for r in similarity.mark_duplicates(df, "n", "ts", least=0.9, mode=mode).collect()}
    held = deque()
    for i, (n, t, v) in enumerate(rows):
        since = (rows[i - 1][1] if mode == "lag" and i else t) - 300
        sims = [float(np.dot(v, w)) for u, w in held if u >= since]
        best = max(sims, default=0.0)
        assert got[n].dedup_similarity == pytest.approx(best) and got[n].is_duplicate == (best >= 0.9)
        held.append((t, v))


def test_dedup_default_similarity(spark):
    rows = [(0, 0.0, [1.0, 0.0]), (1, 10.0, [0.96, 0.28]), (2, 20.0, [0.0, 1.0]), (3, 400.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "n long, t double, embedding array<double>").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.n: r.is_duplicate for r in similarity.mark_duplicates(df, "n", "ts").collect()} == {0: False, 1: True, 2: False, 3: False}


def test_novelty_is_the_walk(spark):
    rows = stream_of(random.Random(5), 80)
    df = spark.createDataFrame([(n, v) for n, _, v in rows], "n long, embedding array<double>")
    got = {r.n: r for r in similarity.novelty(df, "n", window=20, warmup=10, baseline=5).collect()}
    for i, (n, _, v) in enumerate(rows):
        past = np.array([w for _, _, w in rows[max(0, i - 20) : i]])
        want = 0.0
        if i >= 10:
            c = past.mean(0)
            want = min(1.0, (1 - np.clip(np.dot(v, c / np.linalg.norm(c)), -1, 1)) * 2.0)
        assert got[n].novelty_score == pytest.approx(want, abs=1e-9) and got[n].baseline_size == (min(i, 20) if i >= 10 else 0)


def test_drift_is_the_walk(spark):
    rng = random.Random(6)
    scores = [rng.random() * 0.5 for _ in range(300)] + [0.5 + rng.random() * 0.5 for _ in range(300)] + [rng.random() * 0.5 for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(scores)), "n long, score double")
    got = drift.drift_checks(df, "n", window=200, interval=100).orderBy("at").collect()

    def shares(xs):
        return np.maximum(np.histogram(np.minimum(np.floor(np.array(xs) * 10), 9), bins=np.arange(11))[0] / len(xs), 1e-10)

    e, state, want = shares(scores[:200]), False, []
    for at in range(201, 901, 100):
        a = shares(scores[at - 200 : at])
        psi = float(((a - e) * np.log(a / e)).sum())
        new = psi > 0.25
        want.append((at, pytest.approx(psi), new, None if new == state else "start" if new else "end"))
        state = new
    assert [tuple(r) for r in got] == want and {w[3] for w in want} == {None, "start", "end"}
    marked = drift.drifting_at(df, drift.drift_checks(df, "n", window=200, interval=100), "n", window=200, interval=100)
    first = next(w[0] for w in want if w[2])
    assert marked.where("drifting").agg(F.min("n")).first()[0] == first + 1


def test_rate_limit_is_the_walk(spark):
    rng, t, rows = random.Random(7), {}, []
    for i in range(400):
        c = rng.choice("abc")
        t[c] = t.get(c, 0) + rng.choice([1, 10, 60])
        rows.append((i, c, float(t[c])))
    df = spark.createDataFrame(rows, "n long, client string, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.n: r.accepted for r in stateful.rate_limit(df, "client", "ts", "n", limit=3).collect()}
    kept = {}
    for n, c, at in rows:
        own = [k for k in kept.get(c, []) if k >= at - 60]
        assert got[n] == (len(own) < 3)
        kept[c] = own + [at] if got[n] else own
    assert stateful.accept([0, 60], deque(), 1, 60) == [True, False] and stateful.accept([0, 60], deque(), 1, 60, closed=False) == [True, True]


def run_stream(spark, tmp_path, frames, make, schema, name):
    folder = str(tmp_path / "in")
    q = None
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        if q is None:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, "s%d" % (n % 2), t, v) for n, t, v in stream_of(rng, 60)]
    schema = "n long, scope string, t double, v array<double>"
    timed = lambda d: d.withColumn("ts", F.timestamp_seconds("t"))
    got = run_stream(spark, tmp_path / "a", [rows[:30], rows[30:]], lambda d: stateful.dedup_stream(timed(d), "scope", "n", "ts", "v", least=0.9), schema, "dedups")
    want = {r.n: r for r in similarity.mark_duplicates(timed(spark.createDataFrame(rows, schema)), "n", "ts", "v", least=0.9, scope=["scope"]).collect()}
    assert len(got) == 60 and all(r.is_duplicate == want[r.k].is_duplicate and r.dedup_similarity == pytest.approx(want[r.k].dedup_similarity) for r in got)
    limited = run_stream(spark, tmp_path / "b", [rows[:30], rows[30:]], lambda d: stateful.rate_limit_stream(timed(d), "scope", "ts", 1, 300), schema, "limits")
    batch = stateful.rate_limit(timed(spark.createDataFrame(rows, schema)), "scope", "ts", "n", 1, 300).where("accepted").count()
    assert sum(r.accepted for r in limited) == batch
    means = run_stream(spark, tmp_path / "c", [rows[:30], rows[30:]], lambda d: stateful.count_window_stream(d, "scope", "n", "t", 5), schema, "means")
    assert {(r.scope, r.n): r.mean for r in means}[("s0", 30)] == pytest.approx(np.mean([t for n, s, t, _ in rows if s == "s0"][-5:]))


def test_breaker():
    now = [0.0]
    b = CircuitBreaker(failures=2, wait=30, probes=2, clock=lambda: now[0])

    def bad():
        raise ValueError

    for _ in range(2):
        with pytest.raises(ValueError):
            b.call(bad)
    with pytest.raises(CircuitOpen):
        b.call(int)
    now[0] = 31
    assert b.call(int) == 0 and b.state == "half_open" and b.call(int) == 0 and b.state == "closed"
    with pytest.raises(ValueError):
        b.call(bad)
    b.call(int)
    assert b.failed == 0
