"""Findings of the fourth round: queries on inputs that the given tables don't hold."""

import random
import weakref
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparkwarden.operators import folds, similarity
from sparkwarden.plans import catalogue
from sparkwarden.streaming import cascade as streams
from sparkwarden.streaming import runs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, name, rows):
    """The query's rows and its SQL's over these events (event_id, ts, user_id), in one order."""
    spark.createDataFrame([(n, ts, user, "click", 1.0, '{"k": 1}') for n, ts, user in rows], EVENTS).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(folder))
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    return sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_sessions_end_at_a_gap_of_just_an_hour_and_keep_events_without_a_time(spark, tmp_path):
    start = datetime(2024, 1, 1, 0, 0, 0, 500_000)
    at = lambda s: start + timedelta(seconds=s)
    rows = [(0, at(0), 1), (1, at(3600), 1), (2, at(7199), 1), (3, None, 1), (4, None, 2), (5, at(0), None), (6, at(3599), None)]
    got, want = both(spark, tmp_path, "session_windows", rows)
    assert got == want == [(1, 1704067200, 1), (1, 1704070800, 3), (2, None, 1), (None, 1704067200, 2)]


class Kept:
    """State of one value and of a map, as a processor sees them."""

    def __init__(self):
        self.value, self.map = None, {}
        self.exists, self.get, self.update = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v)
        self.containsKey, self.getValue, self.updateValue, self.removeKey = self.map.__contains__, self.map.__getitem__, self.map.__setitem__, self.map.pop


def signals_of(frames, memory, kind="float"):
    p = streams.Signals(memory, kind=kind)
    p.monitor, p.sums, p.ring = Kept(), Kept(), Kept()
    out = pd.concat([f for frame in frames for f in p.handleInputRows(("all",), iter([frame]) if isinstance(frame, pd.DataFrame) else frame, None)])
    plain = lambda x: (None if x != x else round(x, 9)) if isinstance(x, float) else x
    return [tuple(map(plain, r)) for r in out.drop(columns="vector").itertuples(index=False)], p


def test_a_stream_holds_a_few_rows_of_a_micro_batch_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    n = 6_000
    v = rng.normal(size=(n, 8)).astype(np.float32)
    rows = pd.DataFrame({"number": np.arange(n), "t": np.arange(n) * 7.0, "first": rng.random(n), "second": np.where(np.arange(n) % 7 == 0, np.nan, rng.random(n)), "reset": np.arange(n) == 3_000, "vector": [None if i % 31 == 0 else x for i, x in enumerate(v)], "payload": [f"p{i}" for i in range(n)]})
    memory = streams.Memory(300, folds.Novelty(100, 50, 50), folds.Drift(window=200, interval=50, limit=0.05))
    want, before = signals_of([rows[:2_500], rows[2_500:]], memory)
    order = list(range(n))
    random.Random(3).shuffle(order)
    given, frames_held, bytes_held, base = [], [], [], pa.total_allocated_bytes()

    def frames():
        for s in range(0, n, 100):
            frame = rows.iloc[order[s : s + 100]].reset_index(drop=True)
            given.append(weakref.ref(frame))
            yield frame
            del frame
            frames_held.append(sum(f() is not None for f in given))
            bytes_held.append(pa.total_allocated_bytes() - base)

    monkeypatch.setattr(runs, "RUN", 20_000)
    monkeypatch.setattr(runs, "BLOCK", 32)
    monkeypatch.setattr(runs, "FAN", 4)
    got, after = signals_of([frames()], memory)
    assert [r[0] for r in got] == [f"p{i}" for i in range(n)]
    assert got == want and after.ring.map == before.ring.map
    assert max(frames_held) < 5 and max(bytes_held) < 150_000  # of 60 and of some 470,000


def test_runs_give_nulls_last_and_keep_the_order_of_equals(monkeypatch):
    monkeypatch.setattr(runs, "RUN", 1)
    monkeypatch.setattr(runs, "BLOCK", 3)
    tables = [pa.table({"number": pa.array(x, pa.int64())}) for x in ([5, None, 1], [], [9, 1, 2], [None, 0, 5, 5, 5, 5, 7])]
    found = [x for t in runs.in_order(iter(tables), "number") for x in t.column("number").to_pylist()]
    assert found == [0, 1, 1, 2, 5, 5, 5, 5, 5, 7, 9, None, None]
    assert list(runs.in_order(iter([]), "number")) == []


def shuffled(df):
    """(rows, bytes) that each shuffle of a collected frame has written."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(plan.plan())
        else:
            if name == "Exchange":
                found.append(tuple(plan.metrics().get(m).get().value() for m in ("shuffleRecordsWritten", "dataSize")))
            left += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def vectors(spark, n, dim, step):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[1::5] = v[::5][: len(v[1::5])]  # each fifth's next is a copy of it
    rows = [(i, float(i * step), v[i].tolist() if i % 13 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "n long, s double, embedding array<float>").select("n", F.timestamp_seconds("s").alias("at"), "embedding")
    return df, [(s, None if x is None else np.array(x, np.float32).astype(float)) for _, s, x in rows]


def test_vectors_are_shuffled_about_once_for_duplicates(spark):
    n = 3_000
    df, rows = vectors(spark, n, 32, 7)
    out = similarity.nearest_earlier(df, "n", "at", "embedding")
    got = {r.n: r.dedup_similarity for r in out.collect()}
    for i, (s, v) in enumerate(rows):
        best = [float(v @ w) for t, w in rows[max(0, i - 50) : i] if v is not None and w is not None and t >= s - 300]
        assert (i in got) == bool(best) and (not best or abs(got[i] - max(best)) < 1e-9)
    moved = [x for x in shuffled(out) if x[0] > n / 2 and x[1] > 100 * n]
    assert len(moved) == 1 and moved[0][0] < 1.1 * n and moved[0][1] < 220 * n  # 3 rows of some 330 bytes each before


def test_dense_buckets_meet_in_parts_as_in_one(spark):
    df, _ = vectors(spark, 600, 4, 1)
    for mode in ("window", "lag"):
        told = [sorted((r.n, round(r.dedup_similarity, 9)) for r in similarity.nearest_earlier(df, "n", "at", "embedding", 60, mode=mode, part=part).collect()) for part in (1_000, 7)]
        assert told[0] == told[1] and len(told[0]) > 500


def test_vectors_are_shuffled_about_once_for_novelty(spark, monkeypatch):
    monkeypatch.setattr(similarity, "STRETCH", 500)
    n, small = 3_000, {"window": 60, "warmup": 20, "baseline": 10}
    df, rows = vectors(spark, n, 32, 7)
    out = similarity.novelty(df, "n", **small)
    got = {r.n: (r.novelty_score, r.baseline_size) for r in out.collect()}
    v = np.array([x for _, x in rows if x is not None])
    score, size, _ = folds.Novelty(**small).feed(0, np.zeros(32), v, np.concatenate((np.zeros((60, 32)), v[:-60])))
    want = dict(zip([i for i, (_, x) in enumerate(rows) if x is not None], zip(score, size, strict=True), strict=True))
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in want)
    moved = [x for x in shuffled(out) if x[1] > 100 * n]
    assert len(moved) == 1 and moved[0][0] < 1.2 * n and moved[0][1] < 240 * n  # twice before
    texts = similarity.novelty(df.withColumn("t", F.format_string("%05d", "n")).withColumn("one", F.lit(None).cast("string")), "t", scope=["one"], **small)
    assert {int(r.t): round(r.novelty_score, 9) for r in texts.collect()} == {i: round(x[0], 9) for i, x in got.items()}
