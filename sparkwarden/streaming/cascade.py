"""The whole scoring plan on a stream: what a batch keeps between events is state here, and both give the same rows.

Events pass rules, the first tier and the second one without state. A stateful operator then goes through each scope's events in order: its drift monitor
says whether the second tier counts, and its ring of vectors says how near the nearest earlier event is and how far the centroid. What follows is without state again.

State is kept in RocksDB. A scope's vectors lie in chunks of CHUNK, so a micro-batch writes the chunks that its own events fill, however long the
windows are, and reads the chunks of the last seconds and those that leave the count window. Sums and the monitor are small and of fixed size.
A scope's rows of a micro-batch are gone through piece by piece, sorted on disk if they are many, so memory holds the windows and a piece, however
much a micro-batch brings; state is written once they are through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkwarden.functions import constants as C
from sparkwarden.functions.vector import carried, clamp, doubles
from sparkwarden.operators import cascade, folds, scoring
from sparkwarden.operators.rules import match_rules
from sparkwarden.sources import brokers
from sparkwarden.streaming import runs

#: Vectors of a chunk of state.
CHUNK = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_SIGNALS = "dedup_similarity double, novelty_score double, baseline_size long, drifting boolean, final_score double, psi double, edge string"


@dataclass(frozen=True)
class Memory:
    """What a scope remembers. None: that signal is off."""

    window_s: float | None = C.DEDUP_WINDOW_S
    novelty: folds.Novelty | None = folds.Novelty()
    drift: folds.Drift | None = None


class _Ring:
    """The vectors that a scope has seen, by number, in chunks of state. Those that a micro-batch fills are written by save, if they are still kept then."""

    def __init__(self, state):
        self.state, self.loaded, self.changed = state, {}, set()

    def chunk(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.loaded:
            found = self.state.getValue((c,)) if self.state.containsKey((c,)) else None
            t = np.array(found[0], float) if found else np.zeros(0)
            self.loaded[c] = t, np.array(found[1], float).reshape(len(t), -1) if len(t) else np.zeros((0, 0))
        return self.loaded[c]

    def span(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Times and vectors number start to end."""
        if start >= end:
            return np.zeros(0), np.zeros((0, 0))
        first = start // CHUNK
        each = [self.chunk(c) for c in range(first, (end - 1) // CHUNK + 1)]
        t, v = (np.concatenate(x) for x in zip(*each, strict=True))
        return t[start - first * CHUNK : end - first * CHUNK], v[start - first * CHUNK : end - first * CHUNK]

    def append(self, n: int, t: np.ndarray, v: np.ndarray) -> None:
        """Vectors from number n on: the last chunk is filled up, new ones follow."""
        done = 0
        while done < len(t):
            c = (n + done) // CHUNK
            take = min(len(t) - done, (c + 1) * CHUNK - n - done)
            old_t, old_v = self.chunk(c) if (n + done) % CHUNK else (np.zeros(0), np.zeros((0, v.shape[1])))
            new = np.concatenate((old_t, t[done : done + take])), np.concatenate((old_v, v[done : done + take]))
            self.loaded[c] = new
            self.changed.add(c)
            done += take

    def forget(self, start: int, end: int) -> None:
        for c in range(start, end):
            self.loaded.pop(c, None)
            self.changed.discard(c)
            if self.state.containsKey((c,)):
                self.state.removeKey((c,))

    def save(self) -> None:
        for c in sorted(self.changed):
            t, v = self.loaded[c]
            self.state.updateValue((c,), (t.tolist(), v.ravel().tolist()))


class Signals(StatefulProcessor):
    """Rows (number, t, first, second, reset, vector, payload) of a scope in order of number; gives payload, vector and _SIGNALS. kind: the type of a vector's values."""

    def __init__(self, memory: Memory, ttl_ms: int | None = None, kind: str = "double"):
        self.memory, self.ttl_ms, self.kind = memory, ttl_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.monitor = handle.getValueState("monitor", "seen long, drifting boolean, reference array<long>, last binary", self.ttl_ms)
        self.sums = handle.getValueState("sums", "n long, total array<double>, oldest long, recent long", self.ttl_ms)
        self.ring = handle.getMapState("ring", "chunk long", "t array<double>, flat array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number = pa.float64() if self.kind == "double" else pa.float32()
        schema = pa.schema({"number": pa.int64(), "t": pa.float64(), "first": pa.float64(), "second": pa.float64(), "reset": pa.bool_(), "vector": pa.list_(number), "payload": pa.string()})
        monitor, ring = self._monitor(), _Ring(self.ring)
        sums = self.sums.get() if self.sums.exists() else None
        for piece in runs.in_order((pa.Table.from_pandas(f, schema, preserve_index=False) for f in rows), "number"):
            f = piece.to_pandas()
            out = pd.DataFrame({"payload": f["payload"], "vector": f["vector"]})
            (out["dedup_similarity"], out["novelty_score"], out["baseline_size"]), sums = self._vectors(f, ring, sums)
            out["drifting"], out["final_score"], out["psi"], out["edge"] = self._drift(f, monitor)
            yield out
        ring.save()
        if sums is not None:
            n, total, oldest, recent = sums
            self.sums.update((int(n), [float(x) for x in total], int(oldest), int(recent)))
        if monitor is not None:
            self.monitor.update((int(monitor.seen), bool(monitor.drifting), [int(x) for x in monitor.reference], monitor.last.tobytes()))

    def close(self) -> None:
        pass

    def _monitor(self) -> folds.Drift | None:
        if self.memory.drift is None:
            return None
        monitor = replace(self.memory.drift, reference=None)
        if self.monitor.exists():
            seen, drifting, reference, last = self.monitor.get()
            monitor = replace(monitor, seen=seen, drifting=drifting, reference=np.array(reference, np.int64), last=np.frombuffer(bytes(last), np.uint8))
        return monitor

    def _drift(self, f: pd.DataFrame, monitor: folds.Drift | None) -> tuple:
        first, second = f["first"].to_numpy(float), f["second"].to_numpy(float)
        psi, edge = np.full(len(f), np.nan), np.full(len(f), None, object)
        if monitor is None:
            return False, np.where(np.isnan(second), first, second), None, None
        final, on, checks = monitor.feed(first, second, f["reset"].to_numpy(bool))
        for at, _, value, _, what in checks:
            psi[at], edge[at] = value, what
        return on, final, pd.Series(psi, dtype=object).where(~np.isnan(psi), None), edge

    def _vectors(self, f: pd.DataFrame, ring: _Ring, sums: tuple | None) -> tuple[tuple, tuple | None]:
        near, far, size = np.full(len(f), np.nan), np.zeros(len(f)), np.zeros(len(f), np.int64)
        own = np.flatnonzero(f["vector"].notna().to_numpy())
        if not len(own):
            return (pd.Series(near, dtype=object).where(~np.isnan(near), None), far, size), sums
        v, t = np.array(f["vector"].iloc[own].tolist(), float), f["t"].to_numpy(float)[own]
        n, total, oldest, recent = (0, np.zeros(v.shape[1]), 0, 0) if sums is None else sums
        total = np.array(total, float)
        if self.memory.window_s is not None:
            held_t, held_v = ring.span(recent * CHUNK, n)
            best = folds.nearest_before(t, v, held_t, held_v, self.memory.window_s)
            newest = np.fmax.accumulate(np.concatenate(([-np.inf], held_t, t)))[len(held_t) : -1]  # of those before each
            near[own] = np.where(newest >= t - self.memory.window_s, best, np.nan)
        if self.memory.novelty is not None:
            window = self.memory.novelty.window
            _, old = ring.span(max(0, n - window), min(n, max(0, n + len(v) - window)))
            leaving = np.zeros_like(v)
            at = n + np.arange(len(v)) - window  # the numbers of those that leave
            gone = (at >= 0) & (at < n)
            if gone.any():
                leaving[gone] = old[: gone.sum()]
            leaving[at >= n] = v[at[at >= n] - n]
            far[own], size[own], total = self.memory.novelty.feed(n, total, v, leaving)
        ring.append(n, t, v)
        n += len(v)
        if self.memory.window_s is not None:
            while (recent + 1) * CHUNK <= n and ring.chunk(recent)[0].max(initial=-np.inf) < t.max() - self.memory.window_s:
                recent += 1
        else:
            recent = n // CHUNK
        kept = recent if self.memory.novelty is None else min(recent, max(0, n - self.memory.novelty.window) // CHUNK)
        ring.forget(oldest, kept)
        return (pd.Series(near, dtype=object).where(~np.isnan(near), None), far, size), (n, total, kept, recent)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Queries of this module need this state store; it counts for queries that start after it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def remembered(rows: DataFrame, order: str, ts: str, memory: Memory, vector: str = "embedding", scope: str | None = None, first: str | None = None, second: str | None = None, reset: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """rows of a stream with dedup_similarity (null without an earlier event), novelty_score, baseline_size, drifting, final_score, and psi and edge where a check was made.

    scope: events of one value (null is one too) share their memory, and all do without it; scopes are what runs in parallel. Events of a micro-batch are taken in
    ``order``, after those of the batches before, so a stream that brings them in order gives a batch's rows. first, second: columns of both tiers'
    scores. reset: a column that says before which events the monitor starts anew. idle_ms: state of a scope that has been silent so long goes.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    others = [c for c in rows.columns if c != vector]
    number = lambda c: F.lit(None).cast("double") if c is None else F.col(c).cast("double")
    v, kind = carried(rows, vector) if vector in rows.columns else (F.lit(None).cast("array<double>"), "double")
    packed = rows.select(
        (F.lit("all") if scope is None else F.concat(F.lit("="), F.col(scope).cast("string"))).alias("scope"), F.col(order).cast("long").alias("number"), F.col(ts).cast("timestamp").cast("double").alias("t"), number(first).alias("first"),
        number(second).alias("second"), (F.lit(False) if reset is None else F.coalesce(F.col(reset), F.lit(False))).alias("reset"), v.alias("vector"), F.to_json(F.struct(*others), _TIMES).alias("payload"),
    ).fillna("none", ["scope"])
    mode = "None" if idle_ms is None else "ProcessingTime"
    out = packed.groupBy("scope").transformWithStateInPandas(statefulProcessor=Signals(memory, idle_ms, kind), outputStructType=f"payload string, vector array<{kind}>, {_SIGNALS}", outputMode="Append", timeMode=mode)
    back = F.from_json("payload", rows.select(*others).schema, _TIMES)
    out = out.withColumn("_row", back).select("_row.*", *([doubles(F.col("vector")).alias(vector)] if vector in rows.columns else []), *[s.split()[0] for s in _SIGNALS.split(", ")])
    return out


def score_stream(
    events: DataFrame, order: str, ts: str, m: cascade.Models, rules: DataFrame, techniques: DataFrame, vector: str = "embedding", scope: str | None = None, memory: Memory = Memory(), reset: str | None = None, idle_ms: int | None = None
) -> DataFrame:
    """The streaming form of ``cascade.score_events``, with drift as ``memory.drift`` says: normalised events to every signal, score, priority and confidence.

    While the last check before an event told of drift, the second tier's score doesn't count for it; what counts is what the monitor sees next.
    """
    rows = cascade.first_tier(match_rules(events, rules), m)
    inside = scoring.in_band(rows, m.band)
    if m.second is None:
        rows = rows.withColumn("_second", F.lit(None).cast("double"))
    elif m.split:
        rows = scoring.cascade(rows, inside, lambda part: part.withColumn("_second", clamp(m.second(part))))
    else:
        rows = rows.withColumn("_second", F.when(inside, clamp(m.second(rows))))
    rows = remembered(rows, order, ts, memory, vector, scope, "classifier_score", "_second", reset, idle_ms)
    used = F.col("_second").isNotNull() & ~F.col("drifting")
    rows = rows.withColumns({"tier2_used": used, "tier2_score": F.when(used, F.col("_second")), "classifier_score": F.col("final_score")}).drop("_second", "final_score")
    return scoring.score(cascade.third_tier(rows, vector, techniques, m))


def start_scoring(scored: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, name: str | None = None) -> StreamingQuery:
    """Runs ``score_stream``'s rows into sink(batch, number), at least once: a sink that keeps the batch's number, or inserts by reference, takes no row twice."""
    writer = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


def in_turn(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One sink of several, each after the one before has taken the batch; the batch is worked out once."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return run


def published(write: Callable[[DataFrame], None], headers: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that gives the scored topic's records (topic, key, value, headers) of a batch to write, such as ``lambda r: r.write.format("kafka").options(...).save()``. Comes after the sink of the events themselves."""
    return lambda batch, number: write(brokers.scored_records(batch, headers))


def novelty_stream(events: DataFrame, order: str, ts: str, vector: str = "embedding", scope: str | None = None, novelty: folds.Novelty = folds.Novelty(), idle_ms: int | None = None) -> DataFrame:
    """events of a stream with novelty_score and baseline_size, as ``similarity.novelty`` gives them."""
    out = remembered(events, order, ts, Memory(None, novelty, None), vector, scope, idle_ms=idle_ms)
    return out.drop("dedup_similarity", "drifting", "final_score", "psi", "edge")


def drift_stream(scores: DataFrame, order: str, ts: str, first: str, second: str | None = None, drift: folds.Drift = folds.Drift(), scope: str | None = None, reset: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """scores of a stream with drifting and final_score, and psi and edge where a check was made, as ``drift.fallback`` gives them."""
    out = remembered(scores, order, ts, Memory(None, None, drift), "", scope, first, second, reset, idle_ms)
    return out.drop("dedup_similarity", "novelty_score", "baseline_size")


def duplicates_stream(events: DataFrame, order: str, ts: str, vector: str = "embedding", scope: str | None = None, window_s: float = C.DEDUP_WINDOW_S, least: float = C.DEDUP_SIMILARITY, idle_ms: int | None = None) -> DataFrame:
    """events of a stream with dedup_similarity and is_duplicate, as ``similarity.mark_duplicates`` gives them."""
    out = remembered(events, order, ts, Memory(window_s, None, None), vector, scope, idle_ms=idle_ms).drop("novelty_score", "baseline_size", "drifting", "final_score", "psi", "edge")
    near: Column = F.coalesce("dedup_similarity", F.lit(0.0))
    return out.withColumn("is_duplicate", near >= least).withColumn("dedup_similarity", near)
