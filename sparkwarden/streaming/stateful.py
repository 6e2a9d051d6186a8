"""Streaming operators with state, each with the meaning of its batch form."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkwarden.functions import constants as C
from sparkwarden.streaming.cascade import duplicates_stream

#: A usual time (milliseconds) after which the state of a silent key may go, for ``idle_ms``. Timeouts keep a query running, so bounded runs leave them out.
IDLE_MS = 3_600_000


def accept(times: list[float], kept: deque, limit: int, seconds: float, closed: bool = True) -> list[bool]:
    """Which of the times, in order, a limit of ``limit`` accepted ones for each ``seconds`` takes; kept: the accepted times that still count.
    closed: one exactly that old still counts. No limit (0 or less) takes all. Each time is put in and taken out once."""
    out = []
    for t in times:
        while kept and (kept[0] < t - seconds if closed else kept[0] <= t - seconds):
            kept.popleft()
        out.append(limit <= 0 or len(kept) < limit)
        if out[-1] and limit > 0:
            kept.append(t)
    return out


def rate_limit(events: DataFrame, client: str, ts: str, order: str, limit: int, seconds: float = 60.0, closed: bool = True) -> DataFrame:
    """(client, order, accepted) in batch. What is rejected isn't recorded, so each decision rests on those before: a fold for each client, a batch of rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, deque()
        for f in frames:
            taken, clients = [], f["client"].to_numpy()
            cuts = [0, *(np.flatnonzero(clients[1:] != clients[:-1]) + 1), len(f)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s < e and clients[s] != at:
                    at, kept = clients[s], deque()
                taken += accept(f["t"].iloc[s:e].tolist(), kept, limit, seconds, closed)
            yield pd.DataFrame({"client": f["client"], "n": f["n"], "accepted": taken})

    rows = events.selectExpr(f"CAST(`{client}` AS STRING) AS client", f"CAST(CAST(`{ts}` AS TIMESTAMP) AS DOUBLE) AS t", f"CAST(`{order}` AS BIGINT) AS n")
    sent = rows.repartition("client").sortWithinPartitions("client", "t", "n")
    return sent.mapInPandas(run, "client string, n long, accepted boolean").withColumnsRenamed({"n": order})


def _expired(state: GroupState, idle_ms: int | None) -> bool:
    """Whether a key has been silent so long that its state goes; else its time starts anew with the next update."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def _keep(state: GroupState, value: tuple, idle_ms: int | None) -> None:
    state.update(value)
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def rate_limit_stream(events: DataFrame, client: str, ts: str, limit: int, seconds: float = 60.0, idle_ms: int | None = None) -> DataFrame:
    """(client, t, accepted) of a stream; state is the accepted times of the last seconds, and goes when a client is idle. idle_ms should be far longer than the window."""

    def run(key, frames, state: GroupState):
        if _expired(state, idle_ms):
            return
        kept = deque(state.get[0]) if state.exists else deque()
        times = sorted(t for f in frames for t in f["t"])
        ok = accept(times, kept, limit, seconds)
        _keep(state, (list(kept),), idle_ms)
        yield pd.DataFrame({"client": key[0], "t": times, "accepted": ok})

    rows = events.selectExpr(f"CAST(`{client}` AS STRING) AS client", f"CAST(CAST(`{ts}` AS TIMESTAMP) AS DOUBLE) AS t")
    return rows.groupBy("client").applyInPandasWithState(run, "client string, t double, accepted boolean", "kept array<double>", "append", _timeout(idle_ms))


def dedup_stream(events: DataFrame, scope: str, key: str, ts: str, vector: str, window_s: float = C.DEDUP_WINDOW_S, least: float = C.DEDUP_SIMILARITY, idle_ms: int | None = None) -> DataFrame:
    """(scope, k, dedup_similarity, is_duplicate) of a stream: each event against those of its scope within the window, in order of key. Duplicates enter the window as well. State of an idle scope goes."""
    out = duplicates_stream(events.select(scope, key, ts, vector), key, ts, vector, scope, window_s, least, idle_ms)
    return out.select(F.col(scope).cast("string").alias("scope"), F.col(key).cast("long").alias("k"), "dedup_similarity", "is_duplicate")


def count_window_stream(events: DataFrame, scope: str, order: str, value: str, size: int, idle_ms: int | None = None) -> DataFrame:
    """(scope, n, mean) of a stream: after each value the mean of the last ``size`` of its scope, as monitors keep. A count window has no end in
    time, so state stays unless idle_ms says when an idle scope starts anew."""

    def run(group, frames, state: GroupState):
        if _expired(state, idle_ms):
            return
        seen, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        f = pd.concat(list(frames)).sort_values("o")
        out = []
        held, total = deque(kept), float(np.sum(kept))
        for x in f["x"]:
            held.append(x)
            total += x
            if len(held) > size:
                total -= held.popleft()
            seen += 1
            out.append((group[0], seen, total / len(held)))
        _keep(state, (seen, list(held)), idle_ms)
        yield pd.DataFrame(out, columns=["scope", "n", "mean"])

    rows = events.selectExpr(f"CAST(`{scope}` AS STRING) AS scope", f"CAST(`{order}` AS BIGINT) AS o", f"CAST(`{value}` AS DOUBLE) AS x")
    return rows.groupBy("scope").applyInPandasWithState(run, "scope string, n long, mean double", "seen long, kept array<double>", "append", _timeout(idle_ms))
