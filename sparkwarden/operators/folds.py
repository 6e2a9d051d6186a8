"""What is kept of one stream of events, and what it says of the next ones: used by batches over sorted rows and by streams over state."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from sparkwarden.functions import constants as C

#: Rows of vectors that are held against others in one product.
ROWS = 512


def nearest_before(t: np.ndarray, v: np.ndarray, held_t: np.ndarray, held_v: np.ndarray, window_s: float) -> np.ndarray:
    """For each event, in order, its largest inner product with those before it that are at most window_s older; 0 if there are none. held: events before these."""
    best = np.zeros(len(t))
    times, vectors = np.concatenate((held_t, t)), np.concatenate((held_v, v)) if len(held_t) else v
    place = len(held_t) + np.arange(len(t))
    for s in range(0, len(t), ROWS):
        e = min(len(t), s + ROWS)
        near = np.flatnonzero(times[: place[e - 1]] >= t[s:e].min() - window_s)
        if not len(near):
            continue
        sims = v[s:e] @ vectors[near].T
        inside = (near[None, :] < place[s:e, None]) & (times[near][None, :] >= t[s:e, None] - window_s)
        found = np.where(inside, sims, -np.inf).max(1)
        best[s:e] = np.where(inside.any(1), found, 0.0)
    return best


@dataclass(frozen=True)
class Novelty:
    """How far an event is from the centroid of the ``window`` vectors before it; 0 until ``warmup`` have come and ``baseline`` of them are held."""

    window: int = C.NOVELTY_WINDOW
    warmup: int = C.NOVELTY_WARMUP
    baseline: int = C.NOVELTY_BASELINE
    scale: float = C.NOVELTY_SCALE

    def feed(self, n: int, total: np.ndarray, v: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(novelty_score, baseline_size, the next total) of vectors that come after n others. total: the sum of those in the window; leaving: those that go when each comes, zeros for none."""
        steps = np.cumsum(v - leaving, axis=0)
        sums = total + np.concatenate((np.zeros((1, v.shape[1])), steps))
        before = n + np.arange(len(v))
        size = np.minimum(before, self.window)
        means = sums[:-1] / np.maximum(size, 1)[:, None]
        norm = np.sqrt((means * means).sum(1))
        near = np.clip(np.divide((v * means).sum(1), norm, out=np.zeros(len(v)), where=norm > 0), -1.0, 1.0)
        warm = (before >= self.warmup) & (size >= self.baseline)
        return np.where(warm, np.minimum(1.0, (1 - near) * self.scale), 0.0), np.where(warm, size, 0), sums[-1]


@dataclass
class Drift:
    """Checks after each ``interval`` scores of the first ``window`` against the last, by the population stability index.

    The first check is at score max(window + 1, interval). While the last check told of drift, events keep their first tier's score.
    """

    window: int = C.DRIFT_WINDOW
    interval: int = C.DRIFT_INTERVAL
    bins: int = C.DRIFT_BINS
    limit: float = C.DRIFT_LIMIT
    seen: int = 0
    drifting: bool = False
    reference: np.ndarray = None
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))  # bins of the last scores, the window at most

    def __post_init__(self):
        if self.reference is None:
            self.reference = np.zeros(self.bins, np.int64)

    def restart(self) -> None:
        self.seen, self.drifting, self.reference, self.last = 0, False, np.zeros(self.bins, np.int64), np.zeros(0, np.uint8)

    def psi(self) -> float:
        a = np.maximum(np.bincount(self.last, minlength=self.bins) / self.window, C.PSI_FLOOR)
        e = np.maximum(self.reference / self.window, C.PSI_FLOOR)
        return float(((a - e) * np.log(a / e)).sum())

    def feed(self, first: np.ndarray, second: np.ndarray, reset: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float, bool, str | None]]]:
        """(final scores, whether drift was on, checks) of events in order. second: the second tier's scores, NaN for none. reset: events before which the monitor starts anew.

        Checks are (place of the event, its number since the start, psi, drift, edge). What a check finds decides the events after it, and their final scores feed the next check.
        """
        final, on, checks = np.empty(len(first)), np.empty(len(first), bool), []
        begin = max(self.window + 1, self.interval)
        starts = set() if reset is None else set(np.flatnonzero(reset).tolist())
        i = 0
        while i < len(first):
            if i in starts:
                self.restart()
            due = begin if self.seen < begin else begin + ((self.seen - begin) // self.interval + 1) * self.interval
            j = min(len(first), i + due - self.seen, min((s for s in starts if s > i), default=len(first)))
            part = slice(i, j)
            final[part] = np.where(np.isnan(second[part]) | self.drifting, first[part], second[part])
            on[part] = self.drifting
            bins = np.minimum((np.clip(final[part], 0.0, 1.0) * self.bins).astype(np.int64), self.bins - 1).astype(np.uint8)
            if self.seen < self.window:
                self.reference = self.reference + np.bincount(bins[: self.window - self.seen], minlength=self.bins)
            self.last = np.concatenate((self.last, bins))[-self.window :]
            self.seen += j - i
            if self.seen == due:
                psi = self.psi()
                new = psi > self.limit
                checks.append((j - 1, self.seen, psi, new, None if new == self.drifting else "start" if new else "end"))
                self.drifting = new
            i = j
        return final, on, checks
