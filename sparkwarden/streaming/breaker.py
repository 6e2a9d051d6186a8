"""A circuit breaker for calls out of ``foreachBatch``."""

from __future__ import annotations

import time
from collections.abc import Callable

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class CircuitOpen(RuntimeError):
    pass


class CircuitBreaker:
    """Opens after ``failures``, tries ``probes`` calls after ``wait`` seconds, closes when they succeed. A success takes one failure back."""

    def __init__(self, failures: int = 5, wait: float = 30.0, probes: int = 3, clock: Callable[[], float] = time.monotonic):
        self.most, self.wait, self.probes, self.clock = failures, wait, probes, clock
        self.state, self.failed, self.good, self.opened = CLOSED, 0, 0, 0.0

    def call(self, f: Callable, *args):
        if self.state == OPEN:
            if self.clock() - self.opened < self.wait:
                raise CircuitOpen
            self.state, self.good = HALF_OPEN, 0
        try:
            out = f(*args)
        except Exception:
            self.failed += 1
            if self.state == HALF_OPEN or self.failed >= self.most:
                self.state, self.opened = OPEN, self.clock()
            raise
        if self.state == HALF_OPEN:
            self.good += 1
            if self.good >= self.probes:
                self.state, self.failed = CLOSED, 0
        else:
            self.failed = max(0, self.failed - 1)
        return out
