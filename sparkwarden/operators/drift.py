"""Drift of scores by the population stability index."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.operators import folds
from sparkwarden.operators.ordered import running


def bin_of(score: Column, bins: int = C.DRIFT_BINS) -> Column:
    """Equal bins of [0, 1], the last one closed."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def psi_term(actual: Column, expected: Column) -> Column:
    a, e = F.greatest(actual, F.lit(C.PSI_FLOOR)), F.greatest(expected, F.lit(C.PSI_FLOOR))
    return (a - e) * F.ln(a / e)


def psi(reference: DataFrame, current: DataFrame, score: str = "score", bins: int = C.DRIFT_BINS) -> DataFrame:
    """One row (psi) of two sets of scores."""
    spine = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.partitionBy())
        return counts.select("bin", (F.col("n") / total).alias(name))

    both = spine.join(shares(reference, "e"), "bin", "left").join(shares(current, "a"), "bin", "left").fillna(0.0)
    return both.agg(F.sum(psi_term(F.col("a"), F.col("e"))).alias("psi"))


def drift_checks(
    scores: DataFrame, order: str, score: str = "score", scope: list[str] | None = None, window: int = C.DRIFT_WINDOW, interval: int = C.DRIFT_INTERVAL, bins: int = C.DRIFT_BINS, limit: float = C.DRIFT_LIMIT
) -> DataFrame:
    """(scope, at, psi, drift, edge): checks after each ``interval`` scores of the first ``window`` against the last.

    The first check is at score max(window + 1, interval). edge is ``start`` or ``end`` where the state changes.
    Counts of bins run along the order, so a check needs the sums at its two ends and no pairs of rows.
    """
    scope = scope or []
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    binned = scores.select(*scope, order, bin_of(value, bins).alias("_bin"))
    one = lambda b: F.when(F.col("_bin") == b, 1).otherwise(0)
    rows = running(binned, order, {"at": F.lit(1)} | {f"_c{b}": one(b) for b in range(bins)}, scope)
    rows = rows.select(*scope, (F.col("at") + 1).cast("int").alias("at"), F.array(*[F.col(f"_c{b}") + one(b) for b in range(bins)]).alias("sums"))
    first = max(window + 1, interval)
    checks = rows.where((F.col("at") >= first) & (F.pmod(F.col("at") - first, F.lit(interval)) == 0))
    named = lambda df, prefix: df.withColumnsRenamed({c: f"{prefix}_{c}" for c in [*scope, "at", "sums"]})
    same = lambda prefix: [F.col(c).eqNullSafe(F.col(f"{prefix}_{c}")) for c in scope]
    old, reference = named(rows, "old"), named(rows.where(F.col("at") == window), "first")
    # A check meets one row, at the window's other end, and its scope's first window.
    met = checks.join(old, [*same("old"), F.col("at") == F.col("old_at") + window])
    met = met.join(reference, same("first")) if scope else met.crossJoin(F.broadcast(reference))  # one row
    now = F.zip_with("sums", "old_sums", lambda s, o: (s - o) / F.lit(float(window)))
    expected = F.transform("first_sums", lambda c: c / F.lit(float(window)))
    total = F.aggregate(F.zip_with(now, expected, psi_term), F.lit(0.0), lambda s, x: s + x)
    out = met.select(*scope, "at", total.alias("psi")).withColumn("drift", F.col("psi") > limit)
    before = out.select(*[F.col(c).alias(f"was_{c}") for c in scope], (F.col("at") + interval).alias("was_at"), F.col("drift").alias("was"))
    out = out.join(before, [*same("was"), F.col("at") == F.col("was_at")], "left").withColumn("was", F.coalesce("was", F.lit(False)))
    return out.select(*scope, "at", "psi", "drift", F.when(F.col("drift") & ~F.col("was"), "start").when(~F.col("drift") & F.col("was"), "end").alias("edge"))


def drifting_at(events: DataFrame, checks: DataFrame, seq: str, window: int = C.DRIFT_WINDOW, interval: int = C.DRIFT_INTERVAL) -> DataFrame:
    """events with ``drifting``: the state of the last check before each, by its number in the order; false before the first.

    Checks come at known numbers, so an event meets the one that counts in an equi-join.
    """
    first = max(window + 1, interval)
    last = F.lit(first) + F.floor((F.col(seq) - 1 - first) / interval) * interval
    marks = checks.select(F.col("at").cast("long").alias("_check"), F.col("drift").alias("_drift"))
    joined = events.withColumn("_check", F.when(F.col(seq) > first, last).cast("long")).join(marks, "_check", "left")
    return joined.withColumn("drifting", F.coalesce("_drift", F.lit(False))).drop("_check", "_drift")


def fallback(scores: DataFrame, order: str, first: str, second: str, monitor: folds.Drift = folds.Drift(), scope: str | None = None, reset: str | None = None) -> DataFrame:
    """(order, scope, drifting, final_score, psi, edge): which tier's score counts for each event, where the scores that count are what drift is told from.

    While the last check before an event told of drift its first score counts, else the second one if there is one. psi and edge are null but where a check was made.
    reset: a column that says before which events the monitor starts anew. Each check decides the scores of the next, so a scope is one chain: it is gone through in
    one pass over its sorted rows, of a few numbers each, of which a task holds a batch at a time. Scopes run side by side.
    """
    of = F.lit(None).cast("string") if scope is None else F.col(scope).cast("string")
    rows = scores.select(F.col(order).alias("number"), of.alias("scope"), F.col(first).cast("double").alias("first"), F.col(second).cast("double").alias("second"), (F.lit(False) if reset is None else F.coalesce(F.col(reset), F.lit(False))).alias("reset"))
    sent = rows.repartition("scope").sortWithinPartitions("scope", "number")
    kind = dict(rows.dtypes)["number"]

    def run(batches):
        at, own = object(), None
        for batch in batches:
            name = batch.column("scope").to_pylist()
            cuts = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1]), len(name)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if name[s] != at:
                    at, own = name[s], replace(monitor, reference=None)
                part = batch.slice(s, e - s)
                values = [part.column(c).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("first", "second")]
                final, on, checks = own.feed(*values, part.column("reset").to_numpy(zero_copy_only=False).astype(bool))
                psi, edge = [None] * len(final), [None] * len(final)
                for i, _, value, _, what in checks:
                    psi[i], edge[i] = value, what
                yield pa.RecordBatch.from_arrays(
                    [part.column("number"), part.column("scope"), pa.array(on), pa.array(final), pa.array(psi, pa.float64()), pa.array(edge, pa.string())], ["number", "scope", "drifting", "final_score", "psi", "edge"]
                )

    out = sent.mapInArrow(run, f"number {kind}, scope string, drifting boolean, final_score double, psi double, edge string")
    return out.withColumnRenamed("number", order).drop("scope") if scope is None else out.withColumnsRenamed({"number": order, "scope": scope})


def snapshot(checks: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, checks, last_at, last_psi, drifting, episodes): what a monitor shows, a row for each scope."""
    last = F.max(F.struct("at", "psi", "drift"))
    out = checks.groupBy(*(scope or [])).agg(F.count("*").alias("checks"), last.alias("l"), F.count_if(F.col("edge") == "start").alias("episodes"))
    return out.select(*(scope or []), "checks", F.col("l.at").alias("last_at"), F.col("l.psi").alias("last_psi"), F.col("l.drift").alias("drifting"), "episodes")


def since_reset(scores: DataFrame, resets: DataFrame, order: str, scope: list[str] | None = None) -> DataFrame:
    """Scores after their scope's last reset (scope, at: a value of order): the first ``window`` of them are the new reference."""
    scope = scope or []
    last = resets.groupBy(*scope).agg(F.max("at").alias("_reset"))
    joined = scores.join(last, scope, "left") if scope else scores.crossJoin(F.broadcast(last))  # one row
    return joined.where(F.col("_reset").isNull() | (F.col(order) > F.col("_reset"))).drop("_reset")
