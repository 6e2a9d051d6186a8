"""Similarity over embeddings: techniques, near-duplicates in time, novelty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.vector import carried, dot, doubles, unit
from sparkwarden.operators import folds
from sparkwarden.operators.drift import since_reset
from sparkwarden.operators.ordered import chunks, range_of, running

#: Techniques that go along with an event as one array (more make more arrays), and events of a bucket of time that are compared in one task.
CHUNK, PART = 2_000, 2_000
#: Events that novelty goes through in one task, at least.
STRETCH = 16_384
#: Buckets of time and ranges of an order (some 50 bytes each) up to which what is known of them is broadcast, and windows that a bucket spans at most.
FEW, SPAN = 250_000, 64


def top_techniques(events: DataFrame, techniques: DataFrame, key: str, vector: str = "embedding", k: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(key, rank, technique_id, similarity): the k techniques (no, technique_id, vector) of the largest inner product; ties by no.

    Techniques are a small table that goes along with each event and is searched within it, so no pairs are
    emitted; a table of more than ``chunk`` is searched in parts. Events without a vector get no rows; k beyond the table gives all of it.
    """
    near = with_candidates(events.select(key, vector), techniques, vector, k, chunk).where(F.col(vector).isNotNull())
    rows = near.select(key, F.posexplode("candidates"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), "col.technique_id", "col.similarity")


def with_candidates(events: DataFrame, techniques: DataFrame, vector: str = "embedding", k: int = 3, chunk: int = CHUNK) -> DataFrame:
    """events with ``candidates``: the k best techniques as structs (no, technique_id, similarity), best first; null without a vector."""
    out = events.withColumn("_v", doubles(F.col(vector))).withColumn("_near", F.array().cast("array<struct<s:double,no:int,technique_id:string>>"))
    columns = [F.col("no").cast("int").alias("no"), F.col("technique_id"), doubles(F.col("vector")).alias("v")]
    for part in chunks(techniques, columns, chunk):
        scored = F.transform("_all", lambda t: F.struct((-dot(F.col("_v"), t["v"])).alias("s"), t["no"].alias("no"), t["technique_id"].alias("technique_id")))
        out = out.crossJoin(F.broadcast(part.withColumnRenamed("rows", "_all"))).withColumn("_near", F.slice(F.array_sort(F.concat("_near", scored)), 1, k)).drop("_all")  # one row of at most chunk techniques
    best = F.transform("_near", lambda c: F.struct(c["no"].alias("no"), c["technique_id"].alias("technique_id"), (-c["s"]).alias("similarity")))
    return out.withColumn("candidates", F.when(F.col("_v").isNotNull(), best)).drop("_v", "_near")


def _nearest(batches):
    """(_k, _best) of the rows of a unit: the largest inner product with those held that are earlier and not too old. Units come sorted, by time and key within; nothing is put out for pairs."""
    at, kept = None, None
    for batch in batches:
        u = batch.column("_u").to_numpy()
        cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1), len(u)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if u[s] != at:
                at, kept = u[s], None
            for i in range(s, e, folds.ROWS):
                part = batch.slice(i, min(folds.ROWS, e - i))
                k, t, since = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_t", "_from"))
                v = part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1).astype(float, copy=False)
                own = np.flatnonzero(part.column("_held").to_numpy(zero_copy_only=False))
                # Places within the unit's order: those that were held before come first.
                place, new = np.arange(len(k)), (k[own], t[own], v[own])
                if kept is not None:
                    young = kept[1] >= since.min()
                    old = tuple(x[young] for x in kept)
                    kept = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                    before = np.concatenate((np.full(len(old[0]), -1), own))
                else:
                    kept, before = new, own
                k2, t2, v2 = kept
                near = (before[None, :] < place[:, None]) & (t2[None, :] >= since[:, None])
                if (same := near & (t2[None, :] == t[:, None])).any():
                    x, y = np.nonzero(same)
                    near[x, y] = k2[y] < k[x]
                some = near.any(1)
                if some.any():
                    found = np.where(near[some], v[some] @ v2.T, -np.inf).max(1)
                    yield pa.RecordBatch.from_arrays([part.column("_k").filter(pa.array(some)), pa.array(found)], ["_k", "_best"])


def mark_duplicates(
    events: DataFrame, key: str, ts: str, vector: str = "embedding", window_s: int = C.DEDUP_WINDOW_S, least: float = C.DEDUP_SIMILARITY, scope: list[str] | None = None, mode: str = "window", part: int = PART
) -> DataFrame:
    """(key, dedup_similarity, is_duplicate) of each event, as ``nearest_earlier`` finds; 0 where it finds none."""
    best = nearest_earlier(events, key, ts, vector, window_s, scope, mode, part)
    out = events.select(key).join(best, key, "left").withColumn("dedup_similarity", F.coalesce("dedup_similarity", F.lit(0.0)))
    return out.withColumn("is_duplicate", F.col("dedup_similarity") >= least)


def nearest_earlier(events: DataFrame, key: str, ts: str, vector: str = "embedding", window_s: int = C.DEDUP_WINDOW_S, scope: list[str] | None = None, mode: str = "window", part: int = PART) -> DataFrame:
    """(key, dedup_similarity) of events that have one: the largest inner product with an earlier event of the last window_s seconds.

    Earlier: by (ts, key). mode ``lag`` looks back from the event before, as an index that is pruned on insertion does.
    scope: columns within which events are compared; state reaches no further. Buckets of time span as many windows as hold some ``part``
    events, SPAN at most. An event goes to its own bucket, where it is held for later ones and looks back itself, and to the one before if its window
    begins there, so most go one way only and no rows are joined. Buckets of more than ``part`` events are dealt to parts, each of which the event meets.
    A part's vectors are held against those that ask by products of matrices, and only each one's best goes on: there is no row for a pair.
    Null scopes are a scope; events without a vector take no part.
    """
    scope = scope or []
    rows = events.select(*scope, F.col(key).alias("_k"), F.col(ts).cast("timestamp").cast("double").alias("_t"), carried(events, vector)[0].alias("_v"))
    if mode == "lag":
        before = Window.partitionBy(*scope, "_day").orderBy("_t", "_k")
        # The event before is in the same range of time, or the last one of the range before.
        ranged = rows.withColumn("_day", F.floor(F.col("_t") / (64 * window_s)))
        last = ranged.groupBy(*scope, "_day").agg(F.max("_t").alias("_last"))
        last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*scope).orderBy("_day"))).withColumnsRenamed({c: f"_of_{c}" for c in [*scope, "_day"]})
        rows = ranged.join(last, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*scope, "_day"]]).drop(*[f"_of_{c}" for c in [*scope, "_day"]])
        rows = rows.withColumn("_from", F.coalesce(F.lag("_t").over(before), "_last", "_t") - window_s).drop("_day", "_last")
    else:
        rows = rows.withColumn("_from", F.col("_t") - window_s)
    rows = rows.where("_v is not null")
    counted = lambda width: rows.groupBy(*scope, F.floor(F.col("_t") / width).alias("_b")).agg(F.count("*").alias("_n"))
    n, buckets = counted(window_s).agg(F.sum("_n"), F.count("*")).first()
    width = window_s * max(1, min(SPAN, part * buckets // (n or 1)))
    parts = counted(width).where(F.col("_n") > part).select(*[F.col(c).alias(f"_of_{c}") for c in [*scope, "_b"]], F.ceil(F.col("_n") / part).cast("int").alias("_parts"))
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_t") / width)))).withColumn("_held", F.col("_b") == F.floor(F.col("_t") / width))
    if dense := parts.count():
        parts = F.broadcast(parts) if dense <= FEW else parts
        dealt = dealt.join(parts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*scope, "_b"]], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        dealt = dealt.withColumn("_held", F.col("_held") & (F.col("_p") == F.pmod(F.xxhash64("_k"), "_parts")))
    else:
        dealt = dealt.withColumn("_p", F.lit(0))
    dealt = dealt.select(F.xxhash64(*scope, "_b", "_p").alias("_u"), "_held", "_k", "_t", "_from", "_v").repartition("_u").sortWithinPartitions("_u", "_t", "_k")
    kind = dict(rows.dtypes)["_k"]
    return dealt.mapInArrow(_nearest, f"_k {kind}, _best double").groupBy(F.col("_k").alias(key)).agg(F.max("_best").alias("dedup_similarity"))


def novelty(
    events: DataFrame, order: str, vector: str = "embedding", scope: list[str] | None = None, window: int = C.NOVELTY_WINDOW, warmup: int = C.NOVELTY_WARMUP, baseline: int = C.NOVELTY_BASELINE, scale: float = C.NOVELTY_SCALE
) -> DataFrame:
    """(scope, order, novelty_score, baseline_size): how far an event is from the centroid of the ``window`` before it.

    0 until ``warmup`` events have come and the baseline holds ``baseline`` of them. Events are numbered and cut into stretches of
    STRETCH, or of the window if that is longer; each goes through its vectors with a running sum of whole vectors that begins anew with it. Work doesn't
    grow with the window, and a task holds one stretch and the window before it. Numbers are found without the vectors, and which values of the order
    each stretch begins with goes along with the events, so a vector is shuffled once, or twice as one of a window. Events without a vector have no row and no number.
    """
    scope = scope or []
    fold = folds.Novelty(window, warmup, baseline, scale)
    size = max(window, STRETCH)
    known = events.where(F.col(vector).isNotNull())
    within = range_of(known, order)
    numbered = running(known.select(*scope, order), order, {"_n": F.lit(1)}, scope, within).withColumns({"_r": within, "_at": F.floor(F.col("_n") / size)})
    last = F.col("_n") + window >= (F.col("_at") + 1) * size  # of the window before the next stretch
    begun = numbered.groupBy(*scope, "_r", "_at").agg(F.min(order).alias("_b"), F.min(F.when(last, F.col(order))).alias("_c"))
    begun = begun.groupBy(*[F.col(c).alias(f"_of_{c}") for c in [*scope, "_r"]]).agg(F.array_sort(F.collect_list(F.struct("_at", "_b", "_c"))).alias("_begun"))
    if not scope or known.select(*scope, within).distinct().count() <= FEW:
        begun = F.broadcast(begun)
    rows = known.select(*scope, order, carried(events, vector)[0].alias("_v"), within.alias("_r")).join(begun, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*scope, "_r"]])
    rows = rows.withColumn("_s", F.coalesce(F.try_element_at(F.filter("_begun", lambda s: s["_b"] <= F.col(order)), F.lit(-1)), F.get("_begun", F.lit(0))))
    goes = lambda at, own: F.struct(at.alias("_at"), F.lit(own).alias("_own"))
    here, ahead = goes(F.col("_s._at"), True), goes(F.col("_s._at") + 1, False)
    placed = rows.select(*scope, order, "_v", F.explode(F.when(F.col(order) >= F.col("_s._c"), F.array(here, ahead)).otherwise(F.array(here))).alias("_to")).select(*scope, order, "_v", "_to.*")
    dealt = placed.withColumn("_g", F.xxhash64(*scope, "_at")).repartition("_g").sortWithinPartitions("_g", "_own", order)
    names = [*scope, order]

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        n, at = len(t), int(t.column("_at")[0].as_py())
        v = t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float, copy=False)
        own = n - t.column("_own").to_pylist().count(True)
        leaving = np.zeros((n - own, v.shape[1]))
        out = np.arange(own, n) - window
        leaving[out >= 0] = v[out[out >= 0]]
        score, baseline_size, _ = fold.feed(at * size, v[max(0, own - window) : own].sum(0), v[own:], leaving) if own < n else (np.zeros(0), np.zeros(0, np.int64), None)
        kept = t.slice(own)
        return pa.RecordBatch.from_arrays([*(kept.column(c).combine_chunks() for c in names), pa.array(score), pa.array(baseline_size.astype(np.int64))], [*names, "novelty_score", "baseline_size"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            g = batch.column("_g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s < e and held and g[s] != at:
                    yield scored(held)
                    held = []
                if s < e:
                    at = g[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield scored(held)

    kinds = dict(placed.dtypes)
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "novelty_score double", "baseline_size long"]))


def novelty_stats(scored: DataFrame) -> DataFrame:
    """One row of what novelty says of a stream: events, those scored, the mean and the largest score, the size of the last baseline."""
    on = F.col("baseline_size") > 0
    return scored.agg(F.count("*").alias("events"), F.count_if(on).alias("scored"), F.coalesce(F.avg(F.when(on, F.col("novelty_score"))), F.lit(0.0)).alias("mean_score"), F.coalesce(F.max("novelty_score"), F.lit(0.0)).alias("max_score"), F.coalesce(F.max("baseline_size"), F.lit(0)).alias("baseline_size"))


def novelty_since(events: DataFrame, resets: DataFrame, order: str, vector: str = "embedding", scope: list[str] | None = None, **settings) -> DataFrame:
    """novelty of what came after its scope's last reset (scope, at: a value of order): numbers, window and baseline begin anew."""
    return novelty(since_reset(events, resets, order, scope), order, vector, scope, **settings)


def centroid(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by..., centroid): the mean of each group's vectors at length 1."""
    dims = vectors.select(*by, F.posexplode(doubles(F.col(vector))).alias("_d", "_x")).groupBy(*by, "_d").agg(F.avg("_x").alias("_m"))
    gathered = dims.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("centroid"))
    return gathered.withColumn("centroid", unit(F.col("centroid")))
