"""Monitoring queries over events: counters, rates, histogram quantiles, alerts that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.operators.evaluation import with_percentiles


def batch_report(df: DataFrame, batch: list[str], ts: str) -> DataFrame:
    """One row of batches (rows of equal ``batch``): their number and rows, the mean and the largest size, the longest span in seconds (0.0 without times)."""
    sizes = df.groupBy(*batch).agg(F.count("*").alias("n"), (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))).alias("span"))
    return sizes.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"),
        F.coalesce(F.max("span") / 1e6, F.lit(0.0)).alias("max_span_s"),
    )


def counter(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("value"))


def running_counters(scored: DataFrame) -> DataFrame:
    """One row of totals and averages over what was scored; averages of nothing are 0."""
    n = F.count("*")
    safe = F.greatest(n, F.lit(1))
    flag = lambda c: F.count_if(F.col(c)) if c in scored.columns else F.lit(0).cast("long")
    return scored.agg(
        n.alias("events"), F.count_if(F.col("ai_priority") == "HIGH").alias("high"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("sigma_matched").alias("sigma"),
        flag("score_degraded").alias("degraded"), flag("tier2_used").alias("second_tier"),
        (F.coalesce(F.sum("ai_threat_score"), F.lit(0.0)) / safe).alias("avg_score"), (F.coalesce(F.sum("scoring_latency_ms"), F.lit(0.0)) / safe).alias("avg_latency_ms"),
    )


def priority_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("ai_priority").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, buckets: list[float], labels: list[str] | None = None) -> DataFrame:
    """(labels, le, cumulative) of cumulative buckets, the last one infinite. Rows are counted by bucket first."""
    labels, bounds = labels or [], [*map(float, buckets), float("inf")]
    slot = F.array_position(F.transform(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(value) <= b), F.lit(True))
    counts = df.where(F.col(value).isNotNull()).groupBy(*labels, slot.alias("slot")).agg(F.count("*").alias("c"))
    spread = counts.withColumn("le_no", F.explode(F.sequence(F.lit(1), F.lit(len(bounds)))))
    out = spread.groupBy(*labels, "le_no").agg(F.sum(F.when(F.col("slot") <= F.col("le_no"), F.col("c")).otherwise(0)).alias("cumulative"))
    return out.select(*labels, F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("le_no").cast("int")).alias("le"), "cumulative")


def histogram_quantile(hist: DataFrame, q: float, labels: list[str] | None = None) -> DataFrame:
    """(labels, value): the q-quantile of cumulative buckets, linear inside one; the last finite bound if it lies beyond, null of nothing."""
    labels = labels or []
    order = Window.partitionBy(*labels).orderBy("le")
    whole = Window.partitionBy(*labels)
    rows = hist.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("cumulative").over(order), F.lit(0))).withColumn("total", F.max("cumulative").over(whole))
    rank = F.col("total") * q
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(rank - F.col("before"), (F.col("cumulative") - F.col("before")).cast("double"))
    value = F.when(F.col("total") == 0, F.lit(None)).when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    hit = rows.where((F.col("cumulative") >= rank) & (F.col("before") < rank) | (F.col("total") == 0) & (F.col("le") == float("inf")))
    return hit.groupBy(*labels).agg(F.min(value).alias("value"))


def rate(df: DataFrame, ts: str, window: str, seconds: int, slide: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """(labels, start, end, per_second): events for each second in sliding windows of event time."""
    w = F.window(F.col(ts).cast("timestamp"), window, slide) if slide else F.window(F.col(ts).cast("timestamp"), window)
    counts = df.groupBy(*(labels or []), w.alias("w")).agg(F.count("*").alias("n"))
    return counts.select(*(labels or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def increase(samples: DataFrame, labels: list[str], ts: str, value: str, window_s: int, step_s: int) -> DataFrame:
    """(labels, at, increase, per_second) of counters, at each multiple of step_s (seconds of the epoch) whose last window_s seconds hold two samples and more.

    A value below the one before is a restart from 0. What lies between a window's edges and its samples is filled up at the samples' pace, up to
    1.1 times their mean distance and else by half of it, and never to before the counter was 0. A sample goes to the windows that hold it, so what is
    brought together is a window's samples of one series. Samples without a time or a value are left out.
    """
    t = F.col(ts).cast("timestamp").cast("double")
    rows = samples.select(*labels, t.alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null and _v is not null")
    first = (F.ceil(F.col("_t") / step_s) * step_s).cast("long")
    ends = F.filter(F.sequence(first, (F.floor(F.col("_t") / step_s) * step_s + window_s).cast("long"), F.lit(step_s).cast("long")), lambda e: e < F.col("_t") + window_s)
    placed = rows.where(F.size(ends) > 0).select(*labels, F.explode(ends).alias("at"), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")).alias("x"))
    held = placed.groupBy(*labels, "at").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    n = F.size("xs")
    begin, end = F.get("xs", F.lit(0)), F.element_at("xs", -1)
    lost = F.zip_with(F.slice("xs", F.lit(1), n - 1), F.slice("xs", F.lit(2), n - 1), lambda a, b: F.when(b["v"] < a["v"], a["v"]).otherwise(0.0))
    told = held.withColumns({"_n": n, "_b": begin, "_e": end, "_up": F.aggregate(lost, end["v"] - begin["v"], lambda s, x: s + x), "_span": end["t"] - begin["t"]}).where("_span > 0")
    mean = F.col("_span") / (F.col("_n") - 1)
    edge = lambda gap: F.when(gap < 1.1 * mean, gap).otherwise(mean / 2)
    before = edge(F.col("_b.t") - (F.col("at") - window_s))
    zero = F.when((F.col("_up") > 0) & (F.col("_b.v") >= 0), F.col("_span") * F.col("_b.v") / F.col("_up"))
    whole = F.col("_span") + F.least(before, zero) + edge(F.col("at") - F.col("_e.t"))
    out = told.withColumn("increase", F.col("_up") * whole / F.col("_span"))
    return out.select(*labels, "at", "increase", (F.col("increase") / F.lit(float(window_s))).alias("per_second"))


def ratio(df: DataFrame, part: Column, by: list[str]) -> DataFrame:
    """(by, ratio): the share of rows that part holds for; both sides are summed before they are divided."""
    return df.groupBy(*by).agg((F.count_if(part) / F.count("*")).alias("ratio"))


def error_budget(df: DataFrame, latency: str, limit_ms: float, by: list[str], objective: float = 0.99) -> DataFrame:
    """(by, share, burning): the share of rows within the limit, and whether it misses the objective."""
    return df.groupBy(*by).agg(F.avg((F.col(latency) <= limit_ms).cast("double")).alias("share")).withColumn("burning", F.col("share") < objective)


def latest(df: DataFrame, labels: list[str], ts: str, value: str) -> DataFrame:
    """The instant value of each series."""
    return df.groupBy(*labels).agg(F.max_by(value, ts).alias("value"))


def both(a: DataFrame, b: DataFrame, labels: list[str]) -> DataFrame:
    """Series of a whose labels b has as well."""
    return a.join(b.select(*labels).distinct(), labels, "left_semi")


def holding(evaluations: DataFrame, labels: list[str], ts: str, condition: str, hold_s: int) -> DataFrame:
    """evaluations with ``firing``: the condition has been true at every evaluation since hold_s seconds ago or earlier."""
    order = Window.partitionBy(*labels).orderBy(ts)
    rows = evaluations.withColumn("_ok", F.coalesce(F.col(condition), F.lit(False)))
    rows = rows.withColumn("_island", F.sum((~F.col("_ok")).cast("int")).over(order))
    since = F.min(F.when(F.col("_ok"), F.col(ts))).over(Window.partitionBy(*labels, "_island"))
    held = F.col(ts).cast("timestamp").cast("double") - since.cast("timestamp").cast("double") >= hold_s
    return rows.withColumn("firing", F.col("_ok") & held).drop("_ok", "_island")


def alerts(evaluations: DataFrame, ts: str = "ts", rules: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(alert, ts, active, firing) of each rule; a row of evaluations for each time.

    A rule whose column evaluations hasn't raises, so that a misspelt input switches no alert off: give the rules that are
    meant where inputs are fewer (``alert_rules``).
    """
    out = None
    for name, condition, hold in C.ALERTS if rules is None else rules:
        rows = evaluations.select(F.lit(name).alias("alert"), F.col(ts).alias("ts"), F.expr(condition).alias("active"))
        rows = holding(rows, ["alert"], "ts", "active", hold)
        out = rows if out is None else out.unionByName(rows)
    return out


def alert_rules(*names: str) -> list[tuple[str, str, int]]:
    """The fixed rules of these names; an unknown name raises."""
    known = {r[0]: r for r in C.ALERTS}
    return [known[n] for n in names]


def health(checks: DataFrame, component: str = "component", status: str = "status", good: tuple[str, ...] = ("ok", "loaded", "disabled")) -> DataFrame:
    """One row (healthy, failing): whether every component is well, and the names of those that aren't."""
    ok = F.col(status).isin(*good)
    return checks.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("healthy"), F.array_sort(F.collect_set(F.when(~ok, F.col(component)))).alias("failing"))


def throughput(requests: DataFrame, by: list[str], ok: str, latency: str) -> DataFrame:
    """Requests, errors, error rate and latency percentiles for each endpoint."""
    groups = requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(~F.col(ok)).alias("errors"), (F.count_if(~F.col(ok)) / F.count("*")).alias("error_rate"))
    return with_percentiles(groups, requests, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by)


SCORE_BUCKETS, LATENCY_BUCKETS, BATCH_BUCKETS = C.SCORE_BUCKETS, C.LATENCY_BUCKETS, C.BATCH_BUCKETS
