"""Detection metrics: confusion counts, sweeps of thresholds, ranking, percentiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.operators.ordered import running


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _counts(label: Column, positive: Column) -> list[Column]:
    one = label == 1
    return [F.count_if(one & positive).alias("tp"), F.count_if(~one & positive).alias("fp"), F.count_if(~one & ~positive).alias("tn"), F.count_if(one & ~positive).alias("fn")]


def with_rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """precision, recall, f1, false positive, false negative and predicted positive rates of confusion counts; nothing over nothing is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rates = {
        "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall),
        "fpr": fp / F.greatest(fp + tn, F.lit(1)), "fnr": fn / F.greatest(fn + tp, F.lit(1)), "ppr": (tp + fp) / F.greatest(tp + fp + tn + fn, F.lit(1)),
    }
    return counts.withColumns({k: F.round(v, digits) for k, v in rates.items()})


def confusion(df: DataFrame, label: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates where a score from the threshold on is positive."""
    return with_rates(df.groupBy(*(by or [])).agg(*_counts(F.col(label), F.col(score) >= threshold)))


def sweep(df: DataFrame, label: str, score: str, cutoffs: list[float] | None = None) -> DataFrame:
    """A row of counts and rates for each cutoff. Scores are compared as 32-bit floats, as models give them.

    One pass: rows are counted by the number of cutoffs that they reach, and the few counts are added up.
    """
    cutoffs = sorted(C.SWEEP if cutoffs is None else cutoffs)
    s = F.col(score).cast("float").cast("double")
    reached = sum(((s >= c).cast("int") for c in cutoffs), F.lit(0))
    counts = df.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    spine = df.sparkSession.createDataFrame(list(enumerate(cutoffs)), "k int, threshold double")
    over = F.col("reached") > F.col("k")
    sums = spine.join(F.broadcast(counts), how="left", on=F.lit(True)).groupBy("k", "threshold").agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(name) for name, c, cond in (("tp", "p", over), ("fp", "n", over), ("tn", "n", ~over), ("fn", "p", ~over))]
    )
    return with_rates(sums.drop("k"))


def sweep_summary(swept: DataFrame, target_recall: float) -> DataFrame:
    """best_f1_threshold by (f1, precision) and, among those of the recall wanted, target_threshold by (precision, f1); the lowest of equal ones, null if none."""
    low = (-F.col("threshold")).alias("t")
    best = F.max(F.struct("f1", "precision", low))
    target = F.max(F.when(F.col("recall") >= target_recall, F.struct("precision", "f1", low)))
    return swept.agg(best.alias("b"), target.alias("g")).select((-F.col("b.t")).alias("best_f1_threshold"), F.col("b.f1").alias("best_f1"), (-F.col("g.t")).alias("target_threshold"), F.col("g.precision").alias("target_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (roc_auc), exact with ties; null if only one label occurs.

    Scores are counted by value first. Running sums then go over values in ranges: sums of ranges
    are few, so only they are ordered in one place.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    part = counts.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("below", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    parts = part.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.min("s").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before)
    return parts.agg(F.try_divide(F.sum(F.col("wins") + F.col("p") * F.col("before")), (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"))


def false_positive_budget(counts: DataFrame) -> DataFrame:
    """counts with fp_per_1000: false positives for each 1000 benign."""
    return counts.withColumn("fp_per_1000", F.round(1000.0 * F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)), 4))


def linear_percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p): an array of the percentiles of each group, linear between ranks; groups without values have no row.

    Equal values are counted first and their counts run along the order by ranges, so neither a list nor a buffer holds a group's values.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(counts, "_v", {"_from": F.col("_c")}, by)
    sizes = counts.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("_c").alias("_n"))
    rows = ranked.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    place = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c"))
    ends = [F.max(F.when(holds(f(p)), F.col("_v"))).alias(f"_{name}{k}") for k, p in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    between = [F.col(f"_low{k}") + (p - F.floor(p)) * (F.col(f"_high{k}") - F.col(f"_low{k}")) for k, p in enumerate(place)]
    return found.where("_n is not null").select(*by, F.array(*between).alias("p"))


def with_percentiles(groups: DataFrame, df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """groups (a row for each group of df) with a column for each of shares; null without values."""
    by = by or []
    found = linear_percentiles(df, value, list(shares.values()), by).withColumnsRenamed({c: f"_p_{c}" for c in by})
    out = groups.join(found, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in by] if by else F.lit(True), "left")
    return out.withColumns({name: F.get("p", F.lit(k)) for k, name in enumerate(shares)}).drop("p", *[f"_p_{c}" for c in by])


def score_distribution(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median and p95 (linear between ranks); 0 of nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    groups = df.groupBy(*(by or [])).agg(F.count(score).alias("count"), zero(F.avg(score)).alias("mean"))
    out = with_percentiles(groups, df, score, {"median": 0.5, "p95": 0.95}, by)
    return out.withColumns({c: zero(F.col(c)) for c in ("median", "p95")})


def percentile(df: DataFrame, value: str, p: float, kind: str = "linear", by: list[str] | None = None) -> DataFrame:
    """One row for each group: the p-th percentile.

    floor: sorted[min(int(n p / 100), n - 1)]; nearest: sorted[round-half-even(p / 100 (n - 1))]; linear: between
    ranks. All are exact; values are counted first, so no group's values are gathered as a list.
    """
    by = by or []
    if kind == "linear":
        return linear_percentiles(df, value, [p / 100], by).select(*by, F.get("p", F.lit(0)).alias("value"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("c").alias("n"))
    ranked = running(counts, "v", {"before": F.col("c")}, by).withColumn("upto", F.col("before") + F.col("c"))
    rows = ranked.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    at = F.least(F.floor(F.col("n") * F.lit(float(p)) / 100), F.col("n") - 1) if kind == "floor" else F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0)
    return rows.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col("v").alias("value"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("c"))
    whole = Window.partitionBy()
    return counts.select(label, (F.sum("c").over(whole) / (F.count("*").over(whole) * F.greatest(F.col("c"), F.lit(1)))).alias("weight"))


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    return df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("scale_pos_weight"))


def max_abs(df: DataFrame, by: str, value: str, least: float | None = None) -> DataFrame:
    """(by, scale): the largest absolute value of each feature in long form; 0 becomes 1, or all are at least ``least``."""
    top = F.max(F.abs(value))
    return df.groupBy(by).agg((F.greatest(top, F.lit(least)) if least is not None else F.when(top == 0, F.lit(1.0)).otherwise(top)).alias("scale"))


def by_label(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score")).orderBy(label)


def pass_ratio(df: DataFrame, category: str, passed: str, least: float = 0.5) -> DataFrame:
    """(category, n, ratio, ok) of checks by category."""
    out = df.groupBy(category).agg(F.count("*").alias("n"), (F.count_if(F.col(passed)) / F.count("*")).alias("ratio"))
    return out.withColumn("ok", F.col("ratio") >= least)


def checked(df: DataFrame, category: str, passed: str, least: float = 0.5) -> DataFrame:
    """Each check with its status (pass or fail; one that says nothing fails), and the n, ratio and ok of its category."""
    of = pass_ratio(df, category, passed, least).withColumnRenamed(category, "_category")  # a row for each category
    rows = df.withColumn("status", F.when(F.col(passed), "pass").otherwise("fail"))
    return rows.join(of, F.col(category).eqNullSafe(F.col("_category")), "left").drop("_category")


def span_metrics(spans: DataFrame) -> DataFrame:
    """(type, precision, recall, f1) of predicted and true spans: rows (sentence, start, end, type, predicted, actual)."""
    counts = spans.groupBy("type").agg(F.count_if(F.col("predicted") & F.col("actual")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("fp"), F.count_if(~F.col("predicted") & F.col("actual")).alias("fn"))
    return with_rates(counts.withColumn("tn", F.lit(0))).select("type", "precision", "recall", "f1")


def argmax_metrics(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """One row (n, accuracy, mean_confidence) of class probabilities: the largest decides, the first of equal ones."""
    p = F.col(probabilities)
    best = F.array_position(p, F.array_max(p)) - 1
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg((best == F.col(label)).cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.array_max(p)), F.lit(0.0)).alias("mean_confidence"))


def positive_class_auc(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """One row (roc_auc) of two-class probabilities, ranked by that of class 1; rows without it take no part."""
    ranked = df.select(F.col(label).alias("label"), F.try_element_at(F.col(probabilities), F.lit(2)).alias("score"))
    return roc_auc(ranked.where("score is not null"), "label", "score")


def report(metrics: DataFrame) -> DataFrame:
    """One JSON text of a one-row frame, for a report sink."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))
