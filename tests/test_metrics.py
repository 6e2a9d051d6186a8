"""Sketches within their bounds, counters with restarts, percentiles by counts: all against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.operators import datasets, evaluation, metrics, sketches


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1_700_000_000 + rng.randrange(9 * 86_400), rng.choice(["a", "b", None]), "u%d" % rng.randrange(20_000) if rng.random() < 0.9 else None, rng.lognormvariate(0, 2) if rng.random() < 0.9 else None) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "t long, label string, user string, x double").withColumn("ts", F.timestamp_seconds("t"))
    sketches.daily(df, "ts", ["label"], F.col("user"), F.col("x")).write.parquet(str(tmp_path / "days"))  # kept as a table
    days = spark.read.parquet(str(tmp_path / "days"))
    shares = [0.01, 0.5, 0.95, 0.999]
    for r in sketches.estimates(sketches.merged(days, ["label"]), shares).collect():
        mine = [x for x in rows if x[1] == r.label]
        exact, values = len({u for _, _, u, _ in mine if u is not None}), np.sort([x for *_, x in mine if x is not None])
        assert r.rows == len(mine) and r.n_values == len(values) and abs(r.n_distinct - exact) <= sketches.distinct_error() * exact
        for share, q in zip(shares, r.quantiles, strict=True):
            low, high = np.searchsorted(values, q, "left") / len(values), np.searchsorted(values, q, "right") / len(values)
            assert low - sketches.rank_error() <= share <= high + sketches.rank_error()
    empty = sketches.estimates(sketches.daily(df.where("user is null and x is null").limit(1), "ts", [], F.col("user"), F.col("x")), [0.5]).collect()
    assert all((r.n_distinct, r.n_values, r.quantiles) == (0, 0, None) for r in empty)


def plain_increase(samples, window, step):
    out = {}
    for at in range(int(min(t for t, _ in samples)) // step * step, int(max(t for t, _ in samples)) + 2 * window, step):
        xs = sorted((t, v) for t, v in samples if at - window < t <= at)
        if len(xs) < 2 or xs[0][0] == xs[-1][0]:
            continue
        up = xs[-1][1] - xs[0][1] + sum(a[1] for a, b in zip(xs, xs[1:], strict=False) if b[1] < a[1])
        span = xs[-1][0] - xs[0][0]
        mean = span / (len(xs) - 1)
        before, after = xs[0][0] - (at - window), at - xs[-1][0]
        before = before if before < 1.1 * mean else mean / 2
        after = after if after < 1.1 * mean else mean / 2
        if up > 0 and xs[0][1] >= 0:
            before = min(before, span * xs[0][1] / up)
        out[at] = up * (span + before + after) / span
    return out


def test_increase_with_restarts_and_gaps(spark):
    rng, rows = random.Random(5), []
    for series in ("a", "b", None):
        t, v = 1_700_000_000.0, rng.randrange(50)
        for _ in range(120):
            t += rng.choice([10, 15, 15, 15, 300])
            v = rng.randrange(3) if rng.random() < 0.05 else v + rng.randrange(6)
            rows.append((series, t, float(v)))
    rows.append(("once", 1_700_000_000.0, 4.0))
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 1.7e9, None)], "series string, t double, v double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.series, r.at): r for r in metrics.increase(df, ["series"], "ts", "v", 300, 60).collect()}
    want = {(s, at): x for s in ("a", "b", None) for at, x in plain_increase([(t, v) for n, t, v in rows if n == s], 300, 60).items()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(math.isclose(got[k].increase, x, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[k].per_second, x / 300, rel_tol=1e-9, abs_tol=1e-12) for k, x in want.items())


def test_percentiles_by_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(30)), rng.random()])) for _ in range(700)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    of = lambda g: [x for h, x in rows if h == g and x is not None]
    got = {r.g: r for r in evaluation.score_distribution(df, "x", ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert np.allclose([got[g].median, got[g].p95], np.percentile(of(g), [50, 95])) and got[g]["count"] == len(of(g))
    assert tuple(got["none"])[1:] == (0, 0.0, 0.0, 0.0)
    whole = sorted(x for _, x in rows if x is not None)
    assert np.isclose(evaluation.percentile(df, "x", 37.5).first()[0], np.percentile(whole, 37.5))
    assert evaluation.percentile(df, "x", 90, "floor").first()[0] == whole[min(int(len(whole) * 90 / 100), len(whole) - 1)]
    nothing = evaluation.score_distribution(df.limit(0), "x").collect()
    assert [tuple(r) for r in nothing] == [(0, 0.0, 0.0, 0.0)]


def test_sentences_run_over_a_file(spark):
    lines = ["a\tB-X", "b\tO", "", "c\tQ", "", "", "d", "e\tI-X"]
    df = spark.createDataFrame([(f, i, x) for f in ("f", "g") for i, x in enumerate(lines)], "file string, line_no long, value string")
    got = sorted((r.file, r.sentence, r.tokens, r.labels) for r in datasets.sentences(df, ["B-X", "I-X"]).collect())
    want = [(0, ["a", "b"], ["B-X", "O"]), (1, ["c"], ["O"]), (3, ["d", "e"], ["O", "I-X"])]
    assert got == [(f, *w) for f in ("f", "g") for w in want]
