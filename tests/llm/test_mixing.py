import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm.mixing import mix, pivot


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    return mix(df, **more).collect()


def test_targets_are_met(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.choice([1, 3]) for _ in range(rng.choice([1, 5, 40, 200]))) + "\t\x0b", rng.choice(["big"] * 5 + ["b", "é", "Z", None, "tiny"])) for i in range(1500)]
    rows += [(2000, None, "none"), (2001, " ", "b"), (2002, "", None), (None, "a b", "b"), (None, "a b", "b"), (7, "x y z", "b"), (7, "x y", "b")]
    for more in ({}, {"group": 20, "fan": 3}):
        got = run(spark, rows, **more)
        assert len(got) == len(rows)
        real = {}
        for _, t, s in rows:
            real[s] = real.get(s, 0) + len((t or "").split())
        want = targets(real)
        for s in real:
            own = [r for r in got if r.source == s]
            assert sum(r["size"] for r in own) == real[s] == own[0].source_size
            assert own[0].target == pytest.approx(want[s])
            assert abs(sum(r.taken for r in own) - want[s]) <= 200
            assert all(r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"] for r in own)
        again = run(spark, rows[::-1], **more)
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert run(spark, []) == []
    assert [r.taken for r in run(spark, [(1, None, None)])] == [0]


def test_pivot_keeps_words_and_expectation():
    sizes, parts = [9, 4, 7, 2, 5], [0.3, 0.5, 0.9, 0.2, 0.6]
    total, hits = sum(s * p for s, p in zip(sizes, parts, strict=True)), [0.0] * 5
    for seed in range(4000):
        out, left = pivot(list("abcde"), sizes, parts, seed)
        p = [float(x) for x in out]
        if left:
            p[left[0]] = left[1]
        assert sum(s * x for s, x in zip(sizes, p, strict=True)) == pytest.approx(total)
        hits = [h + x / 4000 for h, x in zip(hits, p, strict=True)]
    assert hits == pytest.approx(parts, abs=0.04)
