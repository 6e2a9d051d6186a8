import math

import numpy as np
import pytest

from sparkwarden.llm import whitening
from sparkwarden.llm.whitening import column_sums, covariance, fit, fixed_point, transform, whitening_report

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA)


def plain(rows, k=8):
    """By the definition, with whole numbers for what is exact."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * a - s) for a, s in zip(v, sums, strict=True)] for v in x], object)
    centred = y.astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return n, [int((d * d).sum()) for d in y], centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def test_equals_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=11) * np.linspace(1, 3, 11)).tolist()) for i in range(400)] + [(5, [0.5] * 11), (5, [0.5] * 11), (None, [1.0] * 11)]
    bad = [(900, None), (901, [None] + [1.0] * 10), (902, [float("nan")] * 11), (903, [float("inf")] + [0.0] * 10), (904, []), (905, [1.0] * 4)]
    n, deviation, want, explained = plain(rows)
    monkeypatch.setattr(whitening, "TILE_BYTES", 300)  # tiles go on in parts
    x = fixed_point(frame(spark, rows + bad).repartition(6))
    model = fit(x, 8, tile=4)
    assert model.sums.n == n and np.allclose(model.explained, explained, rtol=1e-9)
    got = whitening_report(frame(spark, rows + bad).repartition(6)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and np.allclose([r.explained for r in got], [explained[r.component - 1] for r in got], rtol=1e-9)
    by = {(r.vec_id, r.component): r for r in got if r.vec_id != 5}
    sign = [1 if by[0, c].whitened * want[0, c - 1] > 0 else -1 for c in range(1, 9)]
    for k, (i, _) in enumerate(rows):
        for c in range(1, 9):
            if i != 5:
                assert by[i, c].deviation == deviation[k] and abs(by[i, c].whitened - sign[c - 1] * want[k, c - 1]) < 1e-8
    assert sum(r.vec_id == 5 for r in got) == 24


def test_tiles_are_the_covariance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(50)]
    x = fixed_point(frame(spark, rows))
    sums = column_sums(x)
    m = np.array([r.x for r in x.collect()], float)
    for tile, size in ((3, 100), (7, 1 << 20), (1, 60)):
        assert np.allclose(covariance(x, sums, tile, size), np.cov(m.T, bias=True), rtol=1e-12, atol=1e-6)


def test_nothing_to_whiten(spark):
    assert whitening_report(frame(spark, [])).count() == 0
    assert whitening_report(frame(spark, [(1, None)])).count() == 0
    assert whitening_report(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no spread, no component
    flat = whitening_report(frame(spark, [(i, [float(i), 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].identity_error < 1e-9  # one direction without spread


@pytest.mark.parametrize("size", [1e3, 1e9, 1e12])
def test_large_numbers_stay_exact(spark, size):
    rows = [(i, [float(np.float32((i % 7 - 3) * size)), float(i)]) for i in range(60)]
    got = transform(x := fixed_point(frame(spark, rows)), fit(x)).collect()
    n, deviation, _, _ = plain(rows)
    assert {r.id: int(r.deviation) for r in got} == dict(zip(range(60), deviation, strict=True))
    told = {r.vec_id: r.deviation for r in whitening_report(frame(spark, rows)).collect()}
    assert told == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
