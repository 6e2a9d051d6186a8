import numpy as np

from sparkwarden.llm.ann import Index, search, traverse


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-float(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in good if j != i)[:k]
            out[i] = [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    out = {}
    for r in search(df, **more).collect():
        out.setdefault(r.query_id, []).append(tuple(r))
    return {q: sorted(v, key=lambda r: r[1]) for q, v in out.items()}


def data(n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_whole_share_is_exact(spark):
    rows = data(400) + [(1000 + i, data(5)[4][1]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] + [1.0] * 15), (None, [1.0] * 16), (2100, [])]
    got = run(spark, rows, sure=1.0, shard=100, block=7)
    assert got == brute(rows, 20, 20)


def test_recall(spark):
    rows = data(3000)
    got, want = run(spark, rows), brute(rows, 20, 20)
    hits = [len({r[2] for r in got[q]} & {r[2] for r in want[q]}) / 20 for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.9


def test_few_and_none(spark):
    assert run(spark, []) == {}
    rows = [(0, [1.0, 2.0]), (20, [2.0, 0.5]), (20, [2.0, 0.5]), (3, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows[:2] + rows[3:], 20, 20)
    assert run(spark, [(0, [1.0, 2.0])]) == {}


def test_traverse_goes_by_the_sum():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    got = traverse(a, b, np.ones((6, 5), int), 30)
    sums = [a[i] + b[j] for i, j in got]
    assert len(got) == 30 and sums == sorted(sums, reverse=True)


def test_clusters_need_few_cells():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(200, 16))
    x = centers[rng.integers(200, size=20_000)] + 0.05 * rng.normal(size=(20_000, 16))
    index = Index(x[:5_000], 35)
    index.counts = np.bincount(index.cell(x), minlength=index.counts.size).reshape(index.counts.shape)
    seen, hits = [], []
    for q in x[:60]:
        cells = index.cells(q, 20, 0.95)
        inside = np.isin(index.cell(x), [i * len(index.b) + j for i, j in cells])
        seen.append(inside.mean())
        hits.append(inside[np.argsort(-(x @ q))[1:21]].mean())
    assert np.mean(hits) >= 0.9 and np.mean(seen) < 0.15


def test_one_full_cell_goes_over_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, float(rng.random()), 0.5, 1.0]) for i in range(300)] + [(900 + i, rng.normal(size=4).tolist()) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got, want = run(spark, rows, sure=1.0, shard=40, block=5), brute(rows, 20, 20)
    assert {q: [r[2] for r in v] for q, v in got.items()} == {q: [r[2] for r in v] for q, v in want.items()}


def test_shorter_vectors_count_as_filled_up(spark):
    rows = data(200) + [(1000 + i, v[:9]) for i, v in data(80, 5)]
    filled = [(i, v + [0.0] * (16 - len(v))) for i, v in rows]
    assert run(spark, rows, sure=1.0) == brute(filled, 20, 20)
