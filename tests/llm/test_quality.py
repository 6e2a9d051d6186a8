import random
import zlib

import numpy as np
import pyarrow as pa

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.quality import STATS, fires, fit_rules, measure, score_quality, statistics


def text(good, rng):
    w = ["".join(rng.choices("abcdefghij", k=rng.choice([2, 4, 7]))) for _ in range(rng.choice([8, 60, 200]))]
    return " ".join(w) + "." if good else rng.choice([" | ".join(w), " ".join(x + "***" for x in w), " ".join([w[0]] * len(w)), "!! ".join(w).upper()])


def rows(n, rng):
    return [(i, text(i % 4, rng), int(i % 4 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    data = rows(600, rng)
    odd = [(2000, None), (2001, ""), (2002, "x " * 100_000), (None, "a b"), (3, data[3][1])]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in data] + [(*r, "x", 1.0) for r in odd], "doc_id long, text string, words string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    assert np.mean([by[i].predicted == q for i, _, q in data if by[i].held_out]) > 0.97
    assert by[2002].predicted == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5, 0.5]
    assert score_quality(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in score_quality(docs, one).collect())


def test_measures():
    def of(*texts):
        return [dict(zip(STATS, r, strict=True)) for t in tk.slices(pa.array(texts)) for r in measure(t)]

    a, b, c = of("One two two.\nTWO\n\nTwo", None, "a | b | é")
    assert (a["words"], a["lines"], a["distinct"], a["stutter"], a["upper_words"], a["lines_again"]) == (5, 3, 3 / 5, 1 / 5, 1 / 5, 1 / 3)
    assert set(b.values()) == {0} and c["pipe"] == 2 / 5 and c["lone_marks"] == 2 / 5 and c["bytes"] == 10


def test_rules_equal_their_columns():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(STATS)))
    m = fit_rules(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float))
    p = m.bias + fires(x, [r for r, _ in m.rules]) @ np.array([w for _, w in m.rules])
    assert 0 < len(m.rules) <= 60 and np.mean((p > 0) == ((x[:, 0] > 0.5) & (x[:, 3] < 0.4))) > 0.95


def plain_statistics(t):
    """Some of the statistics by plain string work."""
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    n = max(1, len(w))
    sizes = [len(x.encode()) for x in w]
    return {
        "bytes": len((t or "").encode()), "words": len(w), "word_length": sum(sizes) / n, "longest_word": max(sizes, default=0), "lines": len([x for x in (t or "").replace("\r", "\n").split("\n") if x]),
        "distinct": len(set(w)) / n, "stutter": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "bang": (t or "").count("!") / n, "pipe": (t or "").count("|") / n, "short_words": sum(x <= 2 for x in sizes) / n,
    }


def test_statistics_and_rules_match_a_plain_version(spark):
    rng = random.Random(12)
    data = [(i, t) for i, t, _ in rows(60, rng)] + [(100, None), (101, ""), (102, "é ü\n\nx x! | y"), (103, "word " * 30_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in statistics(docs).collect()}
    for i, t in data:
        for name, value in plain_statistics(t).items():
            assert abs(got[i][name] - value) < 1e-9, (i, name)
    x = np.array([[got[i][s] for s in STATS] for i, _ in data])
    model = fit_rules(x, np.array([float(i % 4 > 0) for i, _ in data]))
    assert model.rules
    scores = {r.doc_id: r.score for r in statistics(docs).withColumn("score", model.score()).collect()}
    for i, _ in data:
        z = model.bias + sum(w for rule, w in model.rules if all((got[i][s] > v) if above else (got[i][s] <= v) for s, above, v in rule))
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_a_labelled_id_that_repeats_counts_once(spark):
    rng = random.Random(3)
    data = rows(200, rng)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1, f"another text {k}") for k in range(300)], "doc_id long, text string")
    got = score_quality(docs, spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")).collect()
    assert len(got) == 500 and np.mean([r.predicted == data[r.doc_id][2] for r in got if r.held_out and r.doc_id != 1]) > 0.9
