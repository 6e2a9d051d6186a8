import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import interpolation
from sparkwarden.llm.interpolation import BUCKETS, EDGE, UNKNOWN_WEIGHT, deleted_interpolation, score_texts
from sparkwarden.llm.packed import pack, pack_rising, small, unpack, unpack_rising

SCHEMA = "doc_id long, text string, part string, block int"


def words(text):
    return re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</end>"]


def grams(tokens, o):
    padded = ["<begin>"] * (o - 1) + tokens
    return [tuple(padded[i : i + o]) for i in range(len(tokens))]


class Plain:
    """The model by dictionaries. rows: (doc_id, text, training, kept back)."""

    def __init__(self, rows, order):
        self.order = order
        learned = self.count([words(t) for _, t, train, back in rows if train and not back])
        self.all = self.count([words(t) for _, t, train, _ in rows if train])
        self.n, self.v = sum(self.all[0].values()), len(self.all[0])
        self.weights = [[UNKNOWN_WEIGHT] * BUCKETS for _ in range(order)]
        kept = [(g, [grams(w, o)[i] for o in range(1, order + 1)]) for _, t, train, back in rows if train and back for w in [words(t)] for i, g in enumerate(w)]
        self.steps = []
        for _ in range(interpolation.ROUNDS if kept else 0):
            reach, drawn, likely = Counter(), Counter(), 0.0
            for _, g in kept:
                p, parts = self.mix(learned, sum(learned[0].values()), g)
                likely += math.log(p[-1])
                left = 1.0
                for o in range(order - 1, -1, -1):
                    b, part = parts[o]
                    reach[o, b] += left
                    share = left * part / p[o + 1]
                    drawn[o, b] += share
                    left -= share
            self.steps.append(likely / len(kept))
            for o in range(order):
                known = None
                for b in range(1, BUCKETS):
                    if reach[o, b] > 0:
                        known = min(1 - EDGE, max(EDGE, drawn[o, b] / reach[o, b]))
                    self.weights[o][b] = UNKNOWN_WEIGHT if known is None else known
            if len(self.steps) > 1 and self.steps[-1] - self.steps[-2] < interpolation.GAIN:
                break

    def count(self, texts):
        return [Counter(g for w in texts for g in grams(w, o)) for o in range(1, self.order + 1)] + [[Counter(g[:-1] for w in texts for g in grams(w, o)) for o in range(1, self.order + 1)]]

    def mix(self, counts, n, gram):
        p, parts = [1 / (self.v + 1)], []
        for o in range(self.order):
            h = n if o == 0 else counts[-1][o][gram[o][:-1]]
            b = min(BUCKETS - 1, h.bit_length())
            w = self.weights[o][b] if h else 0.0
            part = w * counts[o][gram[o]] / h if h else 0.0
            parts.append((b, part))
            p.append(part + (1 - w) * p[-1])
        return p, parts

    def row(self, text):
        w = words(text)
        known = [self.all[0][g,] for g in w]
        each = [grams(w, o) for o in range(1, self.order + 1)]
        score = sum(math.log10(self.mix(self.all, self.n, [g[i] for g in each])[0][-1]) for i in range(len(w)))
        return len(w), sum(c > 0 for c in known), self.n, sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in known), score


def corpus(n, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "É", "the"]
    common = " ".join(rng.choices(vocab, k=9))
    texts = [" ".join(rng.choices(vocab[: rng.choice([5, 63])], k=rng.randrange(1, 60))) + rng.choice(["", " " + common]) for _ in range(n)]
    return texts + ["", None, " \t\n", "the the the", texts[0], "zz " * 3000]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("size", [40, 1 << 20])
def test_equals_dictionaries(spark, order, size):
    rows = [(i, t, i % 7 != 2, i % 5 == 1) for i, t in enumerate(corpus(150))]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t, _, _ in rows], SCHEMA).repartition(3)
    model = deleted_interpolation(df, F.col("doc_id") % 7 != 2, F.col("doc_id") % 5 == 1, order, size)
    want = Plain(rows, order)
    assert (model.tokens, model.types) == (want.n, want.v) and len(model.steps) == len(want.steps)
    assert np.allclose(model.steps, want.steps, rtol=1e-9) and np.allclose(model.weights[:, 1:], np.array(want.weights)[:, 1:], rtol=1e-7)
    assert all(b >= a - 1e-12 for a, b in zip(model.steps, model.steps[1:], strict=False))  # no round loses
    got = {r.doc_id: r for r in model.scores().collect()}
    assert len(got) == len(rows)
    for i, t, train, _ in rows:
        r, w = got[i], want.row(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train, *w[:3])
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-7)


def test_query_rows_and_repeats(spark):
    texts = corpus(200, 8)
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(3, texts[3], "", 0), (3, "other words", "", 0), (None, "w1 w2", "", 0)]
    got = score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(d), held(d)) for d, *_ in rows)
    learned = Counter(w for d, t, *_ in rows if d is not None and not held(d) for w in words(t))
    assert {r.train_tokens for r in got} == {sum(learned.values())}
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out texts are likelier than by single words


def test_without_training(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = deleted_interpolation(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False), F.lit(None).cast("boolean"), 2)
    assert [tuple(r) for r in nothing.scores().collect()] == [(1, True, 3, 0, 0, 0.0, 0.0)]


def test_packed_arrays():
    for x in (np.array([], np.int64), np.array([-5, 1 << 60, 3]), np.arange(1000)):
        assert (unpack(pack(x)) == x).all()
    for x in (np.array([], np.int64), np.array([0, 255]), np.array([70000, 3]), np.array([1 << 40])):
        assert (unpack(pack(small(x)), np.uint64) == x.astype(np.uint64)).all()
    rising = np.array([3, 3, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (unpack_rising(pack_rising(rising)) == rising).all()
