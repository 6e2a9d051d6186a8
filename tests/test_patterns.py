"""Many patterns at once against trying each, and ordered sums over texts."""

import random
import re
import time

from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions import patterns
from sparkwarden.operators import datasets, features, ordered, rules

PARTS = ["admin", "ad", "min", "10.0.0.", " ", "  ", "the", ".", "é", "É", "login;", "(x)", "\t", "\n", "pass", "word", "-", " ", "ß"]


def texts_of(rng, n):
    return ["".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(n)]


def test_rules_are_as_tried_one_by_one(spark):
    rng = random.Random(3)
    table = []
    for k in range(400):
        value = "".join(rng.choices(PARTS[:12], k=rng.choice([1, 2, 3])))
        table.append((f"r{k % 90}", k % 90, rng.choice(["CommandLine", "Details", "Nowhere"]), rng.choice(["contains", "startswith", "endswith", None, "re"]), value))
    texts = [*texts_of(rng, 300), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    known = spark.createDataFrame(table, rules.RULE_SCHEMA)
    usable = [(r.rule_no, r.rule_id, r.modifier, r.value) for r in rules.usable_values(known).collect()]

    def tried(text):
        if text is None:
            return []
        low = text.lower()
        words = [w.strip(C.WORD_EDGE) for w in re.split(r"[ \t\n\x0b\f\r]+", low)]
        fits = {"contains": lambda v: v in low, "startswith": low.startswith, "endswith": low.endswith, None: lambda v: v in words}
        return [name for _, name in sorted({(no, name) for no, name, m, v in usable if fits[m](v)})]

    for chunk in (37, 100_000):
        got = {r.n: r.sigma_rule_ids for r in rules.match_rules(df, known, chunk=chunk).collect()}
        assert got == {i: tried(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 500


def test_features_are_as_tried_one_by_one(spark):
    rng = random.Random(4)
    names = ["the", "admin+login", "pass word min", "a+b+c+d admin the min", "é", "(x)", "x", "of", "10.0.0. pass admin word the-end"]
    texts = [*texts_of(rng, 200), None]

    def tried(text):
        if text is None:
            return [0.0] * len(names)
        low, out = text.lower(), []
        found = set(re.findall(C.FEATURE_TOKEN, low))
        for phrase, words in features.prepare(names):
            hits = sum((w in low) if len(w) >= 4 else w in found for w in words)
            out.append(float(phrase in low or bool(words) and hits / len(words) >= (0.5 if len(words) <= 3 else 0.65)))
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    got = {r.n: r.v for r in df.select("n", features.feature_vector(F.col("text"), names).alias("v")).collect()}
    assert got == {i: tried(t) for i, t in enumerate(texts)} and any(any(v) for v in got.values())


def test_time_hardly_grows_with_patterns():
    rng = random.Random(5)
    texts = [" ".join("w%d" % rng.randrange(10**6) for _ in range(30)) for _ in range(3000)]
    took = []
    for n in (10, 50_000):
        finder = patterns.Rules([(k, f"r{k}", "contains", "w%06d" % rng.randrange(10**6)) for k in range(n)])
        finder.found("")
        finder.automaton.inside("x")  # built once
        began = time.perf_counter()
        for t in texts:
            finder.found(t)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]  # 5,000 times the patterns


def test_orders_of_texts_run_in_ranges(spark):
    rng = random.Random(6)
    rows = [("k%05d" % rng.randrange(10**5) if i % 50 else None, i, rng.choice("ab")) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, g string")
    place = ordered.range_of(df, "k", rows=200)
    sizes = [r[1] for r in df.groupBy(place).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 800
    wide = spark.range(200_000)
    assert 15 <= wide.groupBy(ordered.range_of(wide, "id", rows=10_000)).count().count() <= 40
    got = {r.i: r.n for r in ordered.running(df, "k", {"n": F.lit(1)}, ["g"], ordered.range_of(df, "k", rows=200), ties=["i"]).collect()}
    seen, want = {}, {}
    for k, i, g in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want


def test_split_shares_by_label(spark):
    rows = [(i, "a" if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, label string")
    got = datasets.stratified_split(df, "label", "k", test=0.1, val=0.1)
    assert got.columns == ["k", "label", "split"]
    n = {(r.label, r.split): r[2] for r in got.groupBy("label", "split").count().collect()}
    assert n == {("a", "test"): 60, ("a", "val"): 54, ("a", "train"): 486, (None, "test"): 30, (None, "val"): 27, (None, "train"): 243}
