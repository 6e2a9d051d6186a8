"""Models that are warmed up or refused, checks by category, batches, and parsers of pairs against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import evaluation, metrics, models, registry, similarity
from sparkwarden.operators.normalize import cef_extensions


def broken():
    raise OSError("no file")


def test_preload(spark):
    probes = {"tagger": models.tagger(lambda: lambda texts: [[] for _ in texts])(F.lit("warm-up")), "classifier": models.model_column(broken, "double", "broken")(F.lit("warm-up"))}
    with pytest.raises(Exception, match="no file"):
        models.preload(spark, {"classifier": probes["classifier"]}).collect()
    failing = models.model_column(lambda: lambda items: [1 / 0 for _ in items], "double", "failing")(F.lit("warm-up"))
    got = {r.model: r for r in models.preload(spark, {"tagger": probes["tagger"], "failing": failing}, tasks=3).collect()}
    assert (got["tagger"].answered, got["tagger"].status, got["failing"].answered, got["failing"].status) == (3, "loaded", 0, "failed")
    with pytest.raises(RuntimeError, match="failing"):
        models.preload(spark, {"failing": failing}, strict=True, tasks=2)
    assert models.preload(spark, {}).collect() == []


def test_mismatches(spark):
    entry = "path string, sha256_prefix string"
    wanted = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], entry)
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], entry)
    assert sorted(map(tuple, registry.mismatches(wanted, found).collect())) == [("b", "changed"), ("c", "missing")]
    with pytest.raises(ValueError, match=r"b \(changed\), c \(missing\)"):
        registry.mismatches(wanted, found, strict=True)
    assert registry.mismatches(wanted, wanted, strict=True).collect() == []


def test_checked(spark):
    rows = [("x", True, 1), ("x", False, 2), ("y", None, 3), ("y", False, 4), (None, True, 5)]
    got = {r.id: r for r in evaluation.checked(spark.createDataFrame(rows, "category string, passed boolean, id int"), "category", "passed").collect()}
    assert [(got[i].status, got[i].n, got[i].ratio, got[i].ok) for i in range(1, 6)] == [("pass", 2, 0.5, True), ("fail", 2, 0.5, True), ("fail", 2, 0.0, False), ("fail", 2, 0.0, False), ("pass", 1, 1.0, True)]


def test_positive_class_auc(spark):
    rows = [(1, [0.1, 0.9]), (0, [0.8, 0.2]), (1, [0.6, 0.4]), (0, [0.6, 0.4]), (0, None), (1, [1.0])]
    df = spark.createDataFrame(rows, "label int, p array<double>")
    assert evaluation.positive_class_auc(df, "label", "p").first().roc_auc == pytest.approx(3.5 / 4)
    assert evaluation.positive_class_auc(df.where("label = 1"), "label", "p").first().roc_auc is None


def test_batch_report(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 12.5), ("a", None), (None, 3.0)], "b string, t double").withColumn("ts", F.timestamp_seconds("t"))
    assert tuple(metrics.batch_report(rows, ["b"], "ts").first()) == (2, 4, 2.0, 3, 2.5)
    assert tuple(metrics.batch_report(rows.where("b = 'z'"), ["b"], "ts").first()) == (0, 0, 0.0, 0, 0.0)


def test_novelty_since_a_reset(spark):
    rng = random.Random(2)
    rows = [(i, "s%d" % (i % 2), [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, s string, embedding array<double>")
    resets = spark.createDataFrame([("s0", 20), ("s0", 39)], "s string, at int")
    small = {"window": 10, "warmup": 5, "baseline": 3}
    got = sorted(map(tuple, similarity.novelty_since(df, resets, "i", scope=["s"], **small).collect()))
    assert got == sorted(map(tuple, similarity.novelty(df.where("s = 's1' or i > 39"), "i", scope=["s"], **small).collect()))
    assert len(got) == 100


def test_pairs_of_a_line(spark):
    def plain(s):
        parts = [p for p in re.split(r"(?<!\\)\s+(?=\w+=)", s.strip()) if "=" in p]
        return {k.strip(): v.replace("\\=", "=").replace("\\ ", " ").strip() for k, v in (p.split("=", 1) for p in parts)}

    rng = random.Random(9)
    lines = ["", " ", "no pairs", "a=1 a=2 b=3 a=", "=x", "a==b", " a= b　 ", "a=1\\ b=2 c=\\=\\ ", "a=\x1f"]
    lines += ["".join(rng.choices(["a=", "bc=", " ", "  ", "\\=", "\\ ", "x", "=", "é", "\t"], k=rng.randrange(25))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    for r in df.select("s", cef_extensions(F.col("s")).alias("m")).collect():
        assert r.m == plain(r.s), repr(r.s)
    assert df.limit(1).select(cef_extensions(F.lit(None).cast("string")).alias("m")).first().m is None
