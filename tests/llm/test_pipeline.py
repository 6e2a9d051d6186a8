import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkwarden.llm.mixing import mix


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, base = random.Random(9), tmp_path_factory.mktemp("sf")
    vocab = ["".join(rng.choices("abcdefghijklmno", k=rng.choice([2, 4, 6]))) for _ in range(500)]
    good = lambda n: " ".join(rng.choices(vocab, k=n)) + "."
    bench = [(i, good(30)) for i in range(5)]
    rows = [(i, good(80), "en", "s%d" % (i % 3)) for i in range(160)]
    near = rows[0][1].split()
    near[40] = "changed"
    rows += [(200, rows[1][1], "en", "s0"), (201, " ".join(near), "en", None), (202, good(20) + " " + bench[2][1], "en", "s1"), (203, good(40) + " me@mail.example.com " + good(9), "en", "s1"), (7, rows[7][1], "en", "s1"), (204, None, None, "s1"), (205, "", None, "s1")]
    junk = [(300 + i, "".join(w + "*** " for w in good(60).split()), "en", "s2") for i in range(60)]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows + junk]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 160)] + [(300 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder).cache()
        steps[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns
        if name != "mixing":
            assert docs.count() == len(steps[name]) + (name == "quality")
    clean = set(range(160))
    assert clean <= set(steps["quality"]) and not any(i >= 300 for i in steps["quality"])
    assert {0, 1, 7} <= set(steps["near_dedup"]) and not {200, 201} & set(steps["near_dedup"]) and clean <= set(steps["near_dedup"])
    assert 202 not in steps["decontamination"] and clean <= set(steps["decontamination"])
    assert [203 in steps[n] for n in ("quality", "near_dedup", "decontamination")] == [True] * 3
    assert "<EMAIL>" in steps["pii"][203].text and steps["pii"][203].n_chars == len(steps["pii"][203].text)
    before = spark.createDataFrame(list(steps["pii"].values()), "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.copies for r in mix(before).collect() if r.copies}
    got = dict(docs.groupBy("doc_id").agg(F.count("*")).collect())
    assert got == want


def test_run_agrees_with_its_stages(spark, folder):
    out = cp.run(spark, folder)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"] and out.count() > 100


def test_near_dedup_tells_repeated_ids_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join("w%d" % rng.randrange(9000) for _ in range(60))
    x, y, z, u, v, w = (text() for _ in range(6))
    near = " ".join([*w.split()[:-1], "changed"])
    rows = [(5, x), (2, y), (5, y), (None, z), (None, u), (None, u), (None, x), (8, z), (7, v), (7, v), (7, u), (6, w), (6, near), (9, ""), (9, None), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup_stage(spark, df, "").collect()), key=str)
    of_6 = [t for i, t in got if i == 6]
    assert len(of_6) == 1 and of_6[0] in (w, near)
    want = [(5, x), (2, y), (8, z), (7, u), (7, v), (6, of_6[0]), (9, ""), (9, None), (None, None), (None, None)]
    assert got == sorted(want, key=str)
    apart = spark.createDataFrame([(None, text()) for _ in range(20)], "doc_id long, text string")
    assert cp.near_dedup_stage(spark, apart, "").count() == 20


CLASHES = "kept boolean, copies int, rows int, copy int, row string, _row string, stays boolean, score double, version long, tree string"


def odd_docs(spark):
    rng = random.Random(21)
    good = lambda n: " ".join("w%d" % rng.randrange(9000) for _ in range(n)) + "."
    x, y = good(60), good(60)
    rows = [(1, x, "en", "a"), (2, x, "en", "a"), (2, x, "en", "a"), (None, y, None, None), (None, y, None, None), (None, x, "en", None), (4, None, None, "a"), (5, "", "en", None), (6, " \n\t", "en", "b"), (7, good(30_000), "en", "b"), (8, good(20) + " mail me@x.example.org now " + good(20), "en", "b"), (None, None, None, None)]
    rows = [(*r, len(r[1] or ""), True, 1, 2, 3, "r", "s", False, 0.5, 9, "t") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES), x, y


def test_stages_take_odd_rows_and_clashing_columns(spark, folder, monkeypatch):
    docs, x, y = odd_docs(spark)
    monkeypatch.setattr(cp, "FEW", 0)  # joins by shuffle; the tests above have them by broadcast
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        extra = ["mix_copy"] if name == "mixing" else []
        assert out.columns == docs.columns + extra
        got = out.collect()
        assert {(r.kept, r.copies, r.rows, r.copy, r.row, r["_row"], r.stays, r.score, r.version, r.tree) for r in got} <= {(True, 1, 2, 3, "r", "s", False, 0.5, 9, "t")}
        if name == "near_dedup":
            assert sorted(((r.doc_id, r.text) for r in got if r.text in (x, y)), key=str) == sorted([(1, x), (None, y)], key=str) and len(got) == 8
        if name == "pii":
            assert len(got) == docs.count() and [("<EMAIL>" in r.text) for r in got if r.doc_id == 8] == [True] and {r.n_chars for r in got if r.text is None} == {0}
        if name == "mixing":
            assert not any((r.text or "").strip() == "" for r in got) and got


def test_stages_take_empty_tables(spark, folder):
    docs, _, _ = odd_docs(spark)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_run_leaves_only_the_last_stage(spark, folder):
    import glob

    from sparkwarden.llm.session import shared_dir

    out = cp.run(spark, folder)
    base = out.inputFiles()[0].split("://")[-1].removeprefix("file:").rsplit("/mixing", 1)[0]
    assert base.startswith(shared_dir(spark).removeprefix("file:")) and [p.rsplit("/", 1)[1] for p in glob.glob(f"{base}/*")] == ["mixing"]
