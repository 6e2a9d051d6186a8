import random
import zlib

import numpy as np

from sparkwarden.llm import language_id
from sparkwarden.llm.grams import WIDTH
from sparkwarden.llm.language_id import codewords, decode, fit, identify, predict

SYLLABLES = {"xa": ["the", "ing", "and", "wh"], "xb": ["eau", "è", "oi", "ment"], "xc": ["sch", "ung", "ü", "ein"], "xd": ["ción", "ado", "rr", "ñ"]}


def made(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, made(lang, rng, rng.choice([5, 50])), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 .!… ☺", "xb"), (1003, "中文", None), (None, "the and", "xa"), (1004, "the " * 50_000, "xa")]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows + odd], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.98
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in SYLLABLES and got[1004].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == ["und"]
    assert [r.lang_pred for r in identify(spark.createDataFrame([(i, "abc", "q") for i in range(5)], schema)).collect()] == ["q"] * 5


def test_codes_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = codewords(n)
        d = (code[:, None] != code[None]).sum(2) + 1000 * np.eye(n)
        assert d.min() >= (code.shape[1] / 2 if n <= 5 else 5)
        best, sure = decode(5.0 * code, code)
        assert (best == np.arange(n)).all() and (sure > 0.5).all()
        if n == 40:
            flipped = code.copy()
            flipped[:, :2] *= -1
            assert (decode(5.0 * flipped, code)[0] == np.arange(n)).all()
    assert language_id.codewords(1).shape == (1, 1)


def plain_prediction(model, text):
    """By dictionaries and loops over the text's n-grams."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    counts = {}
    for size in (1, 2, 3):
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if any(b != 32 for b in gram):
                h = 0
                for k, b in enumerate(gram):
                    h = (b if k == 0 else h * 257 + b) % 2**32
                slot = ((h * 2654435761 + size * 977) % 2**32 >> 19) % WIDTH
                counts[slot] = counts.get(slot, 0) + 1
    norm = sum(counts.values()) ** 0.5
    margins = [sum(c**0.5 / norm * float(model.w[slot, bit]) for slot, c in counts.items()) + float(model.b[bit]) for bit in range(model.code.shape[1])]
    losses = [sum(np.log1p(np.exp(-m * float(c))) for m, c in zip(margins, code, strict=True)) for code in model.code]
    likely = [np.exp(min(losses) - x) for x in losses]
    return model.languages[losses.index(min(losses))], max(likely) / sum(likely)


def test_matches_a_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, made(lang, rng, 12), lang) for i in range(120) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(500, None, None), (501, "", None), (502, "1 2", None), (503, "É A b", None), (504, made("xb", rng, 3_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    for r in predict(df, model).collect():
        lang, sure = plain_prediction(model, rows[[x[0] for x in rows].index(r.doc_id)][1])
        assert r.lang_pred == lang and abs(r.score - sure) < 1e-3


def test_no_language_is_lost_among_many(spark):
    rows = [(i, f"word{i % 60} of language", f"l{i % 60}") for i in range(1800)] + [(9000 + i, "rare one", "rare") for i in range(4)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=300)
    assert len(model.languages) == 61


def test_factors_of_rows_give_the_same_weights():
    rng = np.random.default_rng(3)
    x, y, weight = rng.random((40, 60), np.float32), rng.choice([-1.0, 1.0], (40, 3)).astype(np.float32), rng.random(40) + 0.5
    w, b = language_id.fit_bits(x, y, weight, rounds=60)
    wide = np.concatenate([x, np.zeros((40, 140), np.float32)], axis=1)
    by_rows, its_b = language_id.fit_bits(wide, y, weight, rounds=60)
    assert by_rows.shape == (200, 3) and np.allclose(by_rows[:60], w, atol=1e-3) and np.allclose(its_b, b, atol=1e-3) and not by_rows[60:].any()
