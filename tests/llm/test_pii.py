import hashlib
import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import pii


def brute(text):
    """The four patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_patterns_match_brute_force():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "x-y", ".", "com", "1", "22", "255", "256", "4111111111111111", " ", "-", "+", "(", ")", "555", "%", "é", "٣", "007", "+1 (017) 555-7713", "a.b@c.de", "1.2.3.4", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for piece in ("1", "a", "1.", "1 ", "a@", "@", "+1", "a.", "+1(", "1-1.1@"):
        pii.base_spans(piece * 200_000)
    assert time.time() - began < 20


def docs(rng, n=300):
    out = []
    for i in range(n):
        w = ["".join(rng.choices("abcdefg", k=5)) for _ in range(30)]
        for thing in rng.sample(["me.%d@mail.example.com" % i, "+1 (%03d) 555-%04d" % (i, i * 7), "10.0.%d.9" % (i % 250), "4111111111111111", 'token = "%s"' % hashlib.sha1(b"%d" % i).hexdigest(), "v%d" % i, "3"], 4):
            w.insert(rng.randrange(30), thing)
        out.append((i, " ".join(w)))
    return out


def test_field_adds_and_base_stays(spark):
    rng = random.Random(1)
    secret = hashlib.sha1(b"q").hexdigest()
    rows = docs(rng) + [(1000, f'a token = "{secret}" b c d {secret}, e'), (1001, None), (1002, ""), (1003, "no such"), (None, "x@y.zz"), (1003, "no such"), (1004, "word " * 40_000 + "a@b.cc")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    want = sorted((i, *(sum(k == s[2] for s in brute(t or "")) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute(t or "")).encode()).hexdigest()) for i, t in [(i or -1, t) for i, t in rows])
    assert sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans.split(",") for r in got}
    text = rows[300][1]
    a, b = text.index(secret), text.rindex(secret)
    assert {f"secret:{a}:{a + 40}", f"secret:{b}:{b + 40}"} <= set(spans[1000])
    for i, t in rows[:300]:
        assert {f"{k}:{s}:{e}" for s, e, k in brute(t)} <= set(spans[i])
    extra = [t[int(x.split(":")[1]) : int(x.split(":")[2])] for i, t in rows[:300] for x in spans[i] if x and x.split(":")[0] != "secret" and x not in {f"{k}:{s}:{e}" for s, e, k in brute(t)}]
    assert all("4111111111111111" in x or x.startswith("+1") or "555-" in x or x.startswith("10.0.") for x in extra), extra
    masked = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert secret not in masked[1000] and masked[1003] == "no such" and masked[1001] is None and masked[1004].endswith("<EMAIL>")


def test_skip_edges_spread_a_label():
    text = "key 12ab34 x x x x 12ab34 y y 99zz99"
    found = pii.nodes(text)
    unary = np.zeros((pii.WIDTH, len(pii.LABELS)))
    unary[:, 0] = 0.02
    rare = [f for f in found.features[0] if f not in found.features[1]]
    assert rare
    unary[rare, 5] = 4.0
    apart = pii.Field(unary, np.zeros((6, 6)), 0.0).marginals(found)
    joined = pii.Field(unary, np.zeros((6, 6)), 3.0).marginals(found)
    assert joined[1, 5] > apart[1, 5] + 0.3 and abs(joined[2, 5] - apart[2, 5]) < 1e-6


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pii.redact_pii(spark.createDataFrame([(1, "a")], "doc_id long, text string")).select(F.col("text")).collect()[0].text == "a"


def test_marginals_are_exact_without_loops():
    """Against all labellings of a text whose neighbours and alike words make no loop."""
    rng = np.random.default_rng(3)
    size = 3
    field = pii.Field(rng.normal(size=(pii.WIDTH, size)) * 0.3, rng.normal(size=(size, size)), 1.2)
    for text in ("a1 b2 c3", "x9 and a1 b2 then x9", "q7 r8 stop z5"):
        found = pii.nodes(text)
        own = field.unary[found.features].sum(1)
        n = len(found.spans)
        p = np.zeros((n, size))
        for labels in itertools.product(range(size), repeat=n):
            score = sum(own[i, k] for i, k in enumerate(labels))
            score += sum(field.chain[labels[i], labels[i + 1]] for i in range(n - 1) if found.word[i + 1] == found.word[i] + 1)
            score += sum(field.skip for i in range(n) for j in range(i) if found.keys[i] == found.keys[j] and labels[i] == labels[j])
            for i, k in enumerate(labels):
                p[i, k] += np.exp(score)
        assert np.allclose(field.marginals(found, rounds=80), p / p.sum(1, keepdims=True), atol=2e-3)


def test_alike_words_count_in_full():
    """Many alike words of which half are sure carry the rest along, however many they are."""
    size = 2
    unary = np.zeros((pii.WIDTH, size))
    field = pii.Field(unary, np.zeros((size, size)), 1.5)
    found = pii.Nodes([(i, i + 1) for i in range(30)], list(range(0, 60, 2)), np.array([[i % 2] for i in range(30)]), ["same"] * 30)
    unary[0], unary[1] = (0, 8), (2.5, 0)
    assert (field.marginals(found)[1::2, 1] > pii.SURE).all()


def test_secrets_without_digits_are_nodes():
    text = 'password = "correct-horse-battery-staple" and later correct-horse-battery-staple. plain words here'
    found = pii.nodes(text)
    assert [text[a:b] for a, b in found.spans] == ["correct-horse-battery-staple"] * 2
    assert pii.weak_labels(text, found, []).tolist() == [pii.LABELS.index("secret")] * 2
