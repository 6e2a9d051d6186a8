import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from sparkwarden.llm import decontaminate
from sparkwarden.llm import textkit as tk
from sparkwarden.llm.decontaminate import ORACLE, SPAN, K, contaminated_words, decontamination_report
from sparkwarden.llm.session import durable


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if i is not None and n:
            for p in range(len(w) - n + 1):
                wins.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if x := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    got |= x
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 3) for r in docs], "doc_id long, text string, row string, n int")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, decontamination_report(d, i).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a%d" % i for i in range(60)] + ["é", "É", "x1"]
    items = [(n, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 40])))) for n in range(30) if n != 4]
    items += [(40, items[7][1]), (41, None), (42, "!!"), (None, "zzz"), (5, "same same same same same same same same same same same same")]
    docs = [(-1, None), (-2, ""), (None, items[3][1]), (-4, "SAME " * 30), (-5, "Same, " * 9)]
    for n in range(150):
        t = rng.choices(vocab, k=rng.choice([3, 12, 80]))
        if n % 2:
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            t[5:5] = [rng.choice(["", "-", "("]) + x.upper() for x in w[a : a + rng.choice([8, 9, 10, 11, 40])]]
        docs.append((n, ". ".join(t)))
    docs += [docs[9], docs[9], (9, "other text")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_items_without_an_id_hit_as_the_sql_says(spark):
    passage = lambda a: " ".join("p%d" % i for i in range(a, a + 15))
    items = [(None, passage(0)), (None, passage(100)), (1, passage(200)), (2, passage(0)), (None, "one two"), (None, None)]
    docs = [(1, "x " + passage(100) + " y"), (2, passage(0)), (3, passage(200) + " " + passage(100)), (4, "one two three"), (5, passage(300)), (6, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert run(spark, docs, items) == sorted(con.execute(ORACLE).fetchall(), key=str)


def test_joined_by_shuffles(spark):
    rng = random.Random(8)
    vocab = ["b%d" % i for i in range(40)]
    items = [(n, " ".join(rng.choices(vocab, k=rng.choice([4, 7, 10, 30])))) for n in range(20)]
    docs = [(n, " ".join(rng.choices(vocab, k=30)) + " " + rng.choice(items)[1]) for n in range(60)]
    d = spark.createDataFrame([(str(n), t) for n, t in docs], "row string, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.row, r.n_hit, r.n_items, r.item_ids)
    got = sorted(map(key, contaminated_words(d, i, few=0).collect()))
    assert got == sorted(map(key, contaminated_words(d, i).collect())) and any(r[1] for r in got)
    assert [r[1:3] for r in got] == [b[2:4] for b in sorted(brute(docs, items), key=lambda b: str(b[0]))]


def read_of(text):
    return decontaminate._Read(next(iter(tk.slices(pa.array([text])))))


def test_fingerprints_are_few_and_every_window_has_one():
    rng = random.Random(2)
    text = " ".join("w%d" % rng.randrange(5000) for _ in range(20_000))
    at, _ = read_of(text).prints(SPAN, K)
    assert 0.25 < len(at) / 20_000 < 0.33  # 2 in 7 grams
    assert all(any(p <= a <= p + SPAN - K for a in at[np.searchsorted(at, p) :][:1]) for p in range(20_000 - SPAN + 1))


def test_a_shared_fingerprint_without_a_shared_window_is_cheap(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(10**6)
    some = [" ".join(word() for _ in range(K)) for _ in range(4000)]
    low = min(some, key=lambda g: int(tk.mix(tk.grams(read_of(g).hashes, K) + np.uint64(SPAN))[0]))  # least in all windows around it
    inside = lambda: " ".join([*(word() for _ in range(12)), low, *(word() for _ in range(12))])
    docs, items = [(n, inside()) for n in range(1500)], [(n, inside()) for n in range(300)]
    counts = []
    monkeypatch.setattr(decontaminate, "durable", lambda df: (counts.append((out := durable(df)).count()), out)[1])
    got = run(spark, docs, items)
    prints, read, windows, theirs, spans = counts
    assert read >= 1.9 * len(docs)  # each text's own row and the fingerprint
    assert windows <= (SPAN - K + 1) * 1.1 * len(docs) and theirs == 300 * (29 - SPAN + 1) and spans == 0
    assert not any(r[5] for r in got)


def test_very_long_text(spark):
    rng = random.Random(1)
    item = " ".join("p%d" % i for i in range(12))
    long = " ".join("w%d" % rng.randrange(10**5) for _ in range(300_000))
    got = run(spark, [(1, long + " " + item + " " + long), (2, long)], [(7, item)])
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 600_012, 12), (2, 300_000, 0)]
