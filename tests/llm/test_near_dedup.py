import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import near_dedup
from sparkwarden.llm.near_dedup import least_matches, near_duplicates

SCHEMA = "doc_id long, text string, set_key string, sig int"


def brute(rows, k, per_cent):
    def shingles(t):
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(d, shingles(t)) for d, t in rows]
    comp = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= per_cent * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min(sets[i][0] for i in range(len(sets)) if comp[i] == c) for c in comp}
    return sorted((d, len(s), least[comp[i]], d == least[comp[i]]) for i, (d, s) in enumerate(sets))


def run(spark, rows, k=3, threshold=0.85, **more):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, near_duplicates(df, k, threshold, **more).collect()))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    common = " ".join(rng.choices(vocab, k=40))
    for g in range(25):
        base = rng.choices(vocab, k=rng.choice([2, 5, 60, 150]))
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n * 7 % 1009, " ".join(w) + (" " + common if g % 3 == 0 else "")))
            n += 1
    rows += [(2000, ""), (2001, None), (2002, " \n\t"), (2003, "One"), (2004, "one"), (2005, "Ünï x y"), (2006, "ünï x y")]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, rows, block=900) == brute(rows, 3, 85)
    assert run(spark, rows, 5, 0.8) == brute(rows, 5, 80)


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, "a b c d"), (4, "a b c d"), (2, "A b c  d"), (9, "x y z q")]) == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (9, 2, 9, True)]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "q"), (3, "a b c d")], "doc_id long, text string")
    got = near_duplicates(df, 3, 0.85).select(F.coalesce("doc_id", F.lit(-1)), "component_id").collect()
    assert sorted((a, b or -1) for a, b in got) == [(-1, -1), (-1, 3), (3, 3)]


def test_least_matches():
    assert 6 <= least_matches(0.85) <= 12 and least_matches(0.8) < least_matches(0.85)


def test_long_lists_meet_their_pivot_and_then_the_rarest_shingles(spark, monkeypatch):
    rng = random.Random(11)
    base = ["b%d" % i for i in range(60)]
    rows = [(i, "thank you for reading u%d" % i) for i in range(150)]  # share much, link with nothing
    for i in range(150):  # most link with the pivot, chains of others only with each other
        w = list(base)
        for _ in range(rng.choice([1, 2, 6])):
            w[rng.randrange(60)] = "x%d" % rng.randrange(9)
        rows.append((1000 + i, " ".join(w)))
    rows += [(3000 + i, "one and the same text here") for i in range(40)]
    monkeypatch.setattr(near_dedup, "ROWS", 30)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_very_long_texts(spark):
    w = ["w%d" % (i * 7 % 50_021) for i in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:100], "changed", *w[101:]])), (3, " ".join(w[:20_000]))]
    assert [r[2] for r in run(spark, rows)] == [1, 1, 3]


def test_a_unit_of_texts_from_one_template_takes_linear_time():
    took = []
    for n in (4_000, 16_000):
        sets = [np.sort(np.array([1, 2, 1000 + i], np.uint64)) for i in range(n)]
        sigs = np.array([near_dedup._signature(x) for x in sets])
        began = time.perf_counter()
        assert near_dedup._join_unit(sets, sigs, 85, least_matches(0.85)) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def dense(rows, k, per_cent):
    """brute() by one product of matrices, for texts of k words and more."""
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for _, t in rows]
    at = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[g] for g in s]] = 1
    common, size = m @ m.T, m.sum(1)
    near, least = 100 * common >= per_cent * (size[:, None] + size[None, :] - common), np.array([d for d, _ in rows])
    while True:
        new = np.where(near, least[None, :], least[:, None]).min(1)
        if (new == least).all():
            return sorted((d, int(n), int(c), d == c) for (d, _), n, c in zip(rows, size, least, strict=True))
        least = new


def test_rows_written_for_a_long_list_follow_its_members(spark, monkeypatch):
    rng = random.Random(17)
    base = ["b%d" % i for i in range(60)]

    def changed(words, places):
        w = list(words)
        for i in rng.sample(range(len(w)), places):
            w[i] = "x%d" % rng.randrange(10**6)
        return w

    variants = [changed(base, 4) for _ in range(12)]
    loose = [(i, " ".join(changed(base, 3))) for i in range(900)]  # too far apart to link
    tight = [(2000 + i, " ".join(changed(base, 1))) for i in range(700)]
    apart = [(4000 + i, " ".join(changed(rng.choice(variants), 1))) for i in range(600)]  # link inside their variant only
    rows = loose + tight + apart
    monkeypatch.setattr(near_dedup, "ROWS", 250)
    written = []
    forests = near_dedup._forests

    def counted(units, *rest, **more):
        written.append(units.count())
        return forests(units, *rest, **more)

    monkeypatch.setattr(near_dedup, "_forests", counted)
    assert run(spark, rows) == dense(rows, 3, 85)
    listed = written[0]  # each member once for each of its lists, few of the 24 coordinates
    assert len(written) >= 3 and listed < 6 * len(rows) and sum(written) < 2 * listed, written  # blocks against blocks were 9 times as many


def test_only_sets_of_long_lists_are_joined_again(spark, monkeypatch):
    rng = random.Random(23)
    rows = []
    for i in range(120):
        w = ["b%d" % j for j in range(60)]
        w[rng.randrange(60)] = "x%d" % i
        rows.append((i, " ".join(w)))
    for i in range(80):
        w = ["p%d_%d" % (i, j) for j in range(60)]
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join([*w[:-1], "end"]))]
    monkeypatch.setattr(near_dedup, "ROWS", 30)
    seen = []
    long_lists = near_dedup._long_lists

    def counted(members, sets, *rest):
        seen.append((members.select("set_key").distinct().count(), sets.count()))
        return long_lists(members, sets, *rest)

    monkeypatch.setattr(near_dedup, "_long_lists", counted)
    assert run(spark, rows) == dense(rows, 3, 85)
    assert seen and all(members == sets <= 120 for members, sets in seen), seen
