import random

import pytest

from sparkwarden.llm.graph import components


def brute(links):
    comp = {}
    for a, b in links:
        x, y = comp.get(a, {a}), comp.get(b, {b})
        both = x | y
        for n in both:
            comp[n] = both
    return sorted((n, min(c)) for n, c in comp.items())


@pytest.mark.parametrize("local", [1_000, 40, 3])
def test_components(spark, local):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, i) for i in range(401, 440)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, *links[:9], (7, 7), (None, 3), (5, None)], "a long, b long")
    assert sorted(map(tuple, components(df, local=local).collect())) == brute([x for x in links if x[0] != x[1]])


def test_none(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
