"""Operator 5's join at low thresholds, where linked sets differ much in size."""

import random

import pytest

from revverify.llm import jaccard


def components(sets, num, den):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("num,den", [(1, 2), (1, 4)])
def test_far_sizes_link(spark, num, den):
    rnd = random.Random(num * den)
    word = lambda i, n, k=0: {f"g{i}x{k + j}" for j in range(n)}
    sets = [word(0, 10), word(0, 20), word(1, 10), word(1, 21), word(2, 100), word(2, 200), word(3, 30), word(3, 120), word(4, 1), word(4, 2), word(5, 1), word(5, 4)]
    for i in range(6, 40):
        n = rnd.randrange(2, 90)
        sets += [word(i, n), word(i, rnd.randrange(n, n * den // num + 2)), word(i, n, rnd.randrange(n))]
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "id long, text string")
    members, _ = jaccard.jaccard_join(docs, 1, num, den)
    assert {r["id"]: r["component"] for r in members.collect()} == dict(enumerate(components(sets, num, den)))
