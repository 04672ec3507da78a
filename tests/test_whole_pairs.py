"""JN-12 against the reference's order on many ties."""

import random

from revverify.operators import diff


def greedy(rows):
    used_b, used_a, out = set(), set(), set()
    for g, b, a, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, b) not in used_b and (g, a) not in used_a:
            used_b.add((g, b))
            used_a.add((g, a))
            out.add((g, b, a))
    return out


def test_ties_are_all_paired(spark):
    rnd = random.Random(12)
    rows = [(1, b, a, 0.9) for b in range(60) for a in range(45)]
    rows += [(2, b, a, rnd.choice([0.5, 0.5, 0.6, 0.7])) for b in range(12) for a in range(14) if rnd.random() < 0.6]
    rows += [(3, b, a, 1.0 if (b < 25) == (a < 30) else 0.4) for b in range(40) for a in range(40)]
    got = diff.greedy_pair(spark.createDataFrame(rows, "g long, b long, a long, similarity double")).collect()
    assert {(r["g"], r["b"], r["a"]) for r in got} == greedy(rows) and len(got) == len(greedy(rows))
