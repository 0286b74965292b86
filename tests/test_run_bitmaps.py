import random

import numpy as np
from conftest import rows_of

from helixframe.operators.run_bitmaps import merge_runs, periods_and_gaps

SCHEMA = "k string, a long, b long, start string, kind int"


def brute(rows):
    out = []
    for key in {k for k, *_ in rows if k is not None}:
        spans = sorted((a, b) for k, a, b, *_ in rows if k == key and a is not None and b is not None and a < b)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged] + [(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), a, a + rng.choice([1, 3, 20, 70, 300]), "t", 1) for a in (rng.randrange(0, 4000) for _ in range(300))]
    rows += rows[:40]  # repeats
    for bits in (4, 6, 20):
        got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), "k", "a", "b", shard_bits=bits, salts=3)
        assert rows_of(got) == brute(rows)


def test_hot_key_touching_and_long(spark):
    rows = [("hot", i * 10, i * 10 + 10, None, None) for i in range(5000)] + [("cold", 0, 1 << 30, None, None), ("cold", (1 << 30) + 5, (1 << 30) + 6, None, None)]
    got = rows_of(periods_and_gaps(spark.createDataFrame(rows, SCHEMA).repartition(7), "k", "a", "b"))
    assert got == [("cold", "gap", 1 << 30, (1 << 30) + 5), ("cold", "period", 0, 1 << 30), ("cold", "period", (1 << 30) + 5, (1 << 30) + 6), ("hot", "period", 0, 50000)]


def test_nulls_empty_and_reversed(spark):
    rows = [(None, 1, 2, None, None), ("x", None, 2, None, None), ("x", 1, None, None, None), ("x", 5, 5, None, None), ("x", 9, 3, None, None)]
    assert rows_of(periods_and_gaps(spark.createDataFrame(rows, SCHEMA), "k", "a", "b")) == []
    assert rows_of(periods_and_gaps(spark.createDataFrame([], SCHEMA), "k", "a", "b")) == []


def test_merge_runs_with_huge_range():
    g, s, e = merge_runs(np.array([0, 1, 0]), np.array([0, 5, -(1 << 60)]), np.array([1 << 60, 6, 1]))
    assert list(zip(g, s, e)) == [(0, -(1 << 60), 1 << 60), (1, 5, 6)]
