import math
import random
from statistics import median

import numpy as np
from conftest import rows_of
from pyspark.sql import functions as F

from helixframe.operators.spikes import SPIKE_TAIL, counted_median, esd_kept, esd_limit, implausible_readings, rounded, seasonal_esd, t_quantile

SCHEMA = "id long, movie int, hole int, base int, v int, s long, top long, field_name string"


def found(spark, rows, block=4096):
    df = spark.createDataFrame(rows, SCHEMA)
    return rows_of(implausible_readings(df, "id", "movie", ["movie", "hole"], "base", {"v": (F.lit(0), F.lit(100)), "s": (F.lit(0), F.col("top"))}, ["v"], ["s"], block=block))


def brute(rows):
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    out = set()
    for movie in {r[1] for r in rows}:
        vs = [r[4] for r in rows if r[1] == movie and r[4] is not None]
        if vs and movie is not None:
            m = median(vs)
            mad = median(abs(v - m) for v in vs)
            out |= {(r[0], "v") for r in rows if r[1] == movie and r[4] is not None and abs(r[4] - m) > 10 * mad}
    at = {(r[1], r[2], r[3]): r for r in rows if None not in r[1:4]}
    for r in rows:
        if r[4] is not None and not 0 <= r[4] <= 100:
            out.add((r[0], "v"))
        if r[5] is not None and (r[5] < 0 or r[6] is not None and r[5] > r[6]):
            out.add((r[0], "s"))
        for name, i in (("v", 4), ("s", 5)):
            if r[i] is None or None in r[1:4]:
                continue
            n, side = 1, []
            for step in (-1, 1):
                b = r[3] + step
                while (x := at.get((r[1], r[2], b))) and x[i] == r[i]:
                    n, b = n + 1, b + step
            if n >= 10:
                out.add((r[0], name))
        if None not in r[1:4] and r[5] is not None:
            a, z = at.get((r[1], r[2], r[3] - 1)), at.get((r[1], r[2], r[3] + 1))
            if a and z and a[5] is not None and z[5] is not None and a[5] <= z[5] and not a[5] <= r[5] <= z[5]:
                out.add((r[0], "s"))
    return sorted(out)


def test_random_against_brute_force(spark):
    rng, rows, n = random.Random(5), [], 0
    for movie in (1, 2, None):
        for hole in range(6):
            s = 0
            v = 5
            for base in range(120):
                n += 1
                if rng.random() < 0.03:
                    continue
                s += rng.choice([0, 0, 1, 5])
                v = v if rng.random() < 0.8 else rng.choice([3, 4, 5, 6, 90, -4, 300])
                rows.append((n, movie, hole, base, None if rng.random() < 0.02 else v, None if rng.random() < 0.02 else s + rng.choice([0] * 30 + [1000, -900]), rng.choice([None, 900]), "x"))
    rows += rows[:50]
    expected = brute(rows)
    for block in (16, 4096):  # small blocks put runs across borders
        assert found(spark, rows, block) == expected


def test_edges(spark):
    assert found(spark, []) == []
    rows = [(None, 1, 1, 1, 500, 5, 9, "x"), (1, 1, None, None, 500, 10, 9, "x"), (2, None, 1, 1, None, None, None, "x")]
    assert found(spark, rows) == [(1, "s"), (1, "v")]


def test_hot_hole_of_equal_values(spark):
    rows = [(i, 1, 7, i, 4, i, None, "x") for i in range(3000)]
    assert found(spark, rows, block=256) == [(i, "v") for i in range(3000)]


def test_counted_median(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 4, 1), ("a", 9, 1), ("b", 3, 1)], "k string, v int, c long")
    assert rows_of(counted_median(df, ["k"], "v", "c", "m")) == [("a", 2.5, 4), ("b", 3.0, 1)]


def test_median_over_several_bins(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([-70_000, 0, 3, 5_000, 900_000]) + rng.randrange(9000), rng.randrange(1, 4)) for _ in range(400)]
    got = {r[0]: r[1:] for r in rows_of(counted_median(spark.createDataFrame(rows, "k string, v int, c long"), ["k"], "v", "c", "m"))}
    for k in "ab":
        values = [v for g, v, c in rows for _ in range(c) if g == k]
        assert got[k] == (median(values), len(values))


def test_esd():
    assert abs(t_quantile(0.975, 20) - 2.08596) < 1e-3
    limits = [esd_limit(54, i, 0.05) for i in (1, 2, 3)]
    assert abs(limits[0] - 3.158) < 0.01 and limits == sorted(limits, reverse=True)  # published table: 3.158 for n = 54


def test_spike_search_misses_nothing_beyond_ten_mads():
    # The least deviate such a reading has when its turn comes, against the largest limit of any size.
    assert max(esd_limit(n, i, 0.05, SPIKE_TAIL) for n in (5, 10, 50, 1000, 10**6, 10**9) for i in (1, 2, n // 2) if n - i > 1) < 9 / (2 * 1.4826)
    rng = random.Random(6)
    for k in range(200):
        n = rng.randrange(5, 80)
        values = sorted(rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), 40 + rng.random() * rng.choice([1, 900]), -15.0 - k]) for _ in range(n))
        centre = median(values)
        mad = median(abs(v - centre) for v in values)
        least, most, *_ = esd_kept(np.array(values), np.ones(n, np.int64), tail=SPIKE_TAIL)
        assert all(not least <= v <= most for v in values if abs(v - centre) > 10 * mad)


def esd_by_hand(xs, alpha=0.05):
    left = keep = sorted(xs)
    n, gone = len(xs), 0
    while len(left) > 1:
        end = left[0] if median(left) - left[0] > left[-1] - median(left) else left[-1]
        times = left.count(end)
        if gone + times > n // 2:
            break
        gone += times
        rest = [x for x in left if x != end]
        one = sorted([*rest, end])
        far, scale = abs(end - median(one)), 1.4826 * median(abs(x - median(one)) for x in one)
        left = rest
        if (far / scale if scale else math.inf if far else 0) > esd_limit(n, gone, alpha):
            keep = left
    return keep[0], keep[-1], median(keep), median(abs(x - median(keep)) for x in keep)


def test_esd_takes_median_and_mad_anew():
    rng = random.Random(1)
    for k in range(300):
        xs = [float(round(rng.gauss(0, rng.choice([0.5, 3])))) if k % 2 else rng.gauss(0, 1) for _ in range(rng.randrange(3, 60))]
        xs = [x if rng.random() > 0.2 else rng.choice([50.0, 60.0, -40.0, x * 9]) for x in xs]
        values, counts = np.unique(np.array(xs), return_counts=True)
        assert np.allclose(esd_kept(values, counts), esd_by_hand(xs))


def test_rounded_keeps_small_numbers(spark):
    values = [0.0, 0.5, -8191.0, 4095.5, 1e-9, 123456.7]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(rounded(F.col("v"))).collect()]
    assert got[:4] == values[:4] and all(abs(a - b) <= abs(b) / 8192 for a, b in zip(got, values))


def test_seasonal_esd_flags_the_planted_spike(spark):
    rng = random.Random(1)
    rows = [(i, 1, i, float(10 * (i % 8) + i // 64 + rng.gauss(0, 1)) + (60 if i == 333 else 0)) for i in range(1024)]
    got = seasonal_esd(spark.createDataFrame(rows, "id long, src int, pos long, v double"), "src", "id", "pos", "v", 8, 64)
    assert [r["id"] for r in got.collect()] == [333]
    assert seasonal_esd(spark.createDataFrame([], "id long, src int, pos long, v double"), "src", "id", "pos", "v", 8, 64).count() == 0
