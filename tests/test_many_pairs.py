"""Kernels that take many pairs or triples at a time: against slow counterparts, in a time that one at a time would not keep."""

import random
import time
from functools import lru_cache

from helixframe.functions import dp
from helixframe.plans import mapping_queries


def _random(rng, letters, low, high):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def _brute_three(texts, s):
    x = [dp.codes(t) for t in texts]

    @lru_cache(None)
    def best(*at):
        if not any(at):
            return 0
        found = []
        for move in ((u, v, w) for u in (0, 1) for v in (0, 1) for w in (0, 1)):
            if not any(move) or any(a < m for a, m in zip(at, move)):
                continue
            cost = 0
            for p, q in ((0, 1), (0, 2), (1, 2)):
                cost += int(s.table[x[p][at[p] - 1], x[q][at[q] - 1]]) if move[p] and move[q] else s.deletion * (move[p] or move[q])
            found.append(best(*(a - m for a, m in zip(at, move))) + cost)
        return min(found)

    return best(*map(len, texts))


def test_three_way_many_equals_brute_force():
    rng = random.Random(31)
    triples = [tuple(_random(rng, "ACGTNac", 0, 5) for _ in range(3)) for _ in range(80)] + [("", "", ""), ("", "AC", "")]
    for s in (dp.Scores.named("edit", deletion=1), dp.Scores.named("long_read", deletion=5)):
        assert dp.three_way_many(triples, s) == [_brute_three(x, s) for x in triples]
    assert dp.three_way_many([], s) == []


def test_align_three_way_of_many_suppliers(spark, tmp_path):
    """Of 4,000 suppliers, one without a key; one triple at a time took 36 ms."""
    keys = spark.range(1, 4000).selectExpr("id as s_suppkey").unionByName(spark.sql("select cast(null as bigint) as s_suppkey")).coalesce(1)
    keys.write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    got = {r.s_suppkey: r.score for r in mapping_queries.align_three_way(spark, str(tmp_path)).collect()}
    assert time.time() - began < 40
    assert len(got) == 4000 and got[None] is None
    texts = mapping_queries._three(spark, str(tmp_path)).where("s_suppkey % 1000 = 1").collect()
    s = dp.Scores.named("edit", deletion=1)
    assert [got[r.s_suppkey] for r in texts] == [_brute_three((r.s0, r.s1, r.s2), s) for r in texts]


def _slow_extension(q, t, s, drop, max_rises, band):
    """Score and end by a whole matrix of Python numbers."""
    x, y, far = dp.codes(q), dp.codes(t), 1 << 40
    above = [s.deletion * j if j <= band else far for j in range(len(t) + 1)]
    best, end, rises = 0, (0, 0), 0
    for i in range(1, len(q) + 1):
        row = []
        for j in range(len(t) + 1):
            cell = min(above[j] + s.insertion, above[j - 1] + int(s.table[x[i - 1], y[j - 1]]) if j else far, row[j - 1] + s.deletion if j else far)
            row.append(cell if abs(i - j) <= band else far)
        above, low = row, min(row)
        if low >= far:
            break
        if low < best:
            best, end, rises = low, (i, row.index(low)), 0
        elif low > best + drop:
            rises += 1
            if rises > max_rises:
                break
    return best, end


def _extension_pairs(rng):
    pairs = [("", ""), ("", "ACG"), ("ACG", ""), ("A", "A"), ("A" * 60, "A"), ("A", "A" * 60)]
    for _ in range(12):
        q = _random(rng, "ACGTN", 0, 70)
        changed = "".join(rng.choice(["", c + "A", rng.choice("ACGT")]) if rng.random() < 0.1 else c for c in q)
        pairs += [(q, changed), (q, q[: len(q) // 2] + _random(rng, "ACGT", 0, 90)), (q, _random(rng, "ACGT", 0, 30) + q)]
    return pairs


def test_extend_many_equals_slow_extension():
    pairs = _extension_pairs(random.Random(32))
    for s in (dp.Scores.named("long_read", insertion=5, deletion=5), dp.Scores.named("qv", insertion=2, deletion=1)):
        for limits in ((30, 10, 15), (5, 2, 15), (0, 0, 3), (30, 10, 0)):
            for (q, t), a in zip(pairs, dp.extend_many([q for q, _ in pairs], [t for _, t in pairs], s, *limits)):
                score, end = _slow_extension(q, t, s, *limits)
                assert (a.q_end, a.t_end) == end and (a.score == score or limits[2] < 15)  # the last alignment's band is wider by one
                assert (a.q_start, a.t_start) == (0, 0) and dp.rescore(q, t, a, s) == a.score
    assert dp.extend_many([], [], s) == []


def _many_parts(spark, tmp_path):
    spark.range(12_000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return mapping_queries._pairs(spark, str(tmp_path)).where("p_partkey % 1000 = 7").collect()


def test_extend_xdrop_of_many_parts(spark, tmp_path):
    """12,000 pairs, which took 28 ms each on one core when they were extended one at a time."""
    texts = _many_parts(spark, tmp_path)
    began = time.time()
    got = {r.p_partkey: r for r in mapping_queries.QUERIES["extend_xdrop"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 40
    assert len(got) == 12_000 and len(texts) == 12
    for r in texts:
        x = got[r.p_partkey]
        assert (x.score, (x.q_end, x.t_end)) == _slow_extension(r.query, r.target, mapping_queries.SCORES, 30, 10, 15)


def test_extend_back_many_mirrors_extend_many():
    pairs = _extension_pairs(random.Random(33))
    s = dp.Scores.named("long_read", insertion=5, deletion=5)
    for (q, t), a in zip(pairs, dp.extend_back_many([q for q, _ in pairs], [t for _, t in pairs], s)):
        score, (i, j) = _slow_extension(q[::-1], t[::-1], s, 30, 10, 15)
        assert (a.score, a.q_start, a.t_start, a.q_end, a.t_end) == (score, len(q) - i, len(t) - j, len(q), len(t))
        assert dp.rescore(q, t, a, s) == a.score


def test_extend_xdrop_back_of_many_parts(spark, tmp_path):
    texts = _many_parts(spark, tmp_path)
    began = time.time()
    got = {r.p_partkey: r for r in mapping_queries.QUERIES["extend_xdrop_back"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 40
    assert len(got) == 12_000 and len(texts) == 12
    for r in texts:
        x, (score, (i, j)) = got[r.p_partkey], _slow_extension(r.query[::-1], r.target[::-1], mapping_queries.SCORES, 30, 10, 15)
        assert (x.score, x.q_start, x.t_start, x.q_end, x.t_end) == (score, len(r.query) - i, len(r.target) - j, len(r.query), len(r.target))
