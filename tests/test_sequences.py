import random

import numpy as np
from conftest import rows_of
from pyspark.sql import functions as F

from helixframe.functions import cigar, dp, seq
from helixframe.functions.kmer_codes import kmer_counts, kmer_table
from helixframe.operators import coverage, graph, mapping, relational, seeds, simulate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, seq.reverse_complement(lit("AACgtN"))) == "NacGTT"
    assert one(spark, seq.decode_two_bit(seq.encode_two_bit(lit("GATTACA")), 7)) == "GATTACA"
    assert one(spark, seq.encode_two_bit(lit("GANT"))) is None
    assert one(spark, seq.condense(lit("AAACCGT"))) == "ACGT"
    assert one(spark, seq.longest_run(lit("AACCCT"))) == 3 and one(spark, seq.longest_run(lit("")))== 0
    assert one(spark, seq.mask_outside(lit("ACGTAC"), lit(2), lit(4))) == "NNGTNN" and one(spark, seq.mask_outside(lit("ACG"), lit(2), lit(2))) == "NNN"
    assert one(spark, seq.wrap(lit("ACGTACGT"), 4)) == "ACGT\nACGT"
    assert one(spark, seq.in_ranges(lit(11), "1,2,10-12")) and not one(spark, seq.in_ranges(lit(9), "1,2,10-12"))
    assert one(spark, seq.hamming_ends(lit("AAAAAACCCCCC"), lit("AAAAATCCCCCG"))) == 2 and one(spark, seq.hamming_ends(lit("AAA"), lit("CCC"))) == 0
    assert abs(one(spark, seq.log_factorial(lit(40))) - 110.3206397147574) < 1e-8
    assert abs(one(spark, seq.poisson_cdf(lit(3), lit(2.5))) - 0.7575761331) < 1e-9
    assert abs(one(spark, seq.normal_cdf(lit(1.0), lit(0.0), lit(1.0))) - 0.8413447) < 1e-6
    names = spark.createDataFrame([("m1/7/10_90/5_20",), ("bad",), (None,)], "n string").select(*(c.alias(k) for k, c in seq.parse_read_name("n").items()))
    assert [tuple(r) for r in names.collect()] == [("m1", 7, 15, 30), (None,) * 4, (None,) * 4]


def test_cigar(spark):
    df = spark.createDataFrame([("3S5M2I4M1D6M2H",), ("5M100N5M",), ("*",), (None,), ("4M3=2X",)], "c string")
    ops = cigar.operations("c")
    got = [tuple(r) for r in df.select(cigar.query_span(ops), cigar.ref_span(ops), F.size(cigar.blocks(ops))).collect()]
    assert got == [(17, 16, 3), (10, 110, 2), (0, 0, 0), (0, 0, 0), (9, 9, 1)]
    again = df.limit(1).select(cigar.from_blocks(cigar.blocks(ops)).alias("c")).first().c
    assert again == "5M2I4M1D6M"


def test_kmers(spark):
    rows = [(1, "ACGTACGTN"), (2, "acg"), (3, None), (4, ""), (None, "ACGT"), (5, "A" * 70_000)]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    counts = {r.kmer: r.n for r in kmer_counts(df, "read_id", "seq", 3).collect()}
    table = kmer_table(df, "read_id", "seq", 3).collect()
    assert counts[0] == 69_998 and counts[int("012", 4)] == 3 and len(table) == sum(counts.values())
    assert kmer_table(df.where("false"), "read_id", "seq", 3).count() == 0


def brute_align(q, t, s, mode):
    a, b, sub = dp.codes(q), dp.codes(t), s.table
    qp, tp, qs, ts = dp.MODES[mode]
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            c = [0] if (not i and not j) or (not i and tp) or (not j and qp) or mode == "local" else []
            if i and j:
                c.append(d[i - 1][j - 1] + int(sub[a[i - 1], b[j - 1]]))
            c += [d[i - k][j] + s.open + s.insertion * k for k in range(1, i + 1)]
            c += [d[i][j - k] + s.open + s.deletion * k for k in range(1, j + 1)]
            d[i][j] = min(c)
    if mode == "local":
        return min(map(min, d))
    ends = [d[-1][-1]] + ([r[-1] for r in d] if qs else []) + (d[-1] if ts else [])
    return min(ends)


def test_alignment_modes_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        q, t = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12))) for _ in range(2))
        for mode in dp.MODES:
            s = dp.Scores.named("long_read", insertion=4, deletion=5, open=rng.choice([0, 6]))
            got = dp.align(q, t, s, mode)
            assert got.score == brute_align(q, t, s, mode) == dp.rescore(q, t, got, s)


def test_bands_guides_and_sparse():
    rng = random.Random(4)
    q = "".join(rng.choice("ACGT") for _ in range(300))
    t = q[:100] + q[110:200] + "ACGTA" + q[200:]
    s = dp.Scores.named("long_read", insertion=5, deletion=5)
    full = dp.align(q, t, s)
    assert dp.align(q, t, s, band=30).score == full.score == dp.align(q, t, s, band=8, guide=full.blocks()).score
    assert dp.sparse_align(q, t, s).score == full.score
    assert dp.align(q, t, s, band=1) is None or dp.align(q, t, s, band=1).score >= full.score
    assert dp.one_gap(q, q[:50] + q[60:], s).score == dp.align(q, q[:50] + q[60:], s).score
    assert dp.extend(q, q[:150] + "T" * 150, s).q_end in range(140, 170)
    assert dp.three_way("ACGT", "ACGT", "ACGT", s) == -60
    assert dp.forward_probability("ACGT", np.array([30] * 4), "ACGT") > dp.forward_probability("ACGT", np.array([30] * 4), "AGGT")


def test_extend_back_mirrors_extend():
    rng = random.Random(14)
    q = "".join(rng.choice("ACGT") for _ in range(200))
    t = "T" * 40 + q[60:]
    s = dp.Scores.named("long_read", insertion=5, deletion=5)
    a = dp.extend_back(q, t, s)
    assert (a.q_end, a.t_end) == (200, 180) and 50 <= a.q_start <= 70 and dp.rescore(q, t, a, s) == a.score
    assert dp.extend_back("", "ACG", s).q_end == 0


def test_quality_multiplies_scores():
    s = dp.Scores.named("qv", insertion=20, deletion=20)
    one = lambda q, t, v: dp.align_many([q], [t], s, qualities=[v])[0]
    assert one("ACGT", "ACGT", [1, 2, 3, 4]).score == -10 and one("ACGT", "ACTT", [1, 2, 3, 4]).score == -4
    assert one("ACGT", "ACGT", [1, None, 3]).score == -5 and one("ACGT", "ACGT", None).score == -4
    # A gap pays where the letters that don't fit are good, not where they are bad.
    assert one("ACGTACGT", "ACGACGT", [30] * 8).cigar() == "3=1I4=" and "I" in one("ACGTACGT", "ACGACGT", [9] * 8).cigar()


def test_bands_hold_the_band_only():
    rng = random.Random(5)
    mutated = lambda x: "".join(rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) if rng.random() < 0.06 else c for c in x)
    for _ in range(40):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        t = mutated(q)
        for mode in dp.MODES:
            for s in (dp.Scores.named("long_read", insertion=1, deletion=1, open=10), dp.Scores.named("long_read", insertion=4, deletion=4, long_open=20)):
                full, wide, slim = dp.align(q, t, s, mode), dp.align(q, t, s, mode, band=90), dp.align(q, t, s, mode, band=3)
                assert (full.score, full.cigar()) == (wide.score, wide.cigar())
                assert slim is None or slim.score >= full.score and dp.rescore(q, t, slim, s) == slim.score
    import tracemalloc

    q = "".join(rng.choice("ACGT") for _ in range(6000))
    t = mutated(q)
    tracemalloc.start()
    found = dp.align(q, t, dp.Scores.named("long_read", insertion=1, deletion=1, open=10), "local", band=150)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.stats()["n_match"] > 5000 and peak < 40e6  # the whole matrix would take 180 MB


def test_chain_and_lis():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 9)
        q, t, l = (np.array([rng.randint(lo, hi) for _ in range(n)]) for lo, hi in ((0, 25), (0, 25), (1, 5)))
        best = 0
        for mask in range(1 << n):
            ix = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: q[i])
            if all(q[a] + l[a] <= q[b] and t[a] + l[a] <= t[b] for a, b in zip(ix, ix[1:])):
                best = max(best, sum(l[i] for i in ix))
        assert sum(l[i] for i in dp.chain(q, t, l)) == best == sum(l[i] for i in dp.chain(q, t, l, max_gap=1000))
    values = [5, 1, 4, 2, 3]
    assert [values[i] for i in dp.longest_increasing(values)] == [1, 2, 3] and dp.longest_increasing([]) == []
    assert dp.coarse_chain(np.array([0, 10, 20, 0]), np.array([0, 10, 20, 20]), 10).tolist()[:3] == [True] * 3


def test_seeds_and_matches(spark):
    a = spark.createDataFrame([(1, "TTACGTACGTTTT"), (2, None)], "id long, seq string")
    b = spark.createDataFrame([(9, "GGACGTACGTGG")], "id long, seq string")
    m = seeds.maximal_matches(seeds.seed_join(a, b, "id", "id", "seq", 6), 6)
    assert (1, 9, 2, 2, 8) in [(r.q_id, r.t_id, r.q, r.t, r.length) for r in m.collect()]
    assert seeds.seed_join(a, b, "id", "id", "seq", 4, max_hits=1).count() < seeds.seed_join(a, b, "id", "id", "seq", 4).count()


def test_mapping_recovers_simulated_reads(spark):
    rng = random.Random(8)
    contigs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(3)], "contig_id long, seq string")
    shreds = simulate.shred(contigs, "contig_id", "seq", 1.0, 400, seed=1).withColumn("read_id", F.col("contig_id") * 1000 + F.col("n"))
    truth = {r.read_id: (r.contig_id, r.start, r.strand) for r in shreds.collect()}
    reads = simulate.mutate(shreds, "read_id", "read", 0.02, 0.02, 0.01, seed=2).select("read_id", "seq")
    hits = mapping.map_reads(reads, contigs, mapping.MapParams(k=12)).where("is_primary").collect()
    assert len(hits) == len(truth)
    for h in hits:
        contig, start, strand = truth[h.read_id]
        assert (h.contig_id, h.strand) == (contig, strand) and abs(h.t_start - start) <= 25 and h.pct_similarity > 85 and h.map_qv == 254
    assert mapping.map_reads(reads.where("false"), contigs).count() == 0


def test_mapping_quality():
    hit = lambda s, q0=0, q1=100, m=90: {"q_start": q0, "q_end": q1, "score": s, "n_match": m}
    assert mapping.mapping_quality([hit(-400)]) == [254]
    equal = mapping.mapping_quality([hit(-400), hit(-400)])
    assert equal == [3, 3]
    assert mapping.mapping_quality([hit(-400), hit(-300, 200, 300)]) == [254, 254]


def test_relations(spark):
    pts = spark.createDataFrame([(1, 5), (2, 10), (3, 25), (4, None)], "id long, p long")
    starts = spark.createDataFrame([(0, "a"), (10, "b"), (20, "c"), (20, "d"), (None, "x")], "s long, name string")
    assert rows_of(relational.asof_join(pts.where("p is not null"), starts, None, "p", "s", "name", width=4).select("id", "name")) == [(1, "a"), (2, "b"), (3, "d")]
    left = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 8, 30), ("k", 3, 40, 40)], "key string, id int, a long, b long")
    right = spark.createDataFrame([("k", 9, 9, 12), ("k", 8, 30, 31)], "key string, rid int, c long, d long")
    assert rows_of(relational.interval_overlap_join(left, right, "key", ("a", "b"), ("c", "d"), 4).select("id", "rid")) == [(1, 9), (2, 9)]
    kept = relational.drop_contained_intervals(left.withColumn("score", F.lit(1)), ["key"], "a", "b", "score", "id", 4)
    assert kept.count() == 3
    assert rows_of(relational.pair_join(left, left, "key", "a", "a").select("id", "r_id")) == [(1, 1), (2, 2), (3, 3)]


def test_contained_intervals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), a, a + rng.choice([0, 3, 9, 30]), rng.choice([1, 2, 3, None])) for i, a in ((i, rng.randrange(60)) for i in range(200))]
    gone = {
        x[0] for x in rows for y in rows
        if x[0] != y[0] and x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and None not in (x[4], y[4]) and y[2] <= x[2] and y[3] >= x[3] and y[4] <= x[4]
        and (y[2:] != x[2:] or y[0] < x[0])
    }
    df = spark.createDataFrame(rows, "id int, key string, a int, b int, score int")
    for width in (5, 1000):
        kept = {r.id for r in relational.drop_contained_intervals(df, ["key"], "a", "b", "score", "id", width).collect()}
        assert kept == {r[0] for r in rows} - gone


def test_coverage(spark):
    df = spark.createDataFrame([("r", 0, 10), ("r", 5, 15), ("r", 20, 20)], "ref string, s long, e long")
    assert rows_of(coverage.binned_coverage(df, "ref", "s", "e", 10)) == [("r", 0, 15, 1.5), ("r", 1, 5, 0.5)]
    assert rows_of(coverage.coverage_steps(df, "ref", "s", "e")) == [("r", 0, 5, 1), ("r", 5, 10, 2), ("r", 10, 15, 1)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (1, 3, 1), (7, 7, 2), (10, 11, 1)], "src long, dst long, n long")
    assert rows_of(graph.transitive_reduction(edges).select("src", "dst")) == [(1, 2), (2, 3), (7, 7), (10, 11)]
    assert rows_of(graph.connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (7, 7), (10, 10), (11, 10)]
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60), 1) for _ in range(45)] + [(100, i, 1) for i in range(101, 160)]
    parent = {v: v for e in pairs for v in e[:2]}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for a, b, _ in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(rows_of(graph.connected_components(spark.createDataFrame(pairs, "src long, dst long, n long"))))
    assert got == {v: root(v) for v in parent}
