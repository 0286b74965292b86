import random

from conftest import rows_of

from helixframe.functions import dp
from helixframe.operators import coverage, mapping


def test_windows_from_tiles(spark):
    rng = random.Random(1)
    contigs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((1, 99, 100, 1234))]
    rows = []
    for i, t in contigs:
        for k in range(12):
            lo = rng.randrange(len(t) + 1)
            rows.append((k, i, 0, lo, rng.randrange(lo, len(t) + 1)))
    found = spark.createDataFrame(rows, "q_id long, t_id long, part int, _lo int, _hi int")
    got = mapping.with_windows(found, spark.createDataFrame(contigs, "t_id long, seq string"), 100)
    assert sorted((r.q_id, r.t_id, r.target) for r in got.collect()) == sorted((q, i, dict(contigs)[i][lo:hi]) for q, i, _, lo, hi in rows)


def test_long_read_on_a_long_contig(spark):
    """A read of 20,000 letters with errors, on a contig of several tiles, turned."""
    rng = random.Random(2)
    contig = "".join(rng.choice("ACGT") for _ in range(150_000))
    read = "".join(rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) if rng.random() < 0.03 else c for c in contig[50_000:70_000])
    turned = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(1, turned), (2, "ACGT" * 30), (3, None)], "read_id long, seq string")
    hits = mapping.map_reads(reads, spark.createDataFrame([(9, contig)], "contig_id long, seq string"), mapping.MapParams(k=16, tile=1 << 14, band=100)).collect()
    assert [(h.read_id, h.contig_id, h.strand, h.is_primary) for h in hits] == [(1, 9, 1, True)]
    assert abs(hits[0].t_start - 50_000) < 50 and abs(hits[0].t_end - 70_000) < 50 and hits[0].pct_similarity > 95 and hits[0].q_end - hits[0].q_start > 19_000


def test_retry_maps_what_the_first_pass_missed(spark):
    rng = random.Random(3)
    contig = "".join(rng.choice("ACGT") for _ in range(3000))
    clean, noisy = contig[100:400], "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i % 12 == 5 else c for i, c in enumerate(contig[1000:1400]))
    reads = spark.createDataFrame([(1, clean), (2, noisy)], "read_id long, seq string")
    contigs = spark.createDataFrame([(9, contig)], "contig_id long, seq string")
    strict, loose = mapping.MapParams(k=20), mapping.MapParams(k=10, max_score=-100)
    assert {h.read_id for h in mapping.map_reads(reads, contigs, strict).collect()} == {1}
    assert {h.read_id for h in mapping.map_with_retry(reads, contigs, strict, loose).collect()} == {1, 2}


def test_insertions_and_columns(spark):
    placed = spark.createDataFrame([("r", i, "I", 3 if i < 4 else 2, 50) for i in range(6)] + [("r", 7, "I", 1, 80), ("r", 8, "D", 4, 50)], "k string, row long, op string, len int, t_from long")
    spans = spark.createDataFrame([("r", i, 10, 90) for i in range(8)] + [("r", 20, 50, 90), ("r", 21, 10, 50)], "k string, row long, s long, e long")
    assert rows_of(coverage.insertion_calls(placed, spans, "k", "row", "s", "e", 2, 0.5).select("k", "t_from", "length", "n_ins", "coverage")) == [("r", 50, 3, 6, 8)]
    columns = spark.createDataFrame([("g", 1, i, "ACGT-"[i % 5]) for i in range(12)], "g string, pos int, row long, base string")
    assert rows_of(coverage.msa_columns(columns, ["g"], "pos", "row", "base", block=10).select("block", "bases", "depth")) == [(0, "ACGT-ACGT-", 10), (1, "AC", 2)]


def test_quality_column(spark):
    pairs = spark.createDataFrame([(1, "ACGT", "ACGT", [1, 2, 3, 4]), (2, "ACGT", None, [1]), (3, "ACGT", "ACGT", None)], "id int, query string, target string, qual array<int>")
    got = mapping.align_pairs(pairs, dp.Scores.named("qv", insertion=20, deletion=20), quality="qual")
    assert rows_of(got.select("id", "score")) == [(1, -10), (2, None), (3, -4)]
