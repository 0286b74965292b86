"""Queries that leave nothing out: repeats in the seed join, the long reference, values wider than their field, many outliers."""

import random

from conftest import rows_of

from helixframe.operators import seeds
from helixframe.operators.spikes import seasonal_esd


def test_hot_words_keep_their_seeds(spark):
    word = "ACGTTGCAACGGTTAC"
    df = spark.createDataFrame([(i, word) for i in range(100, 160)], "id long, seq string")
    one = df.where("id = 100")
    every = [(100, i, 0, 0) for i in range(101, 160)]
    assert rows_of(seeds.seed_join(one, df, "id", "id", "seq", 16, no_self=True, salts=8)) == every


def test_queries_take_hot_words(spark, tmp_path):
    import __spark_entry__ as entry

    word = "ACGTTGCAACGGTTAC"
    rows = [(i, f"r{i}", 1, i, word, "", 0.9, 1) for i in range(100, 160)]
    spark.createDataFrame(rows, "read_id long, read_name string, movie_id int, zmw int, basecall string, qual string, rq double, n_passes int").write.parquet(f"{tmp_path}/bas_reads.parquet")
    q = entry.queries()
    assert q["seed_join_dna"](spark, str(tmp_path)).count() == 59
    assert q["chain_global"](spark, str(tmp_path)).count() == 59


def test_long_reference_takes_part(spark, tmp_path):
    import __spark_entry__ as entry

    d, length = str(tmp_path), 4_200_000_000
    spark.createDataFrame([(1, length), (2, 9000)], "ref_seq_id int, ref_length long").write.parquet(f"{d}/ref_info.parquet")
    at = length // 9 * 8
    columns = "aln_id long, movie_id int, hole_number int, ref_seq_id int, rc_ref_strand int, t_start long, t_end long, r_start int, r_end int, map_qv int, n_m int, n_mm int, n_ins int, n_del int, loaded_at long, aligned_at long"
    spark.createDataFrame([(7, 1, 1, 1, 0, at + 10, at + 500, 0, 1, 1, 1, 1, 1, 1, 0, 0)], columns).write.parquet(f"{d}/alignment_index.parquet")
    q = entry.queries()
    assert rows_of(q["cumulative_offsets"](spark, d)) == [(1, length, 0), (2, 9000, length + 1)]
    assert rows_of(q["interval_overlap_roi"](spark, d)) == rows_of(q["exon_containment"](spark, d)) == [(7, 1, 8)]
    assert rows_of(q["exon_best_overlap"](spark, d)) == [(7, 8, 24.5)]


def test_table_keeps_wider_values(spark, tmp_path):
    import __spark_entry__ as entry

    payloads = ['{"IPD": 358.5, "nMM": "53.5", "tEnd": 7, "ClassifierQV": [1, 2, 3, 4], "Chemistry": ["a", "b"]}', '{"IPD": 9, "nMM": "n/a", "ClassifierQV": 0.5, "MapQV": "12"}']
    spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    names = "IPD nMM tEnd ClassifierQV Chemistry MapQV".split()
    spark.createDataFrame([(n, n) for n in names], "col_name string, field_name string").write.parquet(f"{tmp_path}/col_dictionary.parquet")
    got = [tuple(r[n] for n in [*names, "n_uncast"]) for r in entry.queries()["p6_table"](spark, str(tmp_path)).orderBy("record_id").collect()]
    assert got == [(358.5, 53.5, 7, [1.0, 2.0, 3.0, 4.0], '["a", "b"]', None, 0), (9.0, None, None, [0.5], None, 12, 1)]


def test_many_outliers_are_all_flagged(spark):
    rng = random.Random(2)
    stuck = [(i, 1, i, 500.0 if i % 3 == 0 else rng.gauss(0, 1)) for i in range(600)]
    mild = [(i, 1, i, 40.0 + i if i % 5 == 0 else rng.gauss(0, 1)) for i in range(600)]
    for rows, bad in ((stuck, range(0, 600, 3)), (mild, range(0, 600, 5))):
        got = {r.id for r in seasonal_esd(spark.createDataFrame(rows, "id long, src int, pos long, v double"), "src", "id", "pos", "v", 1, 600).collect()}
        assert set(bad) <= got and len(got) <= len(bad) + 3


def test_both_fields_have_the_full_decomposition(spark):
    import __spark_entry__ as entry

    assert {"p2_seasonal_esd", "p2_seasonal_esd_qv"} <= set(entry.queries())


def test_repeat_longer_than_any_bound(spark):
    from helixframe.operators import index

    rng = random.Random(12)
    core = "".join(rng.choice("ACGT") for _ in range(20_000))
    df = spark.createDataFrame([(1, "AAC" + core + "G"), (2, "CCT" + core + "T"), (3, "N" * 50)], "id long, seq string")
    assert index.longest_repeat(df, "seq") == (20_000, 1)
    # A text whose plain polynomial hashes modulo 2^64 collide: only equal letters count.
    morse = "A"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("AC", "CA"))
    text = morse[:2048]
    longest = max(k for k in range(2, 1600, 2) if len({text[i : i + k] for i in range(len(text) - k + 1)}) < len(text) - k + 1)
    assert index.longest_repeat(spark.createDataFrame([(text,)], "seq string"), "seq")[0] in (longest, longest + 1)


def test_numbers_within_and_running_totals(spark):
    from helixframe.sources.scan import numbered_within, running_total

    rng = random.Random(3)
    rows = sorted({(rng.choice("aaab"), rng.randrange(1000), rng.randrange(5)) for _ in range(600)})
    got = rows_of(numbered_within(spark.createDataFrame(rows, "k string, i long, j int"), "k", ["i", "j"], "n", buckets=7).select("k", "i", "j", "n"))
    expected, seen = [], {}
    for k, i, j in rows:
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, i, j, seen[k]))
    assert got == expected
    values = [(i, rng.choice([None, 4, 5_000_000_000])) for i in range(300)]
    total, sums = 0, []
    for i, v in values:
        total += v or 0
        sums.append((i, v, total))
    assert [tuple(r) for r in running_total(spark.createDataFrame(values, "i long, v long"), "i", "v", "s").orderBy("i").select("i", "v", "s").collect()] == sums


def test_gaps_of_several_keys_with_nulls(spark):
    from helixframe.operators.relational import uncovered

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["x", "y"]), s, s + rng.randrange(0, 4000)) for s in (rng.randrange(3_000_000) for _ in range(200))]
    expected = []
    for key in {r[:2] for r in rows}:
        reach = None
        for s, e in sorted(r[2:] for r in rows if r[:2] == key and r[2] < r[3]):
            if reach is not None and s > reach:
                expected.append((*key, reach, s))
            reach = e if reach is None else max(reach, e)
    order = lambda r: tuple(repr(x) for x in r)
    got = uncovered(spark.createDataFrame(rows, "m int, r string, s long, e long"), ["m", "r"], "s", "e")
    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected, key=order)
