from conftest import rows_of
from pyspark.sql import functions as F

from helixframe.sources import formats, readers, scan
from helixframe.streaming import events


def test_fasta_round_trip(spark, tmp_path):
    rows = [("r1 first", "ACGT" * 40), ("r2", "TTG"), (None, "A")]
    readers.write_fasta(spark.createDataFrame(rows, "title string, seq string"), str(tmp_path / "x.fasta"), "title", "seq")
    got = readers.read_fasta(spark, str(tmp_path / "x.fasta"))
    assert rows_of(got.select("name", "title", "seq", "length")) == [("r1", "r1 first", "ACGT" * 40, 160), ("r2", "r2", "TTG", 3)]
    assert readers.load_reads(spark, str(tmp_path / "x.fasta")).count() == 2


def test_fastq_round_trip(spark, tmp_path):
    rows = [("a", "ACGT", [31, 0, 2, 3]), ("b x", "GG", [31, 31])]  # 31 is written as @
    readers.write_fastq(spark.createDataFrame(rows, "title string, seq string, qual array<smallint>"), str(tmp_path / "x.fastq"), "title", "seq", "qual")
    got = readers.read_fastq(spark, str(tmp_path / "x.fastq"))
    assert sorted((r.title, r.seq, list(r.qual)) for r in got.collect()) == rows


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:c1\tLN:9\n@RG\tID:ab\nq1\t16\tc1\t3\t60\t4M\t*\t0\t4\tACGT\t*\tAS:i:-20\tRG:Z:ab\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tGG\t*\n")
    got = readers.read_sam(spark, str(tmp_path / "x.sam")).orderBy("qname").collect()
    assert (got[0].flag, got[0].pos, got[0].tags) == (16, 3, {"AS": "-20", "RG": "ab"}) and got[1].tags == {}
    assert {(r.kind, tuple(sorted(r.fields.items()))) for r in readers.read_sam_header(spark, str(tmp_path / "x.sam")).collect()} == {("SQ", (("LN", "9"), ("SN", "c1"))), ("RG", (("ID", "ab"),))}
    (tmp_path / "l.fofn").write_text(f"{tmp_path}/x.sam\n\n")
    assert readers.read_sam(spark, str(tmp_path / "l.fofn")).count() == 2


def test_annotations(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#c\nchr1\ths\texon\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "n"; level 2;\n')
    r = readers.read_gtf(spark, str(tmp_path / "g.gtf")).first()
    assert (r.chr, r.start, r.gene_id, r.transcript_id, r.level) == ("chr1", 5, "G1", "T1", 2)
    (tmp_path / "r.out").write_text("SW  perc\n\n 463 1.3 0.6 1.7 chr1 10001 10468 (249240153) + (TAACCC)n Simple_repeat 1 471 (0) 1\n")
    r = readers.read_repeatmasker(spark, str(tmp_path / "r.out")).first()
    assert (r.sw_score, r.left, r.repeat, r.r_left) == (463, 249240153, "(TAACCC)n", 0)


def test_format_lines(spark, tmp_path):
    row = dict(q_name="m/1", t_name="c", strand=1, q_start=2, q_end=8, q_length=10, t_start=5, t_end=11, t_length=20, score=-20, pct_similarity=100.0, map_qv=254, weight=6, cigar="6=", is_primary=True, seq="AACCGGTTAC", n_match=6, n_mismatch=0, n_ins=0, n_del=0, q_string="ACCGGT", ticks="||||||", t_string="ACCGGT")
    df = spark.createDataFrame([row])
    line = lambda d: d.first().line
    assert line(formats.m4(df)) == "m/1 c -20 100.0000 0 2 8 10 1 9 15 20 254"
    assert line(formats.m1(df)) == "m/1 c 0 1 -20 100.0000 9 15 20 2 8 10 6"
    assert line(formats.m3_vulgar(df)).endswith("- -20 M 6 6")
    sam = line(formats.sam_body(df)).split("\t")
    assert sam[1] == "16" and sam[3] == "6" and sam[5] == "2S6=2S" and len(sam[9]) == 10
    assert len(line(formats.sam_body(df, "hard")).split("\t")[9]) == 6
    assert "<query>ACCGGT</query>" in line(formats.m2_xml(df)) and line(formats.m0_stick(df)).count("\n") == 3
    formats.m4(df).write.text(str(tmp_path / "m4"))
    assert readers.read_m4(spark, str(tmp_path / "m4")).first().mapqv == 254


def test_scans(spark):
    df = spark.range(100).withColumn("k", F.col("id") * 3)
    assert rows_of(scan.strided(df, "k", 5, 30).select("id")) == [(5,), (35,), (65,), (95,)]
    assert scan.skip(df, "k", 90).count() == 10
    assert rows_of(scan.subsample(df, "id", 0.3, 1)) == rows_of(scan.subsample(df.repartition(5), "id", 0.3, 1))


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 03:00:00", "a"), (3, "2024-01-01 03:00:00", "a")]
    df = spark.createDataFrame(rows, "id long, ts string, u string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(d, mode):
        q = d.writeStream.format("memory").queryName(f"t_{mode}_{abs(hash(str(d.schema)))}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{abs(hash(str(d.schema)))}")).start()
        q.awaitTermination(60)
        return spark.table(q.name)

    assert rows_of(run(events.window_counts(stream, "ts", ["u"], "1 hour"), "complete").select("n")) == rows_of(events.window_counts(df, "ts", ["u"], "1 hour").select("n"))
    assert rows_of(run(events.deduplicated(stream, "ts", ["id"]), "append").select("id")) == [(1,), (2,), (3,)]
    assert rows_of(events.sessions(df, "ts", ["u"], "1 hour").select("n")) == [(2,), (2,)]
    reads = spark.createDataFrame([(1, "ACGTACGTAA"), (2, None)], "read_id long, seq string")
    contigs = spark.createDataFrame([(7, "GGACGTACGT"), (8, "CCCCCCCC")], "contig_id long, seq string")
    assert rows_of(events.stream_seed_counts(reads, contigs, 8)) == [(1, 7, 1)]


def test_fastq_in_splits(spark, tmp_path):
    """Records are found at any split, also with qualities that begin with @ or +, titles on the + line and no end of line."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.choice([1, 3, 60])
        rows.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), rng.choice("@+!") + "".join(chr(33 + rng.randrange(90)) for _ in range(n - 1))))
    text = "".join(f"@{t}\n{s}\n+{t if i % 3 else ''}\n{q}\n" for i, (t, s, q) in enumerate(rows))
    (tmp_path / "a.fastq").write_text(text.rstrip("\n"))
    (tmp_path / "b.fastq").write_text(text.replace("\n", "\r\n").replace("@r", "@s"))
    expected = sorted((t, s, [ord(x) - 33 for x in q]) for t, s, q in rows)
    for split in (97, 1000, 1 << 26):
        got = sorted((r.title, r.seq, list(r.qual)) for r in readers.read_fastq(spark, str(tmp_path / "a.fastq"), split).collect())
        assert got == expected
    assert readers.read_fastq(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")], 500).count() == 600
    (tmp_path / "c.fastq").write_text("")
    assert readers.read_fastq(spark, str(tmp_path / "c.fastq")).count() == 0
