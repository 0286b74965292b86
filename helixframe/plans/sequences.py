"""Scalar functions, predicates and k-mer statistics on reads and derived sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import cigar, seq
from helixframe.functions.kmer_codes import kmer_counts, kmer_table
from helixframe.plans.data import ALIGNMENTS, READS, alignments, kmers_sql, reads
from helixframe.session import table
from helixframe.sources.scan import numbered_within

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


S = SparkSession


@query(f"WITH {READS} SELECT read_id, translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') AS rc FROM reads")
def reverse_complement(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", seq.reverse_complement("seq").alias("rc"))


@query(f"""WITH {ALIGNMENTS} SELECT a.aln_id, CASE WHEN a.rc_ref_strand = 1 THEN r.ref_length - a.t_end ELSE a.t_start END AS strand_start,
  CASE WHEN a.rc_ref_strand = 1 THEN r.ref_length - a.t_start ELSE a.t_end END AS strand_end FROM alns a JOIN ref_info r ON a.ref_seq_id = r.ref_seq_id""")
def rc_coordinates(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).join(table(spark, d, "ref_info").select("ref_seq_id", "ref_length"), "ref_seq_id")
    rc = F.col("rc_ref_strand") == 1
    return a.select(
        "aln_id",
        F.when(rc, seq.rc_position("ref_length", F.col("t_end") - 1)).otherwise(F.col("t_start")).alias("strand_start"),
        F.when(rc, seq.rc_position("ref_length", "t_start") + 1).otherwise(F.col("t_end")).alias("strand_end"),
    )


_DNA = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_NUM = lambda s: f"CAST(list_sum(list_transform(range(1, 13), lambda i: (instr('ACGT', substring({s}, CAST(i AS BIGINT), 1)) - 1) * CAST(pow(4, 12 - i) AS BIGINT))) AS BIGINT)"


@query(f"""SELECT p_partkey, k AS kmer, {_NUM('k')} AS lr, {_NUM('reverse(k)')} AS rl, {_NUM("translate(reverse(k), 'ACGT', 'TGCA')")} AS rc
  FROM (SELECT p_partkey, substring({_DNA}, 1, 12) AS k FROM part)""")
def kmer_encode(spark: S, d: str) -> DataFrame:
    k = table(spark, d, "part").select("p_partkey", F.substring(seq.dna_from_key("p_partkey"), 1, 12).alias("k"))
    return k.select("p_partkey", seq.decode_two_bit(seq.encode_two_bit("k"), 12).alias("kmer"), seq.encode_two_bit("k").alias("lr"), seq.encode_two_bit_rl("k").alias("rl"), seq.encode_two_bit(seq.reverse_complement("k")).alias("rc"))


@query("SELECT read_id, b AS seq, translate(b, 'ACGTNacgtn', '0123489abc') AS packed FROM (SELECT read_id, any_value(basecall) AS b FROM bas_reads WHERE read_id IS NOT NULL AND basecall IS NOT NULL GROUP BY read_id)")
def four_bit_round_trip(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "bas_reads").where("read_id is not null and basecall is not null").dropDuplicates(["read_id"]).withColumn("packed", seq.encode_four_bit("basecall"))
    return r.select("read_id", seq.decode_four_bit("packed").alias("seq"), "packed")


@query(f"""WITH {READS} SELECT read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g'), 'N+', 'N', 'g') AS condensed,
  CAST(len(regexp_extract_all(seq, 'A+|C+|G+|T+|N+')) AS INTEGER) AS n_runs FROM reads""")
def condense_homopolymers(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", seq.condense("seq").alias("condensed"), F.size(seq.homopolymer_runs("seq")).alias("n_runs"))


@query(f"WITH {READS} SELECT substring(r, 1, 1) AS letter, CAST(length(r) AS INTEGER) AS run_length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, 'A+|C+|G+|T+|N+')) AS r FROM reads) GROUP BY ALL")
def homopolymer_histogram(spark: S, d: str) -> DataFrame:
    runs = reads(spark, d).select(F.explode(seq.homopolymer_runs("seq")).alias("r"))
    return runs.groupBy(F.substring("r", 1, 1).alias("letter"), F.length("r").alias("run_length")).agg(F.count("*").alias("n"))


@query(f"""WITH {READS} SELECT read_id, CAST(length(seq) - length(replace(seq, 'A', '')) AS INTEGER) AS a, CAST(length(seq) - length(replace(seq, 'C', '')) AS INTEGER) AS c,
  CAST(length(seq) - length(replace(seq, 'G', '')) AS INTEGER) AS g, CAST(length(seq) - length(replace(seq, 'T', '')) AS INTEGER) AS t,
  round(100.0 * (2 * length(seq) - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) / length(seq), 6) AS gc FROM reads""")
def nucleotide_composition(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select(
        "read_id", *(seq.count_letter("seq", x).alias(x.lower()) for x in "ACGT"), F.round(100.0 * seq.gc_count("seq") / F.length("seq"), 6).alias("gc")
    )


@query(f"""WITH {READS}, w AS (SELECT read_id, CAST(s AS INTEGER) AS start, substring(seq, CAST(s AS BIGINT) + 1, 100) AS w FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 99, 50)) AS s FROM reads)),
x AS (SELECT read_id, start, CAST(200 - length(replace(w, 'G', '')) - length(replace(w, 'C', '')) AS INTEGER) AS gc,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(w, 'A+|C+|G+|T+'), lambda r: length(r))), 0) AS INTEGER) AS max_run,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(w, 'A+'), lambda r: length(r))), 0) AS INTEGER) AS max_a,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(w, 'T+'), lambda r: length(r))), 0) AS INTEGER) AS max_t FROM w)
SELECT *, CAST(dense_rank() OVER (PARTITION BY read_id ORDER BY gc DESC) AS INTEGER) AS gc_rank FROM x""")
def gc_rank_window(spark: S, d: str) -> DataFrame:
    w = reads(spark, d).where(F.length("seq") >= 100).select("read_id", "seq", F.explode(F.expr("sequence(0, length(seq) - 100, 50)")).alias("start"))
    w = w.select("read_id", "start", F.expr("substring(seq, start + 1, 100)").alias("w"))
    x = w.select("read_id", "start", seq.gc_count("w").alias("gc"), seq.longest_run("w").alias("max_run"), seq.longest_run("w", "A").alias("max_a"), seq.longest_run("w", "T").alias("max_t"))
    return x.withColumn("gc_rank", F.dense_rank().over(Window.partitionBy("read_id").orderBy(F.desc("gc"))))


@query(f"WITH {READS} SELECT CAST(length(s) AS INTEGER) AS span, count(*) AS n FROM (SELECT unnest(string_split_regex(seq, 'N+')) AS s FROM reads) WHERE length(s) > 0 GROUP BY ALL")
def ungapped_spans(spark: S, d: str) -> DataFrame:
    spans = reads(spark, d).select(F.explode(F.split("seq", "N+")).alias("s")).where("length(s) > 0")
    return spans.groupBy(F.length("s").alias("span")).agg(F.count("*").alias("n"))


@query(f"WITH {READS} SELECT read_id, CAST(p AS INTEGER) AS pos, letter FROM (SELECT read_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS letter FROM reads) WHERE letter NOT IN ('A', 'C', 'G', 'T')")
def non_acgt_letters(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).where(F.col("seq").rlike("[^ACGT]")).select("read_id", F.posexplode(F.split("seq", "")).alias("pos", "letter"))
    return r.where(~F.col("letter").isin("A", "C", "G", "T") & (F.col("letter") != ""))


@query("SELECT movie_id, substring(md5(movie_name), 1, 10) AS rg_id, '@RG\tID:' || substring(md5(movie_name), 1, 10) || '\tPU:' || movie_name AS line FROM movie_info WHERE movie_name IS NOT NULL")
def md5_read_group(spark: S, d: str) -> DataFrame:
    m = table(spark, d, "movie_info").where("movie_name is not null")
    rg = seq.read_group_id("movie_name")
    return m.select("movie_id", rg.alias("rg_id"), F.concat(F.lit("@RG\tID:"), rg, F.lit("\tPU:"), "movie_name").alias("line"))


_NAME = r"'^([^/]+)/(\d+)/(\d+)_(\d+)'"


@query(f"WITH {READS} SELECT read_id, regexp_extract(read_name, {_NAME}, 1) AS movie, CAST(regexp_extract(read_name, {_NAME}, 2) AS INTEGER) AS hole, CAST(regexp_extract(read_name, {_NAME}, 3) AS INTEGER) AS \"start\", CAST(regexp_extract(read_name, {_NAME}, 4) AS INTEGER) AS \"end\" FROM reads WHERE regexp_matches(read_name, {_NAME})")
def parse_read_name(spark: S, d: str) -> DataFrame:
    parts = seq.parse_read_name("read_name")
    return reads(spark, d).select("read_id", *(c.alias(n) for n, c in parts.items())).where("movie is not null")


@query(f"WITH {READS} SELECT r.read_id, m.movie_name || '/' || r.zmw || '/0_' || length(r.seq) AS title FROM reads r JOIN movie_info m ON r.movie_id = m.movie_id WHERE r.zmw IS NOT NULL AND m.movie_name IS NOT NULL")
def subread_title(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).where("zmw is not null").join(table(spark, d, "movie_info").where("movie_name is not null").select("movie_id", "movie_name"), "movie_id")
    return r.select("read_id", seq.subread_title(F.concat_ws("/", "movie_name", F.col("zmw").cast("string")), F.lit(0), F.length("seq")).alias("title")).where("title is not null")


@query(f"WITH {READS} SELECT read_id, CASE WHEN length(seq) > 100 THEN repeat('N', 50) || substring(seq, 51, length(seq) - 100) || repeat('N', 50) ELSE repeat('N', length(seq)) END AS masked FROM reads")
def mask_region(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", seq.mask_outside("seq", F.lit(50), F.length("seq") - 50).alias("masked"))


@query(f"WITH {READS} SELECT read_id, substring(seq, 51, greatest(length(seq) - 100, 0)) AS trimmed FROM reads WHERE length(seq) > 100")
def trim_region(spark: S, d: str) -> DataFrame:
    return reads(spark, d).where("length(seq) > 100").select("read_id", seq.trim_to("seq", F.lit(50), F.length("seq") - 50).alias("trimmed"))


@query(f"WITH {READS}, q AS (SELECT read_id, len(seq) AS n, list_filter(qual, lambda x: x IS NOT NULL) AS q FROM reads) SELECT read_id, round(list_sum(q) / len(q), 6) AS mean_qv FROM q WHERE n >= 300 AND len(q) > 0 AND list_sum(q) / len(q) >= 10")
def read_filters(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).where("length(seq) >= 300").select("read_id", seq.mean_quality("qual").alias("m"))
    return r.where("m >= 10").select("read_id", F.round("m", 6).alias("mean_qv"))


@query(f"WITH {READS} SELECT read_id, coalesce(list_max(qual) > 0, false) AS has_qual, round(list_sum(list_transform(qual, lambda q: pow(10.0, -q / 10.0))), 6) AS expected_errors FROM reads")
def expected_errors(spark: S, d: str) -> DataFrame:
    known = F.filter("qual", lambda x: x.isNotNull())
    total = F.aggregate(F.transform(known, lambda q: seq.qv_error(q)), F.lit(0.0), lambda a, x: a + x)
    return reads(spark, d).select("read_id", seq.has_quality("qual").alias("has_qual"), F.round(F.when(F.size(known) > 0, total), 6).alias("expected_errors"))


@query("""SELECT event_id, round(-10 * log10(p), 6) AS phred, round(1 / (1 + pow(10.0, value / 100)), 6) AS inv, round(greatest(-p, p - 1) + log10(pow(10, -p - greatest(-p, p - 1)) + pow(10, p - 1 - greatest(-p, p - 1))), 6) AS lse
  FROM (SELECT event_id, value, 1 / (1 + abs(value)) AS p FROM events)""")
def phred_and_log_sum(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", 1 / (1 + F.abs("value")))
    return e.select("event_id", F.round(seq.phred("p"), 6).alias("phred"), F.round(seq.inverse_phred(F.col("value") / 10), 6).alias("inv"), F.round(seq.log10_add(-F.col("p"), F.col("p") - 1), 6).alias("lse"))


@query("""SELECT l_orderkey, l_linenumber, round(exp(-pow((l_quantity - 25) / 14.0, 2) / 2) / (14.0 * sqrt(2 * pi())), 6) AS normal,
  round(exp(l_linenumber * ln(2.5) - 2.5 - lgamma(l_linenumber + 1)), 6) AS poisson,
  round(exp(lgamma(8) - lgamma(l_linenumber + 1) - lgamma(7 - l_linenumber + 1) + l_linenumber * ln(0.3) + (7 - l_linenumber) * ln(0.7)), 6) AS binomial,
  round(0.1 * exp(-0.1 * l_quantity), 6) AS exponential, round(1 - exp(-0.1 * l_quantity), 6) AS exponential_cdf,
  round(pow(0.1, 3) * pow(l_quantity, 2) * exp(-0.1 * l_quantity) / 2, 6) AS gamma FROM lineitem""")
def distributions(spark: S, d: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    six = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", six(seq.normal_pdf(q, F.lit(25.0), F.lit(14.0)), "normal"), six(seq.poisson_pmf(k, F.lit(2.5)), "poisson"),
        six(seq.binomial_pmf(F.lit(7), k, F.lit(0.3)), "binomial"), six(seq.exponential_pdf(q, F.lit(0.1)), "exponential"),
        six(seq.exponential_cdf(q, F.lit(0.1)), "exponential_cdf"), six(seq.gamma_pdf(q, 3, F.lit(0.1)), "gamma"),
    )


@query(f"""WITH {READS} SELECT read_id, round(pow(rq, 12), 6) AS p_match, round((1 - pow(rq, 12)) / ((1 - rq) * pow(rq, 12)), 4) AS waiting FROM (SELECT read_id, CAST(rq AS DOUBLE) AS rq FROM reads) WHERE rq > 0.5 AND rq < 0.999""")
def anchor_expectation(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).select("read_id", F.col("rq").cast("double").alias("rq")).where("rq > 0.5 and rq < 0.999")
    return r.select("read_id", F.round(seq.match_probability("rq", 12), 6).alias("p_match"), F.round(seq.expected_waiting("rq", 12), 4).alias("waiting"))


@query(f"""SELECT p_partkey, CAST(hamming(substring(a, 1, 12), substring(b, 1, 12)) AS INTEGER) AS head, CAST(hamming(substring(a, 1, 6) || right(a, 6), substring(b, 1, 6) || right(b, 6)) AS INTEGER) AS ends, levenshtein(a, b) AS edits
  FROM (SELECT p_partkey, {_DNA} AS a, {_DNA.replace('p_partkey', 'p_partkey + 1')} AS b FROM part)""")
def edit_distances(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", seq.dna_from_key("p_partkey").alias("a"), seq.dna_from_key(F.col("p_partkey") + 1).alias("b"))
    return p.select("p_partkey", seq.hamming(F.substring("a", 1, 12), F.substring("b", 1, 12)).alias("head"), seq.hamming_ends("a", "b").alias("ends"), F.levenshtein("a", "b").cast("long").alias("edits"))


@query("SELECT movie_id, hole_number, count(*) AS n FROM alignment_index WHERE hole_number = 1 OR hole_number = 5 OR hole_number BETWEEN 10 AND 120 GROUP BY ALL")
def hole_ranges(spark: S, d: str) -> DataFrame:
    return table(spark, d, "alignment_index").where(seq.in_ranges("hole_number", "1,5,10-120")).groupBy("movie_id", "hole_number").agg(F.count("*").alias("n"))


@query(f"WITH {READS} SELECT read_id, '>' || read_name || chr(10) || array_to_string(list_transform(range(0, length(seq), 50), lambda i: substring(seq, CAST(i AS BIGINT) + 1, 50)), chr(10)) AS record FROM reads WHERE read_name IS NOT NULL")
def fasta_records(spark: S, d: str) -> DataFrame:
    return reads(spark, d).where("read_name is not null").select("read_id", F.concat(F.lit(">"), "read_name", F.lit("\n"), seq.wrap("seq")).alias("record"))


# Derived CIGARs: clip, matches, insertion, matches, deletion, matches, from the counts of an alignment.
_CIGAR = "(n_ins % 7) || 'S' || (n_m % 50 + 1) || 'M' || (n_ins % 9 + 1) || 'I' || (n_m % 70 + 1) || '=' || (n_mm % 3 + 1) || 'X' || (n_del % 11 + 1) || 'D' || (n_m % 90 + 1) || 'M'"


def _cigars(spark: S, d: str) -> DataFrame:
    n = lambda c, m, p=1: F.concat((F.col(c) % m + p).cast("string"))
    c = F.concat(n("n_ins", 7, 0), F.lit("S"), n("n_m", 50), F.lit("M"), n("n_ins", 9), F.lit("I"), n("n_m", 70), F.lit("="), n("n_mm", 3), F.lit("X"), n("n_del", 11), F.lit("D"), n("n_m", 90), F.lit("M"))
    return alignments(spark, d).select("aln_id", "ref_seq_id", "t_start", "rc_ref_strand", "map_qv", c.alias("cigar"))


@query(f"""WITH {ALIGNMENTS} SELECT aln_id, cigar, CAST(n_m % 50 + n_ins % 9 + n_m % 70 + n_mm % 3 + n_m % 90 + 5 AS INTEGER) AS query_span, CAST(n_m % 50 + n_m % 70 + n_mm % 3 + n_del % 11 + n_m % 90 + 5 AS INTEGER) AS ref_span
  FROM (SELECT *, {_CIGAR} AS cigar FROM alns)""")
def cigar_spans(spark: S, d: str) -> DataFrame:
    ops = cigar.operations("cigar")
    return _cigars(spark, d).select("aln_id", "cigar", cigar.query_span(ops).alias("query_span"), cigar.ref_span(ops).alias("ref_span"))


@query(f"""WITH {ALIGNMENTS}, v AS (SELECT aln_id, n_m % 50 + 1 AS a, n_ins % 9 + 1 AS i, n_m % 70 + n_mm % 3 + 2 AS b, n_del % 11 + 1 AS dl, n_m % 90 + 1 AS c FROM alns)
SELECT aln_id, CAST(0 AS INTEGER) AS block, CAST(0 AS INTEGER) AS q_pos, CAST(0 AS INTEGER) AS t_pos, CAST(a AS INTEGER) AS length FROM v
UNION ALL SELECT aln_id, 1, CAST(a + i AS INTEGER), CAST(a AS INTEGER), CAST(b AS INTEGER) FROM v UNION ALL SELECT aln_id, 2, CAST(a + i + b AS INTEGER), CAST(a + b + dl AS INTEGER), CAST(c AS INTEGER) FROM v""")
def cigar_to_blocks(spark: S, d: str) -> DataFrame:
    b = _cigars(spark, d).select("aln_id", F.posexplode(cigar.blocks(cigar.operations("cigar"))).alias("block", "x"))
    return b.select("aln_id", "block", "x.q_pos", "x.t_pos", "x.length")


@query(f"""WITH {ALIGNMENTS}, f AS (SELECT aln_id, CASE WHEN rc_ref_strand = 1 THEN 16 ELSE 0 END + CASE WHEN map_qv < 10 THEN 256 ELSE 0 END AS flag FROM alns)
SELECT aln_id, CAST(flag AS INTEGER) AS flag, (flag & 16) <> 0 AS is_reverse, (flag & 256) <> 0 AS is_secondary, (flag & 4) <> 0 AS is_unmapped FROM f""")
def sam_flags(spark: S, d: str) -> DataFrame:
    flag = F.when(F.col("rc_ref_strand") == 1, 16).otherwise(0) + F.when(F.col("map_qv") < 10, 256).otherwise(0)
    a = alignments(spark, d).select("aln_id", flag.alias("flag"))
    return a.select("aln_id", "flag", cigar.has_flag("flag", "reverse").alias("is_reverse"), cigar.has_flag("flag", "secondary").alias("is_secondary"), cigar.has_flag("flag", "unmapped").alias("is_unmapped"))


@query(f"""WITH {ALIGNMENTS} SELECT aln_id, round(100.0 * n_m / (n_m + n_mm + n_ins + n_del), 6) AS identity, round(100.0 * (1 - (n_mm + n_ins + n_del) / (r_end - r_start)), 6) AS accuracy FROM alns
WHERE t_end - t_start >= 50 AND r_end > r_start AND 100.0 * n_m / (n_m + n_mm + n_ins + n_del) >= 70 AND 100.0 * (1 - (n_mm + n_ins + n_del) / (r_end - r_start)) >= 70""")
def alignment_filter(spark: S, d: str) -> DataFrame:
    identity = 100.0 * F.col("n_m") / (F.col("n_m") + F.col("n_mm") + F.col("n_ins") + F.col("n_del"))
    accuracy = 100.0 * (1 - (F.col("n_mm") + F.col("n_ins") + F.col("n_del")) / (F.col("r_end") - F.col("r_start")))
    a = alignments(spark, d).where("t_end - t_start >= 50 and r_end > r_start").select("aln_id", identity.alias("i"), accuracy.alias("a"))
    return a.where("i >= 70 and a >= 70").select("aln_id", F.round("i", 6).alias("identity"), F.round("a", 6).alias("accuracy"))


# k-mer statistics


@query(f"WITH {READS}, k AS {kmers_sql(8)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark: S, d: str) -> DataFrame:
    return kmer_counts(reads(spark, d), "read_id", "seq", 8).select(seq.decode_two_bit("kmer", 8).alias("kmer"), "n")


@query(f"""WITH {READS}, k AS {kmers_sql(8)}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), r AS (SELECT translate(reverse(kmer), 'ACGT', 'TGCA') AS rc, kmer, n FROM c)
SELECT least(kmer, rc) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def kmer_count_canonical(spark: S, d: str) -> DataFrame:
    c = kmer_counts(reads(spark, d), "read_id", "seq", 8).select(seq.decode_two_bit("kmer", 8).alias("k"), "n")
    return c.groupBy(F.least("k", seq.reverse_complement("k")).alias("kmer")).agg(F.sum("n").alias("n"))


@query(f"WITH {READS}, k AS {kmers_sql(10)}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_total, count(CASE WHEN n = 1 THEN 1 END) AS n_unique, round(count(CASE WHEN n = 1 THEN 1 END) / sum(n), 6) AS unique_share FROM c")
def kmer_unique(spark: S, d: str) -> DataFrame:
    once = F.count(F.when(F.col("n") == 1, 1))
    return kmer_counts(reads(spark, d), "read_id", "seq", 10).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_total"), once.alias("n_unique"), F.round(once / F.sum("n"), 6).alias("unique_share"))


@query(f"WITH {READS}, k AS {kmers_sql(12)}, c AS (SELECT kmer FROM k GROUP BY kmer HAVING count(*) = 1) SELECT read_id, pos, kmer FROM k WHERE kmer IN (SELECT kmer FROM c)")
def unique_positions(spark: S, d: str) -> DataFrame:
    k = kmer_table(reads(spark, d), "read_id", "seq", 12)
    once = k.groupBy("kmer").agg(F.count("*").alias("n"), F.min("read_id").alias("read_id"), F.min("pos").alias("pos")).where("n = 1")
    return once.select("read_id", "pos", seq.decode_two_bit("kmer", 12).alias("kmer"))


@query(f"WITH {READS}, k AS {kmers_sql(10)} SELECT kmer, read_id, pos, row_number() OVER (PARTITION BY kmer ORDER BY read_id, pos) AS nth FROM k")
def kmer_positions(spark: S, d: str) -> DataFrame:
    k = kmer_table(reads(spark, d), "read_id", "seq", 10)
    return numbered_within(k, "kmer", ["read_id", "pos"], "nth").select(seq.decode_two_bit("kmer", 10).alias("kmer"), "read_id", "pos", "nth")


@query(f"WITH {READS}, " + ", ".join(f"k{k} AS {kmers_sql(k)}" for k in (4, 6, 8)) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, n AS multiplicity, count(*) AS n_kmers FROM (SELECT count(*) AS n FROM k{k} GROUP BY kmer) GROUP BY n" for k in (4, 6, 8)))
def kmer_multiplicity_multi_k(spark: S, d: str) -> DataFrame:
    r = reads(spark, d)
    parts = [kmer_counts(r, "read_id", "seq", k).groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("n_kmers")).select(F.lit(k).alias("k"), "multiplicity", "n_kmers") for k in (4, 6, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {READS}, " + ", ".join(f"k{k} AS {kmers_sql(k)}" for k in (6, 8, 10, 12)) + ", c AS (" + " UNION ALL ".join(f"SELECT {k} AS l, count(*) AS c FROM k{k} GROUP BY kmer" for k in (6, 8, 10, 12)) + ") SELECT CAST(l AS INTEGER) AS l, CAST(n AS INTEGER) AS n, round(sum(CASE WHEN c <= n THEN c ELSE 0 END) / sum(c), 6) AS share FROM c, (SELECT unnest([1, 2, 5, 10]) AS n) GROUP BY ALL")
def word_uniqueness_matrix(spark: S, d: str) -> DataFrame:
    """Share of the positions whose l-letter word occurs n times or less."""
    r = reads(spark, d)
    c = None
    for l in (6, 8, 10, 12):
        part = kmer_counts(r, "read_id", "seq", l).agg(*(F.round(F.sum(F.when(F.col("n") <= n, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias(f"s{n}") for n in (1, 2, 5, 10)))
        part = part.select(F.lit(l).alias("l"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"s{n}").alias("share")) for n in (1, 2, 5, 10)))).alias("x")).select("l", "x.n", "x.share")
        c = part if c is None else c.unionByName(part)
    return c


@query(f"WITH {READS}, k AS {kmers_sql(8)} SELECT read_id, count(*) AS n_words, count(DISTINCT kmer) AS n_distinct FROM k GROUP BY read_id")
def read_word_count(spark: S, d: str) -> DataFrame:
    k = kmer_table(reads(spark, d), "read_id", "seq", 8)
    return k.groupBy("read_id", "kmer").agg(F.count("*").alias("n")).groupBy("read_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


@query(f"""WITH {READS}, c AS (SELECT read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS seq FROM reads),
k AS {kmers_sql(9, 'c')} SELECT kmer, count(*) AS n FROM k GROUP BY kmer""")
def condensed_kmer_count(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).select("read_id", F.regexp_replace("seq", r"([ACGT])\1+", "$1").alias("seq"))
    return kmer_counts(r, "read_id", "seq", 9).select(seq.decode_two_bit("kmer", 9).alias("kmer"), "n")


@query(f"""WITH {READS}, k AS {kmers_sql(12)}, u AS (SELECT kmer FROM k GROUP BY kmer HAVING count(*) = 1), p AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM k WHERE kmer IN (SELECT kmer FROM u))
SELECT read_id, min(pos) AS first_pos, count(*) AS run_length FROM p GROUP BY read_id, g""")
def unique_kmer_runs(spark: S, d: str) -> DataFrame:
    once = unique_positions(spark, d)
    w = Window.partitionBy("read_id").orderBy("pos")
    return once.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("read_id", "g").agg(F.min("pos").alias("first_pos"), F.count("*").alias("run_length")).drop("g")


@query(f"""WITH {READS}, p AS (SELECT substring(a, CAST(i AS BIGINT), 1) AS t, substring(b, CAST(i AS BIGINT), 1) AS q FROM (SELECT {_DNA} AS a, {_DNA.replace('p_partkey', 'p_partkey + 1')} AS b, unnest(range(1, 33)) AS i FROM part))
SELECT t, q, count(*) AS n FROM p GROUP BY CUBE (t, q)""")
def tabulate_pairs_cube(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select(seq.dna_from_key("p_partkey").alias("a"), seq.dna_from_key(F.col("p_partkey") + 1).alias("b"))
    cols = p.select(F.explode(F.arrays_zip(F.split("a", "").alias("t"), F.split("b", "").alias("q"))).alias("x")).select("x.t", "x.q").where("t <> ''")
    return cols.cube("t", "q").agg(F.count("*").alias("n"))
