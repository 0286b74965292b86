"""Joins, set operations, rankings, windows and coverage on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import cigar, seq
from helixframe.operators import coverage, relational, seeds
from helixframe.plans.data import ALIGNMENTS, READS, alignments, kmers_sql, reads
from helixframe.plans.sequences import _CIGAR, _cigars
from helixframe.session import table
from helixframe.sources.scan import running_total

QUERIES, SQL = {}, {}
S = SparkSession


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SEEDS = f"WITH {READS}, k AS {kmers_sql(16)}, h AS (SELECT q.read_id AS q_id, t.read_id AS t_id, q.pos AS q, t.pos AS t FROM k q JOIN k t ON q.kmer = t.kmer WHERE q.read_id % 100 = 0 AND q.read_id <> t.read_id)"
_MEM = f"{_SEEDS}, r AS (SELECT *, q - row_number() OVER (PARTITION BY q_id, t_id, t - q ORDER BY q) AS g FROM h), mem AS (SELECT q_id, t_id, min(q) AS q, min(t) AS t, CAST(max(q) - min(q) + 16 AS INTEGER) AS length FROM r GROUP BY q_id, t_id, t - q, g)"


def _hits(spark: S, d: str) -> DataFrame:
    """Hits of all k-mers, however often they stand in the reads."""
    r = reads(spark, d).select("read_id", "seq")
    return seeds.seed_join(r.where("read_id % 100 = 0"), r, "read_id", "read_id", "seq", 16, no_self=True, salts=8)


def _mems(spark: S, d: str) -> DataFrame:
    return seeds.maximal_matches(_hits(spark, d), 16)


@query(f"{_SEEDS} SELECT * FROM h")
def seed_fixed_k(spark: S, d: str) -> DataFrame:
    """Reads with an id divisible by 100 against all reads."""
    return _hits(spark, d)


@query(f"{_MEM} SELECT * FROM mem")
def seed_join_dna(spark: S, d: str) -> DataFrame:
    return _mems(spark, d)


@query(f"{_MEM} SELECT q_id, t_id, q, t, length FROM (SELECT *, max(length) OVER (PARTITION BY q_id, q) AS m FROM mem) WHERE length = m")
def seed_join_longest(spark: S, d: str) -> DataFrame:
    return seeds.longest_only(_mems(spark, d))


@query(f"{_SEEDS}, a AS (SELECT *, CAST(16 + q % 3 AS INTEGER) AS length FROM h), l AS (SELECT *, lag(q) OVER w AS pq, lag(length) OVER w AS pl FROM a WINDOW w AS (PARTITION BY q_id, t_id, t - q ORDER BY q)) SELECT q_id, t_id, q, t, length FROM l WHERE NOT coalesce(pq = q - 1 AND pl = length + 1, false)")
def anchors_encompassed(spark: S, d: str) -> DataFrame:
    return seeds.drop_encompassed(_hits(spark, d).withColumn("length", (F.col("q") % 3 + 16).cast("int")))


@query(f"{_SEEDS}, a AS (SELECT *, CAST(16 + (q * 7) % 13 AS INTEGER) AS length FROM h), l AS (SELECT *, max(q + length) OVER (PARTITION BY q_id, t_id, t - q ORDER BY q, length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a) SELECT q_id, t_id, q, t, length FROM l WHERE NOT coalesce(reach >= q + length, false)")
def anchors_contained(spark: S, d: str) -> DataFrame:
    return seeds.drop_contained(_hits(spark, d).withColumn("length", (F.col("q") * 7 % 13 + 16).cast("int")))


@query(f"{_MEM}, p AS (SELECT *, CASE WHEN t - lag(t + length) OVER w <= 50 THEN 0 ELSE 1 END AS f FROM mem WINDOW w AS (PARTITION BY q_id, t_id ORDER BY t, q)) SELECT q_id, t_id, q, t, length, CAST(sum(f) OVER (PARTITION BY q_id, t_id ORDER BY t, q ROWS UNBOUNDED PRECEDING) AS INTEGER) AS part FROM p")
def islands_contiguous_matches(spark: S, d: str) -> DataFrame:
    return seeds.contiguous_groups(_mems(spark, d), 50)


@query(f"{_MEM} SELECT *, CAST(sum(length) OVER w AS BIGINT) AS weight, count(*) OVER w AS n_anchors FROM mem WINDOW w AS (PARTITION BY q_id, t_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 500 FOLLOWING)")
def sliding_anchor_window(spark: S, d: str) -> DataFrame:
    return seeds.candidate_windows(_mems(spark, d), 500)


@query(f"WITH {READS}, k AS {kmers_sql(16)}, n AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT k.read_id, k.pos, n.n AS hits FROM k JOIN n ON k.kmer = n.kmer WHERE n.n <= 2")
def repeat_cap(spark: S, d: str) -> DataFrame:
    from helixframe.functions.kmer_codes import kmer_table

    k = kmer_table(reads(spark, d), "read_id", "seq", 16)
    rare = k.groupBy("kmer").agg(F.count("*").alias("hits")).where("hits <= 2")
    return k.join(rare, "kmer").select("read_id", "pos", "hits")


@query("WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT c_custkey, c_name FROM customer), x AS (SELECT l_partkey AS o_custkey, l_orderkey * 10 + l_linenumber AS l_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) SELECT a.o_custkey, a.o_orderkey, x.l_id FROM a JOIN x ON a.o_custkey = x.o_custkey AND a.n = x.n")
def sort_merge_pair_join(spark: S, d: str) -> DataFrame:
    left = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    right = table(spark, d, "lineitem").select(F.col("l_partkey").alias("o_custkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_id"))
    return relational.pair_join(left, right, "o_custkey", "o_orderkey", "l_id")


_OFFSETS = "c AS (SELECT ref_seq_id, ref_length, CAST(sum(ref_length + 1) OVER (ORDER BY ref_seq_id) - ref_length - 1 AS BIGINT) AS offset_pos FROM ref_info)"


def _offsets(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "ref_info").select("ref_seq_id", "ref_length", (F.col("ref_length") + 1).alias("step"))
    return running_total(r, "ref_seq_id", "step", "upto").select("ref_seq_id", "ref_length", (F.col("upto") - F.col("step")).alias("offset_pos"))


@query(f"WITH {_OFFSETS} SELECT * FROM c")
def cumulative_offsets(spark: S, d: str) -> DataFrame:
    return _offsets(spark, d)


@query(f"WITH {_OFFSETS}, p AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 7919 + l_linenumber * 104729) * 97 % (SELECT sum(ref_length + 1) FROM ref_info) AS BIGINT) AS p FROM lineitem) SELECT p.l_orderkey, p.l_linenumber, p.p AS position, c.ref_seq_id FROM p ASOF LEFT JOIN c ON p.p >= c.offset_pos")
def contig_asof_lookup(spark: S, d: str) -> DataFrame:
    """Points over the whole length of all references."""
    total = table(spark, d, "ref_info").agg(F.sum(F.col("ref_length") + 1)).first()[0]
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"(l_orderkey * 7919 + l_linenumber * 104729) * 97L % {total or 1}L").alias("position"))
    return relational.asof_join(points, _offsets(spark, d).select("offset_pos", "ref_seq_id"), None, "position", "offset_pos", "ref_seq_id")


# Regions of interest: of each reference, eight stretches of 2,000 at even distances.
_ROI = "roi AS (SELECT ref_seq_id, CAST(i AS INTEGER) AS roi, ref_length // 9 * i AS roi_start, ref_length // 9 * i + 2000 AS roi_end FROM (SELECT ref_seq_id, ref_length, CAST(unnest(range(1, 9)) AS INTEGER) AS i FROM ref_info))"


def _roi(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "ref_info").select("ref_seq_id", "ref_length", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("roi"))
    return r.select("ref_seq_id", "roi", F.expr("ref_length div 9 * roi").alias("roi_start"), F.expr("ref_length div 9 * roi + 2000").alias("roi_end"))


@query(f"WITH {ALIGNMENTS}, {_ROI} SELECT a.aln_id, r.ref_seq_id, r.roi FROM alns a JOIN roi r ON a.ref_seq_id = r.ref_seq_id AND a.t_start < r.roi_end AND r.roi_start < a.t_end")
def interval_overlap_roi(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).select("aln_id", "ref_seq_id", "t_start", "t_end")
    return relational.interval_overlap_join(a, _roi(spark, d), "ref_seq_id", ("t_start", "t_end"), ("roi_start", "roi_end"), 4096).select("aln_id", "ref_seq_id", "roi")


@query(f"WITH {ALIGNMENTS}, {_ROI} SELECT a.aln_id, r.ref_seq_id, r.roi FROM alns a JOIN roi r ON a.ref_seq_id = r.ref_seq_id AND a.t_start >= r.roi_start AND a.t_end <= r.roi_end")
def exon_containment(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).select("aln_id", "ref_seq_id", "t_start", "t_end")
    return relational.interval_overlap_join(a, _roi(spark, d), "ref_seq_id", ("t_start", "t_end"), ("roi_start", "roi_end"), 4096, kind="contained").select("aln_id", "ref_seq_id", "roi")


@query(f"""WITH {ALIGNMENTS}, {_ROI}, o AS (SELECT a.aln_id, r.roi, round(100.0 * (least(a.t_end, r.roi_end) - greatest(a.t_start, r.roi_start)) / (greatest(a.t_end, r.roi_end) - least(a.t_start, r.roi_start)), 6) AS overlap
  FROM alns a JOIN roi r ON a.ref_seq_id = r.ref_seq_id AND a.t_start < r.roi_end AND r.roi_start < a.t_end)
SELECT aln_id, roi, overlap FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY overlap DESC, roi) AS n FROM o) WHERE n = 1""")
def exon_best_overlap(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).select("aln_id", "ref_seq_id", "t_start", "t_end")
    pairs = relational.interval_overlap_join(a, _roi(spark, d), "ref_seq_id", ("t_start", "t_end"), ("roi_start", "roi_end"), 4096)
    return relational.best_overlap(pairs, ["aln_id"], ("t_start", "t_end"), ("roi_start", "roi_end"), "roi").select("aln_id", "roi", "overlap")


@query(f"""WITH {ALIGNMENTS} SELECT aln_id FROM alns a WHERE NOT EXISTS (SELECT 1 FROM alns b WHERE b.movie_id IS NOT DISTINCT FROM a.movie_id AND b.hole_number IS NOT DISTINCT FROM a.hole_number AND b.ref_seq_id = a.ref_seq_id AND b.rc_ref_strand = a.rc_ref_strand
  AND b.aln_id <> a.aln_id AND b.t_start <= a.t_start AND b.t_end >= a.t_end AND b.map_qv >= a.map_qv AND NOT (b.t_start = a.t_start AND b.t_end = a.t_end AND b.map_qv = a.map_qv AND b.aln_id > a.aln_id))""")
def contained_alignments(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).withColumn("score", -F.col("map_qv"))
    return relational.drop_contained_intervals(a, ["movie_id", "hole_number", "ref_seq_id", "rc_ref_strand"], "t_start", "t_end", "score", "aln_id", 8192).select("aln_id")


@query("SELECT doc_id, lang FROM documents WHERE source IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 50)")
def semi_extract_by_title(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(docs.groupBy("source").agg(F.count("*").alias("n")).where("n >= 50"), "source", "left_semi").select("doc_id", "lang")


@query(f"WITH {READS} SELECT read_id, zmw FROM reads r WHERE NOT EXISTS (SELECT 1 FROM alignment_index a WHERE a.movie_id = r.movie_id AND a.hole_number = r.zmw)")
def anti_unaligned(spark: S, d: str) -> DataFrame:
    a = table(spark, d, "alignment_index").select("movie_id", F.col("hole_number").alias("zmw"))
    return reads(spark, d).select("read_id", "movie_id", "zmw").join(a, ["movie_id", "zmw"], "left_anti").select("read_id", "zmw")


@query(f"WITH {ALIGNMENTS}, m AS (SELECT *, max(t_end) OVER (PARTITION BY movie_id, ref_seq_id ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM alns) SELECT movie_id, ref_seq_id, reach AS gap_start, t_start AS gap_end FROM m WHERE reach < t_start")
def uncovered_spans(spark: S, d: str) -> DataFrame:
    return relational.uncovered(alignments(spark, d), ["movie_id", "ref_seq_id"], "t_start", "t_end")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_orderkey % 7 <> 0), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_tax FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN b.l_orderkey IS NULL THEN 'only_a' WHEN a.l_orderkey IS NULL THEN 'only_b' WHEN a.l_quantity = b.l_quantity AND a.l_tax = b.l_tax THEN 'equal' ELSE 'changed' END AS verdict
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def compare_sets_outer(spark: S, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    b = l.where("l_orderkey % 5 <> 0").withColumn("l_quantity", F.when(F.col("l_orderkey") % 11 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return relational.compare_sets(l.where("l_orderkey % 7 <> 0"), b, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("WITH t AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS title_id FROM (SELECT DISTINCT n_name FROM nation)) SELECT c_custkey, title_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN t USING (n_name)")
def dictionary_title_table(spark: S, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    titles = relational.title_table(nation, "n_name")
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name").join(titles, "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(names, "c_nationkey").select("c_custkey", "title_id")


_DNA = lambda k: f"translate(md5(CAST({k} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH {READS}, p AS (SELECT p_partkey, substring({_DNA('p_partkey')}, 1, 8) AS probe FROM part WHERE p_partkey % 100 = 0), x AS (SELECT read_id, CAST(i AS INTEGER) AS pos, substring(seq, CAST(i AS BIGINT) + 1, 8) AS w FROM (SELECT read_id, seq, unnest(range(length(seq) - 7)) AS i FROM reads))
SELECT p_partkey, read_id, pos, CAST(hamming(probe, w) AS INTEGER) AS mismatches FROM p, x WHERE hamming(probe, w) <= 1""")
def hamming_scan(spark: S, d: str) -> DataFrame:
    """Places of short probes in all reads with one mismatch or none.

    A probe stands for itself and all words one letter from it, N among them, so the join is an exact one on whole words and every
    match is met once: no theta join, and no key shorter than a probe.
    """
    probes = table(spark, d, "part").where("p_partkey % 100 = 0").select("p_partkey", F.substring(seq.dna_from_key("p_partkey"), 1, 8).alias("probe"))
    letters = F.array(*(F.lit(x) for x in "ACGTN"))
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.transform(letters, lambda x: F.concat(F.substring("probe", F.lit(1), i - 1), x, F.substring("probe", i + 1, F.lit(8))))))
    words = probes.select("p_partkey", "probe", F.explode(F.array_distinct(near)).alias("w"))
    windows = reads(spark, d).where("length(seq) >= 8").select("read_id", "seq", F.explode(F.expr("sequence(0, length(seq) - 8)")).alias("pos")).select("read_id", "pos", F.expr("substring(seq, pos + 1, 8)").alias("w"))
    return windows.join(words, "w").select("p_partkey", "read_id", "pos", seq.hamming("probe", "w").alias("mismatches"))


# coverage


@query(f"WITH {ALIGNMENTS}, b AS (SELECT ref_seq_id, t_start, t_end, unnest(range(t_start // 1000, (t_end - 1) // 1000 + 1)) AS bin FROM alns WHERE map_qv >= 10) SELECT ref_seq_id, bin, CAST(sum(least(t_end, (bin + 1) * 1000) - greatest(t_start, bin * 1000)) AS BIGINT) AS bases, round(sum(least(t_end, (bin + 1) * 1000) - greatest(t_start, bin * 1000)) / 1000, 6) AS mean_coverage FROM b GROUP BY ALL")
def coverage_binned(spark: S, d: str) -> DataFrame:
    return coverage.binned_coverage(alignments(spark, d).where("map_qv >= 10"), "ref_seq_id", "t_start", "t_end", 1000)


@query(f"""WITH {ALIGNMENTS}, b AS (SELECT ref_seq_id, t_start, t_end, unnest(range(t_start // 1048576, (t_end - 1) // 1048576 + 1)) AS bin FROM alns), e AS (SELECT ref_seq_id, bin, greatest(t_start, bin * 1048576) AS p, 1 AS d FROM b UNION ALL SELECT ref_seq_id, bin, least(t_end, (bin + 1) * 1048576), -1 FROM b),
s AS (SELECT ref_seq_id, bin, p, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0), w AS (SELECT ref_seq_id, p AS from_pos, lead(p) OVER x AS to_pos, CAST(sum(d) OVER x AS BIGINT) AS depth FROM s WINDOW x AS (PARTITION BY ref_seq_id, bin ORDER BY p)) SELECT * FROM w WHERE depth > 0 AND to_pos IS NOT NULL""")
def coverage_sweep(spark: S, d: str) -> DataFrame:
    return coverage.coverage_steps(alignments(spark, d), "ref_seq_id", "t_start", "t_end")


@query(f"WITH {ALIGNMENTS}, b AS (SELECT ref_seq_id, t_start, t_end, unnest(range(t_start // 500, (t_end - 1) // 500 + 1)) AS bin FROM alns WHERE map_qv >= 30 AND t_end - t_start >= 300), x AS (SELECT ref_seq_id, bin, least(bin * 500 + 250 - t_start, t_end - bin * 500 - 250) AS m FROM b) SELECT ref_seq_id, bin, max(m) AS support, count(*) AS n FROM x WHERE m >= 0 GROUP BY ALL")
def max_support(spark: S, d: str) -> DataFrame:
    return coverage.end_support(alignments(spark, d).where("map_qv >= 30"), "ref_seq_id", "t_start", "t_end", 500, 300)


_PLACED = f"""WITH {ALIGNMENTS}, v AS (SELECT aln_id, ref_seq_id, t_start AS s, n_m % 50 + 1 AS a, n_ins % 9 + 1 AS i, n_m % 70 + n_mm % 3 + 2 AS b, n_del % 11 + 1 AS dl, n_m % 90 + 1 AS c FROM alns),
o AS (SELECT aln_id, ref_seq_id, 'M' AS op, a AS len, s AS f FROM v UNION ALL SELECT aln_id, ref_seq_id, 'I', i, s + a FROM v UNION ALL SELECT aln_id, ref_seq_id, 'M', b, s + a FROM v UNION ALL SELECT aln_id, ref_seq_id, 'D', dl, s + a + b FROM v UNION ALL SELECT aln_id, ref_seq_id, 'M', c, s + a + b + dl FROM v),
x AS (SELECT ref_seq_id, bin, op, least(f + len, (bin + 1) * 1000) - greatest(f, bin * 1000) AS n FROM (SELECT *, unnest(range(f // 1000, (f + len - 1) // 1000 + 1)) AS bin FROM o WHERE op <> 'I') UNION ALL SELECT ref_seq_id, f // 1000, op, len FROM o WHERE op = 'I'),
cons AS (SELECT ref_seq_id, bin, CAST(sum(CASE WHEN op = 'M' THEN n ELSE 0 END) AS BIGINT) AS m, CAST(sum(CASE WHEN op = 'D' THEN n ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN op = 'I' THEN n ELSE 0 END) AS BIGINT) AS i FROM x GROUP BY ALL)"""


def _placed(spark: S, d: str) -> DataFrame:
    return coverage.operations_on_reference(_cigars(spark, d).select("aln_id", "ref_seq_id", "t_start", cigar.operations("cigar").alias("ops")), "ops", "t_start")


@query(f"{_PLACED} SELECT * FROM cons")
def consensus_counts(spark: S, d: str) -> DataFrame:
    return coverage.consensus_counts(_placed(spark, d), "ref_seq_id", 1000)


@query(f"{_PLACED} SELECT *, round(i / (m + d), 6) AS ins_ratio, round(d / (m + d), 6) AS del_ratio FROM cons WHERE m + d > 0 AND (round(i / (m + d), 6) > 0.08 OR round(d / (m + d), 6) > 0.08)")
def gappy_regions(spark: S, d: str) -> DataFrame:
    return coverage.gappy_bins(coverage.consensus_counts(_placed(spark, d), "ref_seq_id", 1000), 0.08)


@query(f"{_PLACED} SELECT aln_id, op, f AS t_from, CAST(len AS INTEGER) AS len, CAST(1 AS BIGINT) AS n_parts FROM o WHERE op IN ('I', 'D') AND len >= 8")
def gap_listing(spark: S, d: str) -> DataFrame:
    return coverage.merged_gaps(_placed(spark, d), "aln_id", 10, 8)


_COLS = f"c AS (SELECT p_size AS k, CAST(i AS INTEGER) AS pos, substring({_DNA('p_partkey % 3')}, CAST(i AS BIGINT), 1) AS base, substring({_DNA('p_size')}, CAST(i AS BIGINT), 1) AS ref FROM (SELECT p_size, p_partkey, unnest(range(1, 33)) AS i FROM part))"


def _columns(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("k"), seq.dna_from_key(F.col("p_partkey") % 3).alias("a"), seq.dna_from_key("p_size").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(32))).alias("pos"))
    return p.select("k", "pos", F.expr("substring(a, pos, 1)").alias("base"), F.expr("substring(b, pos, 1)").alias("ref"))


@query(f"""WITH {_COLS}, n AS (SELECT k, pos, ref, base, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT k, pos, ref, CAST(sum(n) AS BIGINT) AS coverage, first(base ORDER BY n DESC, instr('ACGT-', base)) AS consensus, max(n) AS support FROM n GROUP BY ALL),
w AS (SELECT *, round(avg(coverage) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS mean_coverage FROM p)
SELECT k, pos, CASE WHEN consensus = '-' THEN 'deletion' ELSE 'snv' END AS kind, ref, consensus AS alt, support, mean_coverage FROM w WHERE consensus <> ref""")
def snv_calls(spark: S, d: str) -> DataFrame:
    return coverage.call_variants(coverage.column_profile(_columns(spark, d), ["k", "pos", "ref"], "base"), "k", "pos", "ref")


@query(f"""{_PLACED}, i AS (SELECT ref_seq_id, f, len, count(*) AS n FROM o WHERE op = 'I' GROUP BY ALL), s AS (SELECT ref_seq_id, f, CAST(sum(n) AS BIGINT) AS n_ins, first(len ORDER BY n DESC, len) AS length FROM i GROUP BY ALL HAVING sum(n) >= 1),
e AS (SELECT ref_seq_id, s, s + a + b + dl + c AS e FROM v)
SELECT s.ref_seq_id, s.f AS t_from, CAST(s.length AS INTEGER) AS length, s.n_ins, count(*) AS coverage FROM s JOIN e ON s.ref_seq_id = e.ref_seq_id AND e.s < s.f AND s.f < e.e GROUP BY ALL HAVING s.n_ins >= 0.25 * count(*)""")
def insertion_calls(spark: S, d: str) -> DataFrame:
    placed = _placed(spark, d)
    spans = placed.groupBy("ref_seq_id", "aln_id").agg(F.min("t_from").alias("s"), F.max(F.col("t_from") + F.when(F.col("op") == "I", 0).otherwise(F.col("len"))).alias("e"))
    return coverage.insertion_calls(placed, spans, "ref_seq_id", "aln_id", "s", "e", 1, 0.25)


@query(f"SELECT k, pos, CAST(p_partkey // 1000 AS BIGINT) AS block, string_agg(base, '' ORDER BY p_partkey) AS bases, count(*) AS depth FROM ({_COLS.replace('c AS (SELECT', 'SELECT p_partkey,', 1)[:-1]}) GROUP BY ALL")
def msa_columns(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("k"), seq.dna_from_key(F.col("p_partkey") % 3).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(32))).alias("pos"))
    return coverage.msa_columns(p.select("p_partkey", "k", "pos", F.expr("substring(a, pos, 1)").alias("base")), ["k"], "pos", "p_partkey", "base")


@query(f"WITH {ALIGNMENTS} SELECT ref_seq_id, t_start // 10000 AS bin, count(*) AS n, round(avg(map_qv), 6) AS mean_qv FROM alns WHERE map_qv IS NOT NULL GROUP BY ALL")
def mapqv_track(spark: S, d: str) -> DataFrame:
    a = alignments(spark, d).where("map_qv is not null")
    return a.groupBy("ref_seq_id", F.expr("t_start div 10000").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("map_qv"), 6).alias("mean_qv"))


@query(f"""WITH {ALIGNMENTS} SELECT movie_id, count(*) AS n_alignments, CAST(sum(t_end - t_start) AS BIGINT) AS bases, round(CAST(sum(n_mm + n_ins + n_del) AS DOUBLE) / sum(n_m + n_mm + n_ins + n_del), 6) AS error_rate,
  round(avg(100.0 * n_m / (n_m + n_mm + n_ins + n_del)), 6) AS mean_identity, round(var_pop(t_end - t_start), 4) AS length_variance FROM alns GROUP BY ROLLUP (movie_id)""")
def alignment_battery(spark: S, d: str) -> DataFrame:
    total = F.col("n_m") + F.col("n_mm") + F.col("n_ins") + F.col("n_del")
    return alignments(spark, d).rollup("movie_id").agg(
        F.count("*").alias("n_alignments"), F.sum(F.col("t_end") - F.col("t_start")).alias("bases"), F.round(F.sum(total - F.col("n_m")).cast("double") / F.sum(total), 6).alias("error_rate"),
        F.round(F.avg(100.0 * F.col("n_m") / total), 6).alias("mean_identity"), F.round(F.var_pop(F.col("t_end") - F.col("t_start")), 4).alias("length_variance"),
    )


@query(f"WITH {ALIGNMENTS} SELECT CAST(floor(20.0 * n_m / (n_m + n_mm + n_ins + n_del)) AS BIGINT) AS identity_bin, t_end - t_start AS span, count(*) AS n FROM alns GROUP BY ALL")
def identity_histogram(spark: S, d: str) -> DataFrame:
    total = F.col("n_m") + F.col("n_mm") + F.col("n_ins") + F.col("n_del")
    return alignments(spark, d).groupBy(F.floor(20.0 * F.col("n_m") / total).alias("identity_bin"), (F.col("t_end") - F.col("t_start")).alias("span")).agg(F.count("*").alias("n"))


# rankings


def _ranked(policy: str, n: int = 10):
    def f(spark: S, d: str) -> DataFrame:
        hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return relational.best_hits(hits, "l_orderkey", "l_quantity", ["l_linenumber"], n, policy)

    return f


_RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber)"
_RANKED = f"SELECT l_orderkey, l_linenumber, l_quantity, CAST(r AS INTEGER) AS hit_rank, r = 1 AS is_primary FROM (SELECT *, {_RANK} AS r, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k FROM lineitem)"
QUERIES |= {"bestn_per_read": _ranked("bestn", 3), "hit_policy_all": _ranked("all"), "hit_policy_allbest": _ranked("allbest"), "hit_policy_random": _ranked("random"), "placement_random": _ranked("randombest")}
SQL |= {"bestn_per_read": _RANKED + " WHERE r <= 3", "hit_policy_all": _RANKED, "hit_policy_allbest": _RANKED + " WHERE k = 1"}


@query("SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(-10 * log10(greatest(1 - p, 1e-25)), 6) AS qv FROM (SELECT l_orderkey, l_linenumber, pow(10, -l_quantity / 10 + m) / sum(pow(10, -l_quantity / 10 + m)) OVER (PARTITION BY l_orderkey) AS p FROM (SELECT *, min(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem))")
def log_sum_exp_mapq(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    x = -F.col("l_quantity") / 10
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (x - F.max(x).over(w)).alias("x"))
    p = F.pow(F.lit(10.0), "x") / F.sum(F.pow(F.lit(10.0), "x")).over(w)
    return l.select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"), F.round(-10 * F.log10(F.greatest(1 - F.col("p"), F.lit(1e-25))), 6).alias("qv"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 4)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n > 10 AND (n - 11) % 7 = 0")
def stride_start_scan(spark: S, d: str) -> DataFrame:
    from helixframe.sources.scan import strided

    return strided(table(spark, d, "documents").select("doc_id"), "doc_id", 10, 7)


# set operations

_A, _B = "SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'"


def _flagged(spark: S, d: str, flag: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))


@query(f"{_A} INTERSECT {_B}")
def intersect_sets(spark: S, d: str) -> DataFrame:
    return _flagged(spark, d, "R").intersect(_flagged(spark, d, "N"))


@query(f"{_A} EXCEPT ALL {_B}")
def except_all_sets(spark: S, d: str) -> DataFrame:
    return _flagged(spark, d, "R").exceptAll(_flagged(spark, d, "N"))


@query(f"SELECT DISTINCT * FROM ({_A})")
def distinct_fragments(spark: S, d: str) -> DataFrame:
    return _flagged(spark, d, "R").distinct()


@query(f"WITH {READS} SELECT read_id, CAST(0 AS INTEGER) AS strand, seq FROM reads UNION ALL SELECT read_id, 1, translate(reverse(seq), 'ACGT', 'TGCA') FROM reads")
def union_strands(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).select("read_id", "seq")
    return r.select("read_id", F.lit(0).alias("strand"), "seq").unionByName(r.select("read_id", F.lit(1).alias("strand"), seq.reverse_complement("seq").alias("seq")))
