"""Index, annotation, conversion and per-read operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import cigar, seq
from helixframe.functions.kmer_codes import kmer_table
from helixframe.operators import index, mapping
from helixframe.plans.data import ALIGNMENTS, READS, alignments, kmers_sql, reads
from helixframe.plans.relations import _hits, _SEEDS
from helixframe.plans.sequences import _cigars, _DNA
from helixframe.session import table

QUERIES, SQL = {}, {}
S = SparkSession


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {READS}, k AS {kmers_sql(10)} SELECT p.p_partkey, k.read_id, k.pos FROM k JOIN (SELECT p_partkey, substring({_DNA}, 1, 10) AS w FROM part) p ON k.kmer = p.w")
def locate_patterns(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.substring(seq.dna_from_key("p_partkey"), 1, 10).alias("w"))
    return index.locate(p, "p_partkey", "w", reads(spark, d), "read_id", "seq", 10)


@query(f"WITH {READS}, k AS {kmers_sql(6)} SELECT kmer, count(*) AS n, count(DISTINCT read_id) AS n_texts, min(pos) AS first_pos, max(pos) AS last_pos FROM k GROUP BY kmer")
def prefix_table(spark: S, d: str) -> DataFrame:
    return index.prefix_table(reads(spark, d), "read_id", "seq", 6).select(seq.decode_two_bit("kmer", 6).alias("kmer"), "n", "n_texts", "first_pos", "last_pos")


@query(f"""WITH {READS}, k AS {kmers_sql(16)}, h AS (SELECT a.read_id, a.pos, b.read_id AS other, b.pos - a.pos AS diagonal FROM k a JOIN k b ON a.kmer = b.kmer WHERE a.read_id < b.read_id OR (a.read_id = b.read_id AND a.pos < b.pos)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, other, diagonal ORDER BY pos) AS run FROM h), m AS (SELECT read_id, min(pos) AS pos, max(pos) - min(pos) + 16 AS n FROM r GROUP BY read_id, other, diagonal, run)
SELECT CAST(max(n) AS INTEGER) AS length, count(DISTINCT s) AS n_repeats FROM (SELECT n, substring(seq, CAST(pos AS BIGINT) + 1, CAST(n AS BIGINT)) AS s FROM m JOIN reads USING (read_id) WHERE n = (SELECT max(n) FROM m))""")
def longest_repeat(spark: S, d: str) -> DataFrame:
    length, n = index.longest_repeat(reads(spark, d), "seq")
    return spark.range(1).select(F.lit(length).alias("length"), F.lit(n).cast("long").alias("n_repeats"))


@query()
def read_components(spark: S, d: str) -> DataFrame:
    return index.shared_word_components(reads(spark, d), "read_id", "seq", 20)


@query()
def kmer_cardinality_approx(spark: S, d: str) -> DataFrame:
    k = kmer_table(reads(spark, d), "read_id", "seq", 10)
    return k.agg(F.approx_count_distinct("kmer", 0.02).alias("n_distinct"), F.percentile_approx("pos", [0.1, 0.5, 0.9], 1000).alias("positions"))


@query(f"WITH {READS} SELECT read_id, substring(seq, 1, 60) || substring(seq, 101, 60) || substring(seq, 201, 60) AS transcript FROM reads WHERE length(seq) >= 260")
def spliced_sequences(spark: S, d: str) -> DataFrame:
    """Exons cut out and joined in order: each read's stretches at 0, 100 and 200."""
    r = reads(spark, d).where("length(seq) >= 260")
    exons = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(a + 60).alias("end")) for a in (0, 100, 200)))
    return r.select("read_id", F.array_join(F.transform(F.array_sort(exons), lambda e: seq.trim_to(F.col("seq"), e["start"], e["end"])), "").alias("transcript"))


_REPEAT = "A{6,}|C{6,}|G{6,}|T{6,}"


@query(f"WITH {READS} SELECT read_id, regexp_replace(seq, '{_REPEAT}', '', 'g') AS seq, CAST(len(regexp_extract_all(seq, '{_REPEAT}')) AS INTEGER) AS n_excised FROM reads")
def excise_repeats(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", F.regexp_replace("seq", _REPEAT, "").alias("seq"), F.size(F.regexp_extract_all("seq", F.lit(f"({_REPEAT})"), 1)).alias("n_excised"))


@query(f"WITH {READS} SELECT read_id, CAST(n AS INTEGER) AS n, r FROM (SELECT read_id, unnest(range(len(x))) AS n, unnest(x) AS r FROM (SELECT read_id, regexp_extract_all(seq, '{_REPEAT}') AS x FROM reads))")
def extract_repeats(spark: S, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f"({_REPEAT})"), 1)).alias("n", "r"))


@query(f"""WITH {ALIGNMENTS}, v AS (SELECT aln_id, rc_ref_strand AS rc, t_start AS s, n_ins % 7 AS clip, n_m % 50 + 1 AS a, n_ins % 9 + 1 AS i, n_m % 70 + 1 AS b, n_mm % 3 + 1 AS x, n_del % 11 + 1 AS dl, n_m % 90 + 1 AS c FROM alns)
SELECT aln_id, CAST(CASE WHEN rc = 1 THEN 0 ELSE clip END AS INTEGER) AS q_start, CAST(CASE WHEN rc = 1 THEN a + i + b + x + c ELSE clip + a + i + b + x + c END AS INTEGER) AS q_end, s AS t_start, s + a + b + x + dl + c AS t_end,
  CAST(clip + a + i + b + x + c AS INTEGER) AS q_length, CAST(i AS INTEGER) AS n_ins, CAST(dl AS INTEGER) AS n_del, CAST(a + b + x + c AS INTEGER) AS n_aligned FROM v""")
def sam_to_intervals(spark: S, d: str) -> DataFrame:
    """Interval rows of SAM records from the CIGAR alone; a reverse record's read coordinates are turned round."""
    ops = cigar.operations("cigar")
    rows = _cigars(spark, d).withColumn("ops", ops)
    clip = F.when(F.element_at("ops", 1)["op"] == "S", F.element_at("ops", 1)["len"]).otherwise(0)
    o = F.col("ops")
    back = F.col("rc_ref_strand") == 1
    full = clip + cigar.query_span(o)
    return rows.select(
        "aln_id", F.when(back, 0).otherwise(clip).alias("q_start"), F.when(back, cigar.query_span(o)).otherwise(full).alias("q_end"), "t_start", (F.col("t_start") + cigar.ref_span(o)).alias("t_end"),
        full.alias("q_length"), cigar.span(o, "I").alias("n_ins"), cigar.span(o, "DN").alias("n_del"), cigar.span(o, "M=X").alias("n_aligned"),
    )


_OTHER = _DNA.replace("p_partkey", "p_partkey + 1")


@query(f"SELECT p_partkey, list_aggregate(list_transform(range(1, 33), lambda i: translate(substring(a, CAST(i AS BIGINT), 1), 'ACGT', '1248') || translate(substring(b, CAST(i AS BIGINT), 1), 'ACGT', '1248')), 'string_agg', '') AS packed FROM (SELECT p_partkey, {_DNA} AS a, {_OTHER} AS b FROM part)")
def byte_alignment(spark: S, d: str) -> DataFrame:
    """Two gapless rows as one byte a column, query in the high half: A 1, C 2, G 4, T 8, gap 0; shown in hexadecimal."""
    p = table(spark, d, "part").select("p_partkey", seq.dna_from_key("p_partkey").alias("a"), seq.dna_from_key(F.col("p_partkey") + 1).alias("b"))
    nibble = lambda c: F.split(F.translate(c, "ACGT-", "12480"), "")
    return p.select("p_partkey", F.array_join(F.zip_with(nibble("a"), nibble("b"), lambda x, y: F.concat(x, y)), "").alias("packed"))


@query(f"WITH g AS (SELECT p_partkey, translate({_DNA}, 'T', '-') AS g, unnest(range(1, 33)) AS i FROM part) SELECT p_partkey, CAST(i - 1 AS INTEGER) AS col, CAST(sum(CASE WHEN substring(g, CAST(i AS BIGINT), 1) <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS BIGINT) AS pos FROM g".replace("translate(", "replace(", 1))
def gapped_to_ungapped(spark: S, d: str) -> DataFrame:
    """Sequence position at every column of a gapped row; at a gap, that of the last letter before it."""
    g = table(spark, d, "part").select("p_partkey", F.posexplode(F.split(F.replace(seq.dna_from_key("p_partkey"), F.lit("T"), F.lit("-")), "")).alias("col", "letter")).where("letter <> ''")
    w = Window.partitionBy("p_partkey").orderBy("col")
    return g.select("p_partkey", "col", (F.sum(F.when(F.col("letter") != "-", 1).otherwise(0)).over(w) - 1).alias("pos"))


@query(f"WITH {ALIGNMENTS} SELECT movie_id, hole_number, count(*) AS n, count(DISTINCT ref_seq_id) AS n_refs, min(r_start) AS first_base, max(r_end) AS last_base FROM alns WHERE hole_number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT ref_seq_id) > 1")
def chimera_candidates(spark: S, d: str) -> DataFrame:
    """Holes whose alignments lie on more than one reference."""
    a = alignments(spark, d).where("hole_number is not null")
    per = a.groupBy("movie_id", "hole_number", "ref_seq_id").agg(F.count("*").alias("n"), F.min("r_start").alias("a"), F.max("r_end").alias("z"))
    return per.groupBy("movie_id", "hole_number").agg(F.sum("n").alias("n"), F.count("*").alias("n_refs"), F.min("a").alias("first_base"), F.max("z").alias("last_base")).where("n_refs > 1")


_HQ = f"WITH {READS}, {ALIGNMENTS}, hq AS (SELECT movie_id, hole_number AS zmw, min(r_start) AS hq_start, max(r_end) AS hq_end FROM alns GROUP BY ALL)"


@query(f"{_HQ} SELECT r.read_id, hq.hq_start, hq.hq_end, CASE WHEN hq_end > hq_start THEN substring(seq, CAST(hq_start AS BIGINT) + 1, CAST(greatest(hq_end - hq_start, 0) AS BIGINT)) ELSE '' END AS trimmed FROM reads r JOIN hq ON r.movie_id = hq.movie_id AND r.zmw = hq.zmw WHERE hq_start >= 0")
def hq_lookup_join(spark: S, d: str) -> DataFrame:
    """Reads cut to the region table's stretch of their hole; the region here is what the hole's alignments span."""
    hq = alignments(spark, d).groupBy("movie_id", F.col("hole_number").alias("zmw")).agg(F.min("r_start").alias("hq_start"), F.max("r_end").alias("hq_end")).where("hq_start >= 0")
    return reads(spark, d).join(hq, ["movie_id", "zmw"]).select("read_id", "hq_start", "hq_end", seq.trim_to("seq", "hq_start", "hq_end").alias("trimmed"))


@query(f"""WITH r AS (SELECT read_id, any_value(movie_id) AS movie_id, any_value(zmw) AS zmw, any_value(width_in_frames) AS w FROM bas_reads WHERE read_id IS NOT NULL AND width_in_frames IS NOT NULL GROUP BY read_id), {ALIGNMENTS}
SELECT a.aln_id, r.read_id, CAST(len(w[a.r_start + 1 : a.r_end]) AS INTEGER) AS n, CAST(coalesce(list_sum(w[a.r_start + 1 : a.r_end]), 0) AS BIGINT) AS frames FROM alns a JOIN r ON a.movie_id = r.movie_id AND a.hole_number = r.zmw WHERE a.r_start >= 0 AND a.r_end > a.r_start""")
def load_pulses(spark: S, d: str) -> DataFrame:
    """Each alignment's slice of its read's per-base widths."""
    r = table(spark, d, "bas_reads").where("read_id is not null and width_in_frames is not null").dropDuplicates(["read_id"]).select("read_id", "movie_id", F.col("zmw").alias("hole_number"), "width_in_frames")
    a = alignments(spark, d).where("r_start >= 0 and r_end > r_start").join(r, ["movie_id", "hole_number"])
    part = F.slice("width_in_frames", F.col("r_start") + 1, F.col("r_end") - F.col("r_start"))
    total = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    return a.select("aln_id", "read_id", F.size(part).alias("n"), total.alias("frames"))


@query(f"WITH {READS} SELECT read_id, CAST(p AS INTEGER) AS pass, p % 2 = 1 AS is_reverse FROM (SELECT read_id, unnest(range(n_passes)) AS p FROM reads WHERE n_passes > 0)")
def pass_explode(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).where("n_passes > 0").select("read_id", F.explode(F.sequence(F.lit(0), F.col("n_passes") - 1)).alias("pass"))
    return r.select("read_id", "pass", (F.col("pass") % 2 == 1).alias("is_reverse"))


@query(f"{_SEEDS} SELECT * FROM h WHERE abs(t - q) <= 200")
def off_diagonal_filter(spark: S, d: str) -> DataFrame:
    return _hits(spark, d).where("abs(t - q) <= 200")


@query(f"WITH {READS}, k AS {kmers_sql(12)}, u AS (SELECT kmer FROM k GROUP BY kmer HAVING count(*) = 1), x AS (SELECT DISTINCT read_id, pos // 100 AS tile FROM k WHERE kmer IN (SELECT kmer FROM u)), n AS (SELECT read_id, (length(seq) - 1) // 100 + 1 AS tiles FROM reads) SELECT n.read_id, CAST(n.tiles AS INTEGER) AS n_tiles, count(x.tile) AS n_mappable FROM n LEFT JOIN x ON n.read_id = x.read_id GROUP BY ALL")
def mapability(spark: S, d: str) -> DataFrame:
    """How many of a read's 100-letter tiles begin a word of 12 letters that stands nowhere else."""
    from helixframe.plans.sequences import unique_positions

    x = unique_positions(spark, d).select("read_id", F.floor(F.col("pos") / 100).alias("tile")).distinct().groupBy("read_id").agg(F.count("*").alias("n_mappable"))
    n = reads(spark, d).select("read_id", F.expr("cast((length(seq) - 1) div 100 + 1 as int)").alias("n_tiles"))
    return n.join(x, "read_id", "left").fillna(0, ["n_mappable"])


@query(f"WITH {READS} SELECT read_id // 5 AS grp, string_agg(substring(seq, 1, 20), 'CATG' ORDER BY read_id) AS seq FROM reads GROUP BY ALL")
def concatenate_tags(spark: S, d: str) -> DataFrame:
    """Tags of five reads at most joined with an anchor between them, in order of the reads."""
    r = reads(spark, d).select(F.expr("read_id div 5").alias("grp"), "read_id", F.substring("seq", 1, 20).alias("tag"))
    tags = F.transform(F.sort_array(F.collect_list(F.struct("read_id", "tag"))), lambda x: x["tag"])
    return r.groupBy("grp").agg(F.array_join(tags, "CATG").alias("seq"))


@query("SELECT read_id, bool_and(NOT regexp_matches(basecall, '[ACGT]')) AS fully_masked FROM bas_reads WHERE read_id IS NOT NULL AND basecall IS NOT NULL GROUP BY read_id")
def fully_masked_reads(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "bas_reads").where("read_id is not null and basecall is not null")
    return r.groupBy("read_id").agg(F.bool_and(~F.col("basecall").rlike("[ACGT]")).alias("fully_masked"))


@query(f"""WITH m AS (SELECT p_partkey, i, substring(a, CAST(i AS BIGINT), 1) = substring(b, CAST(i AS BIGINT), 1) AS same FROM (SELECT p_partkey, {_DNA} AS a, {_OTHER} AS b, unnest(range(1, 33)) AS i FROM part)),
g AS (SELECT p_partkey, i - row_number() OVER (PARTITION BY p_partkey, same ORDER BY i) AS g, same FROM m) SELECT run_length, count(*) AS n FROM (SELECT count(*) AS run_length FROM g WHERE same GROUP BY p_partkey, g) GROUP BY ALL""")
def match_runs(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", seq.dna_from_key("p_partkey").alias("a"), seq.dna_from_key(F.col("p_partkey") + 1).alias("b"))
    ticks = F.array_join(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: F.when(x == y, "|").otherwise(" ")), "")
    runs = p.select(F.explode(F.regexp_extract_all(F.substring(ticks, 1, 32), F.lit("([|]+)"), 1)).alias("r"))
    return runs.groupBy(F.length("r").cast("long").alias("run_length")).agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT read_id, any_value(qual) AS qual FROM bas_reads WHERE read_id IS NOT NULL GROUP BY read_id), x AS (SELECT CAST(p AS INTEGER) AS pos, v FROM (SELECT unnest(range(len(qual))) AS p, unnest(qual) AS v FROM q)) SELECT pos, count(v) AS n, round(avg(v), 6) AS mean_qv FROM x GROUP BY pos HAVING count(v) > 0")
def qv_profile(spark: S, d: str) -> DataFrame:
    q = table(spark, d, "bas_reads").where("read_id is not null").dropDuplicates(["read_id"]).select(F.posexplode("qual").alias("pos", "v")).where("v is not null")
    return q.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_qv"))


@query(f"WITH {READS}, k AS {kmers_sql(2)} SELECT read_id, bit_or(CAST(1 AS BIGINT) << CAST((instr('ACGT', substring(kmer, 1, 1)) - 1) * 4 + instr('ACGT', substring(kmer, 2, 1)) - 1 AS INTEGER)) AS word_bits FROM k GROUP BY read_id")
def word_match_bits(spark: S, d: str) -> DataFrame:
    """Which of the sixteen two-letter words a read has, as bits."""
    k = kmer_table(reads(spark, d), "read_id", "seq", 2)
    return k.groupBy("read_id").agg(F.bit_or(F.expr("shiftleft(1L, cast(kmer as int))")).alias("word_bits"))


@query(f"WITH {READS} SELECT read_id, read_name FROM reads WHERE length(seq) BETWEEN 200 AND 1000 AND NOT contains(read_name, '/1')")
def filter_sequences(spark: S, d: str) -> DataFrame:
    return reads(spark, d).where(F.length("seq").between(200, 1000) & ~F.col("read_name").contains("/1")).select("read_id", "read_name")


@query()
def mapping_metrics(spark: S, d: str) -> DataFrame:
    from helixframe.plans.mapping_queries import _mapped

    return _mapped(spark, d).agg(
        F.count("*").alias("hits"), F.count_distinct("read_id").alias("reads"), F.sum("n_anchors").alias("anchors"), F.sum(F.col("q_end") - F.col("q_start")).alias("bases"), F.round(F.avg("pct_similarity"), 4).alias("similarity")
    )


@query()
def subread_agreement(spark: S, d: str) -> DataFrame:
    """Successive reads of one hole aligned with each other; they agree if no gap is longer than a tenth of the shorter."""
    w = Window.partitionBy("movie_id", "zmw").orderBy("read_id")
    r = reads(spark, d).where("zmw is not null").select("read_id", F.lag("read_id").over(w).alias("other_id"), F.col("seq").alias("query"), F.lag("seq").over(w).alias("target")).where("target is not null")
    done = mapping.align_pairs(r, mapping.MapParams().scores, "ends_free")
    longest = F.array_max(F.transform(F.filter(cigar.operations("cigar"), lambda o: o["op"].isin("I", "D")), lambda o: o["len"]))
    return done.select("read_id", "other_id", "pct_similarity", F.coalesce(longest, F.lit(0)).alias("longest_gap"), (F.coalesce(longest, F.lit(0)) * 10 <= F.least(F.length("query"), F.length("target"))).alias("agrees"))
