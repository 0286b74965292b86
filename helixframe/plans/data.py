"""The test tables as the operators' inputs, in Spark and, word for word the same, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import table


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with bases, repeats taken out: read_id, read_name, movie_id, zmw, seq (capitals), qual, rq, n_passes."""
    rows = table(spark, sf_dir, "bas_reads").where("read_id is not null and length(basecall) > 0").dropDuplicates(["read_id"])
    return rows.select("read_id", "read_name", "movie_id", "zmw", F.upper("basecall").alias("seq"), "qual", "rq", "n_passes")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with sound bounds on a known reference, of any length, repeats taken out."""
    lengths = table(spark, sf_dir, "ref_info").select("ref_seq_id", "ref_length")
    rows = table(spark, sf_dir, "alignment_index").drop("loaded_at", "aligned_at").where("ref_seq_id is not null and t_start >= 0 and t_start < t_end")
    return rows.join(lengths, "ref_seq_id").where("t_end <= ref_length").drop("ref_length").dropDuplicates(["aln_id"])


READS = "reads AS (SELECT read_id, any_value(read_name) AS read_name, any_value(movie_id) AS movie_id, any_value(zmw) AS zmw, upper(any_value(basecall)) AS seq, any_value(qual) AS qual, any_value(rq) AS rq, any_value(n_passes) AS n_passes FROM bas_reads WHERE read_id IS NOT NULL AND length(basecall) > 0 GROUP BY read_id)"
ALIGNMENTS = "alns AS (SELECT DISTINCT a.aln_id, a.movie_id, a.hole_number, a.ref_seq_id, a.rc_ref_strand, a.t_start, a.t_end, a.r_start, a.r_end, a.map_qv, a.n_m, a.n_mm, a.n_ins, a.n_del FROM alignment_index a JOIN ref_info i ON a.ref_seq_id = i.ref_seq_id WHERE a.t_start >= 0 AND a.t_start < a.t_end AND a.t_end <= i.ref_length)"


def kmers_sql(k: int, source: str = "reads", key: str = "read_id") -> str:
    """A CTE body: key, pos, kmer of the capitals A, C, G, T in ``seq``."""
    return (
        f"(SELECT {key}, pos, kmer FROM (SELECT {key}, CAST(p AS INTEGER) AS pos, substring(seq, CAST(p AS BIGINT) + 1, {k}) AS kmer "
        f"FROM (SELECT {key}, seq, unnest(range(length(seq) - {k - 1})) AS p FROM {source})) WHERE regexp_full_match(kmer, '[ACGT]+'))"
    )
