"""Problem 1: covered periods of each reference and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.run_bitmaps import periods_and_gaps
from helixframe.session import table

MAX_GAP = 1_000_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "ref_info").select("ref_seq_id", "ref_length")
    aligned = (
        table(spark, sf_dir, "alignment_index")
        .select("ref_seq_id", "t_start", "t_end")
        .where("ref_seq_id is not null and t_start >= 0 and t_start < t_end")
        .join(refs, "ref_seq_id")
        .where("t_end <= ref_length")
    )
    found = periods_and_gaps(aligned, "ref_seq_id", "t_start", "t_end")
    return found.where((F.col("kind") == "period") | (F.col("span_end") - F.col("span_start") <= MAX_GAP))


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
WITH a AS (
  SELECT i.ref_seq_id, i.t_start AS s, i.t_end AS e
  FROM alignment_index i JOIN ref_info r ON i.ref_seq_id = r.ref_seq_id
  WHERE i.t_start >= 0 AND i.t_start < i.t_end AND i.t_end <= r.ref_length
), m AS (
  SELECT *, max(e) OVER (PARTITION BY ref_seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a
), g AS (
  SELECT *, sum(CASE WHEN pe >= s THEN 0 ELSE 1 END) OVER (PARTITION BY ref_seq_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT ref_seq_id, min(s) AS s, max(e) AS e FROM g GROUP BY ref_seq_id, island
), x AS (
  SELECT *, lag(e) OVER (PARTITION BY ref_seq_id ORDER BY s) AS pe FROM p
)
SELECT ref_seq_id, 'period' AS kind, s AS span_start, e AS span_end FROM x
UNION ALL
SELECT ref_seq_id, 'gap', pe, s FROM x WHERE s - pe <= 1000000
"""
}
