"""Problem 2: implausible readings of pulses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.spikes import implausible_readings, seasonal_esd
from helixframe.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = table(spark, sf_dir, "movie_info").select("movie_id", "n_frames")
    pulses = table(spark, sf_dir, "pulse_calls").select("pulse_id", "movie_id", "hole_number", "base_index", "pre_base_frames", "deletion_qv", "start_frame")
    return implausible_readings(
        pulses.join(movies, "movie_id", "left"),
        row_id="pulse_id",
        source="movie_id",
        entity=["movie_id", "hole_number"],
        position="base_index",
        ranges={"pre_base_frames": (F.lit(0), None), "deletion_qv": (F.lit(0), F.lit(93)), "start_frame": (F.lit(0), F.col("n_frames"))},
        spike_fields=["pre_base_frames", "deletion_qv"],
        rising_fields=["start_frame"],
    )


def p2_seasonal_esd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pre_base_frames beyond the generalised ESD limits after trend (64 bases) and season (8 bases) are taken off."""
    return seasonal_esd(table(spark, sf_dir, "pulse_calls"), "movie_id", "pulse_id", "base_index", "pre_base_frames", period=8, trend_width=64)


def p2_seasonal_esd_qv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for deletion_qv."""
    return seasonal_esd(table(spark, sf_dir, "pulse_calls"), "movie_id", "pulse_id", "base_index", "deletion_qv", period=8, trend_width=64)


QUERIES = {"p2_found": p2_found, "p2_seasonal_esd": p2_seasonal_esd, "p2_seasonal_esd_qv": p2_seasonal_esd_qv}

SQL = {
    "p2_found": """
WITH d AS (SELECT DISTINCT pulse_id, movie_id, hole_number, base_index, pre_base_frames, deletion_qv, start_frame FROM pulse_calls),
c AS (SELECT movie_id, median(pre_base_frames) AS mp, median(deletion_qv) AS md FROM d GROUP BY movie_id),
m AS (SELECT d.movie_id, any_value(mp) AS mp, any_value(md) AS md, median(abs(pre_base_frames - mp)) AS ap, median(abs(deletion_qv - md)) AS ad
      FROM d JOIN c ON d.movie_id = c.movie_id GROUP BY d.movie_id),
l AS (
  SELECT pulse_id, movie_id, hole_number, base_index, 'pre_base_frames' AS field_name, CAST(pre_base_frames AS BIGINT) AS v FROM d
  UNION ALL SELECT pulse_id, movie_id, hole_number, base_index, 'deletion_qv', CAST(deletion_qv AS BIGINT) FROM d
  UNION ALL SELECT pulse_id, movie_id, hole_number, base_index, 'start_frame', start_frame FROM d
), n AS (
  SELECT *, lag(v) OVER w AS pv, lag(base_index) OVER w AS pb, lead(v) OVER w AS nv, lead(base_index) OVER w AS nb
  FROM l WINDOW w AS (PARTITION BY field_name, movie_id, hole_number ORDER BY base_index)
), r AS (
  SELECT *, sum(CASE WHEN v = pv AND base_index = pb + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY field_name, movie_id, hole_number ORDER BY base_index ROWS UNBOUNDED PRECEDING) AS run FROM n
), k AS (
  SELECT *, count(v) OVER (PARTITION BY field_name, movie_id, hole_number, run) AS len FROM r
)
SELECT k.pulse_id, k.field_name FROM k LEFT JOIN m ON k.movie_id = m.movie_id LEFT JOIN movie_info i ON k.movie_id = i.movie_id
WHERE v IS NOT NULL AND (
  len >= 10
  OR (field_name = 'pre_base_frames' AND (v < 0 OR abs(v - mp) > 10 * ap))
  OR (field_name = 'deletion_qv' AND (v < 0 OR v > 93 OR abs(v - md) > 10 * ad))
  OR (field_name = 'start_frame' AND (v < 0 OR v > i.n_frames OR (pb = base_index - 1 AND nb = base_index + 1 AND pv <= nv AND (v < pv OR v > nv))))
)
"""
}
