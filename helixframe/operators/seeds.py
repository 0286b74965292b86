"""Exact seed joins, maximal matches, repeat masks and clean-up of anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.kmer_codes import kmer_table


def seed_join(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, seq: str, k: int, max_hits: int | None = None, no_self: bool = False, salts: int = 1) -> DataFrame:
    """Equal k-mers of queries and targets: ``(q_id, t_id, q, t)``.

    ``max_hits``: a query position with more hits is masked as a repeat (its k-mer is counted over the targets before the
    join, so a hot k-mer never meets it); None keeps all. ``no_self`` leaves out hits of a row in itself. Letters other than A, C, G, T
    never seed. ``salts``: the targets of a k-mer are spread over so many parts by row and the queries, as the smaller side, copied to
    each, so a hot k-mer is shared out and no hit is lost.
    """
    q = kmer_table(queries, query_id, seq, k).select(F.col(query_id).alias("q_id"), F.col("pos").alias("q"), "kmer")
    t = kmer_table(targets, target_id, seq, k).select(F.col(target_id).alias("t_id"), F.col("pos").alias("t"), "kmer")
    if max_hits is not None:
        masked = t.groupBy("kmer").agg(F.count("*").alias("_n")).where(F.col("_n") > max_hits).select("kmer")
        q = q.join(masked, "kmer", "left_anti")
    if salts > 1:
        t = t.withColumn("_salt", F.pmod(F.xxhash64("t_id"), F.lit(salts)).cast("int"))
        # Not broadcast: the size Spark sees is that of the reads, before their k-mers are made.
        q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    hits = q.join(t, ["kmer", "_salt"] if salts > 1 else "kmer")
    if no_self:
        hits = hits.where("q_id <> t_id")
    return hits.select("q_id", "t_id", "q", "t")


def maximal_matches(hits: DataFrame, k: int) -> DataFrame:
    """Maximal exact matches ``(q_id, t_id, q, t, length)``: runs of hits on one diagonal at successive positions."""
    w = Window.partitionBy("q_id", "t_id", "diagonal").orderBy("q")
    runs = hits.withColumn("diagonal", F.col("t") - F.col("q")).withColumn("fresh", F.when(F.col("q") == F.lag("q").over(w) + 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("q_id", "t_id", "diagonal", "run").agg(F.min("q").alias("q"), F.min("t").alias("t"), (F.max("q") - F.min("q") + k).cast("int").alias("length")).drop("diagonal", "run")


def longest_only(matches: DataFrame) -> DataFrame:
    """Of the matches that begin at one query position, the longest (all of them, if equal)."""
    w = Window.partitionBy("q_id", "q")
    return matches.withColumn("_m", F.max("length").over(w)).where("length = _m").drop("_m")


def drop_encompassed(anchors: DataFrame) -> DataFrame:
    """Without the anchors at q + 1 that are the tail of the one at q (same diagonal, one letter shorter)."""
    w = Window.partitionBy("q_id", "t_id", F.col("t") - F.col("q")).orderBy("q")
    tail = (F.lag("q").over(w) == F.col("q") - 1) & (F.lag("length").over(w) == F.col("length") + 1)
    return anchors.withColumn("_tail", F.coalesce(tail, F.lit(False))).where(~F.col("_tail")).drop("_tail")


def drop_contained(anchors: DataFrame) -> DataFrame:
    """Without anchors that lie, on query and target, within an earlier one of the same diagonal."""
    w = Window.partitionBy("q_id", "t_id", F.col("t") - F.col("q")).orderBy("q", F.desc("length"))
    reach = F.max(F.col("q") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return anchors.withColumn("_in", F.coalesce(reach >= F.col("q") + F.col("length"), F.lit(False))).where(~F.col("_in")).drop("_in")


def contiguous_groups(anchors: DataFrame, max_gap: int) -> DataFrame:
    """Anchors with ``part``: a new part of a (query, target) pair begins where the target gap is larger than ``max_gap``."""
    w = Window.partitionBy("q_id", "t_id").orderBy("t", "q")
    gap = F.col("t") - F.lag(F.col("t") + F.col("length")).over(w)
    return anchors.withColumn("_new", F.when(gap <= max_gap, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def candidate_windows(anchors: DataFrame, width: int) -> DataFrame:
    """Each anchor with the weight of the anchors whose target start lies within ``width`` ahead: ``(…, weight, n_anchors)``."""
    w = Window.partitionBy("q_id", "t_id").orderBy("t").rangeBetween(0, width)
    return anchors.withColumn("weight", F.sum("length").over(w)).withColumn("n_anchors", F.count("*").over(w))


def local_maxima(windows: DataFrame, width: int) -> DataFrame:
    """The windows whose weight no window that begins within ``width`` to either side exceeds; of equals the leftmost."""
    w = Window.partitionBy("q_id", "t_id").orderBy("t")
    near = F.max("weight").over(w.rangeBetween(-width, width))
    rows = windows.where(F.lit(True)).withColumn("_near", near).where("weight = _near").drop("_near")
    last = F.lag("t").over(w)
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("t") - F.col("_last") > width)).drop("_last")
