"""The N best items of every group, by descending score bands.

Band edges are quantiles of the score. Bands are worked from the top: a band's rows are read by a score filter that
reaches the scan; groups already filled by higher bands are dropped by an anti-join, before the rows move if the filled groups
are few enough to be broadcast; and the rank filter has a partial form before the shuffle, so of a group at most N different
(score, item) pairs leave a task. A last exact ranking closes the groups whose N-th item lies in a lower band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut

#: Filled groups are broadcast up to this number (keys of some 20 bytes each); beyond it the anti-join follows the rank filter, on its partitioning.
BROADCAST_FILLED = 50_000


def band_edges(df: DataFrame, score: str, shares: tuple[float, ...] = (0.25, 0.5)) -> list[float]:
    """Lower edges of all bands but the last, from the top, at the given shares of the rows; equal edges become one."""
    at = [1 - s for s in shares]
    found = df.select(F.percentile_approx(F.col(score), at, 1000).alias("q")).first()["q"] or []
    return sorted(set(found), reverse=True)


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int, shares: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """The ``n`` items of highest score of each group, ties going to the smaller item: ``(*groups, item, score)``.

    Rows without item or score take no part, nor do rows with a null in ``groups``; a NaN score takes no part either. Repeats
    of an item in a group count once, with its highest score. Groups smaller than ``n`` come whole; an empty table gives no
    rows. Other columns are not read.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(groups, keys)), F.col(item).alias("_item"), F.col(score).alias("_score")).dropna()
    edges = band_edges(rows, "_score", shares)
    best = Window.partitionBy(*keys).orderBy(F.desc("_score"), "_item")
    bands: list[DataFrame] = []
    for i in range(len(edges) + 1):
        band = rows
        if i < len(edges):
            band = band.where(F.col("_score") >= F.lit(edges[i]))
        if i > 0:
            band = band.where(F.col("_score") < F.lit(edges[i - 1]))
        filled = None
        if bands:
            filled = reduce(DataFrame.unionByName, bands).groupBy(*keys).agg(F.count_distinct("_item").alias("_n")).where(F.col("_n") >= n).select(*keys)
            if filled.limit(BROADCAST_FILLED + 1).count() <= BROADCAST_FILLED:
                band, filled = band.join(F.broadcast(filled), keys, "left_anti"), None
        # Equal rows have one dense rank, so repeats take no item's place; they are dropped on the partitioning of the rank.
        band = band.withColumn("_rank", F.dense_rank().over(best)).where(F.col("_rank") <= n).drop("_rank").dropDuplicates([*keys, "_item", "_score"])
        if filled is not None:
            band = band.join(filled, keys, "left_anti")
        bands.append(cut(band))
    kept = reduce(DataFrame.unionByName, bands)
    # An item given with several scores may have taken another's place: such groups are ranked anew from their whole rows.
    mixed = cut(kept.groupBy(*keys).agg(F.count("*").alias("_a"), F.count_distinct("_item").alias("_b")).where("_a <> _b").select(*keys))
    if mixed.limit(1).count():
        whole = rows.join(mixed, keys, "left_semi").groupBy(*keys, "_item").agg(F.max("_score").alias("_score"))
        kept = kept.join(mixed, keys, "left_anti").unionByName(whole)
    ranked = kept.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n)
    return ranked.select(*(F.col(k).alias(c) for c, k in zip(groups, keys)), F.col("_item").alias(item), F.col("_score").alias(score))
