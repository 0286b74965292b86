"""Joins and set comparisons: pairing, as-of, intervals, dictionaries, differences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.scan import numbered


def pair_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of equal key paired one to one in their orders; what has no partner is dropped. Clashing names of ``right`` get ``r_``."""
    number = lambda d, o: d.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(o)))
    r = right.select(*(F.col(c).alias(c if c == key or c not in left.columns else f"r_{c}") for c in right.columns))
    order = right_order if right_order not in left.columns or right_order == key else f"r_{right_order}"
    return number(left, left_order).join(number(r, order), [key, "_n"]).drop("_n")


def asof_join(points: DataFrame, starts: DataFrame, by: str | None, position: str, start: str, value: str, width: int = 1 << 20) -> DataFrame:
    """Each point with the ``value`` of the last start at or before it (as ``by`` group, if given); null if there is none.

    A start holds up to the next one; these stretches are cut into bins of ``width`` and met by an equi-join on the bin, so
    points are never sorted together. Of starts at the same place the largest value counts. ``starts`` is the smaller side
    (its stretches times their bins are made). Extra columns of ``points`` are kept; one named like ``value`` clashes.
    """
    by_group = [by] if by else []
    s = starts.where(F.col(start).isNotNull()).groupBy(*by_group, F.col(start).cast("long").alias("_s")).agg(F.max(value).alias(value))
    last = points.agg(F.max(F.col(position)).cast("long")).first()[0] or 0
    w = Window.partitionBy(*by_group).orderBy("_s")
    s = s.withColumn("_e", F.coalesce(F.lead("_s").over(w), F.greatest(F.lit(last).cast("long"), F.col("_s")) + 1))
    s = with_bins(s, "_s", "_e", width)
    p = points.withColumn("_at", F.floor(F.col(position) / width))
    s = s.select(*(F.col(c).alias(f"_by_{c}") for c in by_group), F.col("_bin"), "_s", "_e", value)
    on = (F.col("_at") == F.col("_bin")) & (F.col("_s") <= F.col(position)) & (F.col(position) < F.col("_e"))
    for c in by_group:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return p.join(s, on, "left").drop("_at", "_bin", "_s", "_e", *(f"_by_{c}" for c in by_group))


def with_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per bin of ``width`` that the half-open interval touches, in ``_bin``; empty intervals vanish."""
    lo, hi = F.expr(f"`{start}` div {width}"), F.expr(f"(`{end}` - 1) div {width}")
    return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(lo, hi)))


def interval_overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], width: int, kind: str = "overlap") -> DataFrame:
    """Pairs of one ``key`` whose half-open intervals overlap, or whose left one lies within the right one (``contained``).

    An equi-join on (key, bin) with a residual test, so nothing is compared across bins; a pair that shares several bins is
    kept in the first of them only. Names must not clash but for ``key``. ``width`` should be about the usual length.
    """
    pairs = with_bins(left, *l, width).join(with_bins(right, *r, width), [key, "_bin"])
    (ls, le), (rs, re) = l, r
    test = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    if kind == "contained":
        test = (F.col(ls) >= F.col(rs)) & (F.col(le) <= F.col(re))
    first = F.col("_bin") == F.floor(F.greatest(ls, rs) / width)
    return pairs.where(test & first).drop("_bin")


def best_overlap(pairs: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], tie: str) -> DataFrame:
    """Of each key's pairs the one of the largest ``overlap`` percentage (shared over joint span), ties to the smaller ``tie``."""
    (ls, le), (rs, re) = l, r
    shared = F.least(le, re) - F.greatest(ls, rs)
    joint = F.greatest(le, re) - F.least(ls, rs)
    rows = pairs.withColumn("overlap", F.round(100.0 * shared / joint, 6))
    w = Window.partitionBy(*keys).orderBy(F.desc("overlap"), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _contained_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the intervals that lie in one before them, from rows (group, s, e, v, i, own) sorted by group, s, e falling, v, i.

    Of the intervals seen, those that no other both outreaches and outscores are kept, by falling end; memory is theirs only.
    """
    group, ends, scores = None, [], []
    for batch in it:
        lost = []
        for g, e, v, i, own in zip(*(batch[c].to_pylist() for c in ("g", "e", "v", "i", "own"))):
            if g != group:
                group, ends, scores = g, [], []
            # ends is kept as negative numbers, rising; scores fall along it, as a nearer end is kept only for a better score.
            at = bisect_right(ends, -e)
            if at and scores[at - 1] <= v:
                if own:
                    lost.append(i)
                continue
            at = bisect_left(ends, -e)
            stop = at
            while stop < len(ends) and scores[stop] >= v:
                stop += 1
            ends[at:stop], scores[at:stop] = [-e], [v]
        yield pa.RecordBatch.from_arrays([pa.array(lost, batch["i"].type)], ["i"])


def drop_contained_intervals(df: DataFrame, keys: list[str], start: str, end: str, score: str, row_id: str, width: int) -> DataFrame:
    """Without the rows whose interval lies in another's of the same keys with a score at most as high (lower is better).

    Of equal intervals with equal scores the smaller id stays; nulls in the keys are equal; empty or null intervals and null scores are
    kept and hold nothing. A container covers the start of what it holds, so each bin of ``width`` is one sweep, which emits no pairs.
    ``row_id`` is unique.
    """
    rows = df.select(F.to_json(F.struct(*keys)).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(score).alias("v"), F.col(row_id).alias("i"))
    rows = with_bins(rows.where("v is not null"), "s", "e", width).withColumn("g", F.concat_ws("|", "_bin", "k")).withColumn("own", F.col("_bin") == F.expr(f"s div {width}"))
    swept = rows.repartition("g").sortWithinPartitions("g", "s", F.desc("e"), "v", "i").select("g", "e", "v", "i", "own")
    lost = swept.mapInArrow(_contained_ids, f"i {df.schema[row_id].dataType.simpleString()}").select(F.col("i").alias(row_id)).distinct()
    return df.join(lost, row_id, "left_anti")


def uncovered(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Gaps ``(keys, gap_start, gap_end)`` between the covered parts of each key; nulls in the keys are equal.

    By run bitmaps of shards of positions, so a hot key is many pieces; only the edges of shards meet in a window.
    """
    from helixframe.operators.run_bitmaps import periods_and_gaps

    rows = df.select(F.to_json(F.struct(*keys)).alias("_k"), start, end)
    gaps = periods_and_gaps(rows, "_k", start, end).where("kind = 'gap'")
    parsed = F.from_json("_k", df.select(*keys).schema)
    return gaps.select(parsed.alias("_p"), F.col("span_start").alias("gap_start"), F.col("span_end").alias("gap_end")).select(*(F.col(f"_p.{k}").alias(k) for k in keys), "gap_start", "gap_end")


def compare_sets(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``(keys, verdict)``: equal, changed, only_a or only_b. Nulls are equal to nulls."""
    x = a.select(*keys, F.struct(*values).alias("_a"))
    y = b.select(*keys, F.struct(*values).alias("_b"))
    same = F.to_json("_a").eqNullSafe(F.to_json("_b"))
    verdict: Column = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(same, "equal").otherwise("changed")
    return x.join(y, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def title_table(df: DataFrame, title: str) -> DataFrame:
    """Dense numbers from 0 for the different titles, in their order: ``(title, title_id)``. Nulls have none."""
    names = df.select(title).where(F.col(title).isNotNull()).distinct()
    return numbered(names, title, "title_id").select(title, F.col("title_id").cast("int").alias("title_id"))


def best_hits(df: DataFrame, query: str, score: str, ties: list[str], n: int = 10, policy: str = "bestn", seed: int = 0) -> DataFrame:
    """Hits per query by ascending score (lower is better), with ``hit_rank`` from 1 and ``is_primary``.

    Policies: ``bestn`` the first n, ``all``, ``allbest`` all of the best score, ``random`` one of all, ``randombest`` one of the best
    score; the random ones depend on the seed and the tie columns only.
    """
    luck = F.xxhash64(F.lit(seed), F.col(query), *ties)
    order = {"random": [luck, *ties], "randombest": [F.col(score), luck, *ties]}.get(policy, [F.col(score), *ties])
    w = Window.partitionBy(query).orderBy(*order)
    if policy == "allbest":
        kept = df.withColumn("_k", F.rank().over(Window.partitionBy(query).orderBy(score))).where("_k = 1").drop("_k")
    elif policy == "all":
        kept = df
    else:
        kept = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= (n if policy == "bestn" else 1)).drop("_k")
    return kept.withColumn("hit_rank", F.row_number().over(w)).withColumn("is_primary", F.col("hit_rank") == 1)
