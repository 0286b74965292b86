"""Implausible readings per source: out of range, stuck, out of line, and far from what the source usually gives.

The robust decomposition takes a reading apart into trend, season and residual by medians, and tests the residuals with the
generalised extreme studentised deviate (ESD) rule: the farthest reading is taken away, median and median absolute deviation (MAD)
are taken anew, and so on. It works on counted values: readings are counted per source and value where they lie, so a source with a
third of all rows is some thousand counts after the first aggregation; residuals keep 14 significant bits, which bounds their number.
Neighbour checks run in blocks of positions with a halo, one sweep over sorted rows, so an entity of any length is split.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut

#: Values that share a bin when medians are sought: a group's bins are ranked first, then the values of the bin that holds the middle.
BIN = 4096
#: Per-test tail of the search for spikes; see ``implausible_readings``.
SPIKE_TAIL = 0.005


def counted_median(counts: DataFrame, keys: list[str], value: str, count: str, name: str) -> DataFrame:
    """Exact median (mean of the middle two) per key of values given with their counts: ``(keys, name, _n)``.

    Bins of values are ranked first, then the values of one or two bins, so no window holds all values of a key.
    """
    counts = counts.groupBy(*keys, value).agg(F.sum(count).alias(count)).withColumn("_bin", F.floor(F.col(value) / BIN))
    by = Window.partitionBy(*keys)
    binned = counts.groupBy(*keys, "_bin").agg(F.sum(count).alias("_c"))
    binned = binned.withColumn("_before", F.sum("_c").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_n", F.sum("_c").over(by))
    low, high = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    middle_bins = binned.where((low > F.col("_before")) & (low <= F.col("_before") + F.col("_c")) | (high > F.col("_before")) & (high <= F.col("_before") + F.col("_c"))).drop("_c")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bin"]]
    inside = counts.alias("a").join(middle_bins.alias("b"), same).select("a.*", "b._before", "b._n")
    upto = F.col("_before") + F.sum(count).over(Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_upto", upto)
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col(count) < r)
    middle = (F.min(F.when(holds(low), F.col(value))) + F.min(F.when(holds(high), F.col(value)))) / 2.0
    return ranked.groupBy(*keys).agg(middle.alias(name), F.max("_n").alias("_n"))


def robust_limits(counts: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Median and MAD per key: columns ``keys, centre, mad, n``."""
    centre = counted_median(counts, keys, value, count, "centre")
    apart = counts.join(centre, keys).withColumn("_d", F.abs(F.col(value) - F.col("centre")))
    mad = counted_median(apart.select(*keys, "_d", count), keys, "_d", count, "mad").drop("_n")
    return centre.join(mad, keys).withColumnRenamed("_n", "n")


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by the Cornish-Fisher series in 1/df; error below 1e-3 from df = 10 on."""
    z = NormalDist().inv_cdf(p)
    z2 = z * z
    return z * (1 + (z2 + 1) / (4 * df) + (5 * z2 * z2 + 16 * z2 + 3) / (96 * df**2) + (3 * z2**3 + 19 * z2 * z2 + 17 * z2 - 15) / (384 * df**3))


@lru_cache(maxsize=100_000)
def esd_limit(n: int, i: int, alpha: float, tail: float | None = None) -> float:
    """Critical value for the i-th outlier of n; ``tail`` fixes the tail of every single test in place of alpha / (2 (n - i + 1))."""
    left = n - i - 1
    if left < 1:
        return math.inf
    t = t_quantile(1 - (alpha / (2 * (n - i + 1)) if tail is None else tail), left)
    return (n - i) * t / math.sqrt((left + t * t) * (n - i + 1))


def rounded(value: Column) -> Column:
    """The value to 14 significant bits: whole and half numbers up to 8,191 are kept as they are."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - 13)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / step) * step)


def esd_kept(values: np.ndarray, counts: np.ndarray, alpha: float = 0.05, tail: float | None = None) -> tuple[float, float, float, float]:
    """Generalised ESD on counted values: the least and greatest value that is no outlier, and median and MAD of those that are none.

    ``values`` rise. The farthest value from the median of what is left, in units of 1.4826 MAD of what is left, is tested and
    taken away, with median and MAD taken anew each time, until half of the readings are gone; the outliers are all up to the last one
    beyond its limit. Equal readings are taken away one after the other, and tested together at the last of them (where their
    deviate is largest and the limit lowest). With MAD 0 whatever differs from the median is infinitely far.
    """
    upto = np.append(0, np.cumsum(counts))
    n = int(upto[-1])
    first, last = 0, len(values)  # what is left
    at = lambda rank: values[int(np.searchsorted(upto, upto[first] + rank, side="left")) - 1]  # noqa: E731 - rank from 1

    def centre(total: int) -> float:
        return (at((total + 1) // 2) + at((total + 2) // 2)) / 2

    def nth_distance(middle: float, rank: int) -> float:
        """The rank-th smallest distance from the middle: of either side, the nearest that has so many readings within it."""
        split = min(max(int(np.searchsorted(values, middle, side="left")), first), last)
        above, below = (lambda j: values[split + j] - middle), (lambda j: middle - values[split - 1 - j])

        def within(d: float) -> int:
            up = bisect_right(range(last - split), d, key=above)
            down = bisect_right(range(split - first), d, key=below)
            return int(upto[split + up] - upto[split - down])

        best = math.inf
        for side, size in ((above, last - split), (below, split - first)):
            k = bisect_left(range(size), rank, key=lambda j: within(side(j)))  # noqa: B023
            if k < size:
                best = min(best, side(k))
        return best

    def spread(middle: float, total: int) -> float:
        return (nth_distance(middle, (total + 1) // 2) + nth_distance(middle, (total + 2) // 2)) / 2

    kept = (0, len(values))
    gone = 0
    while last - first > 1:
        total = n - gone
        middle = centre(total)
        left = middle - values[first] > values[last - 1] - middle
        end = first if left else last - 1
        c = int(counts[end])
        if gone + c > n // 2:
            break
        # The last of the equal readings: all others of them are away.
        held = upto[-1]
        if c > 1:
            shift = slice(end + 1, None)
            upto[shift] -= c - 1
            middle = centre(total - c + 1)
        scale = 1.4826 * spread(middle, total - c + 1)
        if c > 1:
            upto[shift] += c - 1
        assert upto[-1] == held
        far = abs(values[end] - middle)
        deviate = far / scale if scale > 0 else math.inf if far > 0 else 0.0
        gone += c
        first, last = (first + 1, last) if left else (first, last - 1)
        if deviate > esd_limit(n, gone, alpha, tail):
            kept = (first, last)
    first, last = kept
    total = int(upto[last] - upto[first])
    middle = centre(total)
    return float(values[first]), float(values[last - 1]), float(middle), float(spread(middle, total))


def _esd(keys: list[str], alpha: float, tail: float | None):
    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by("_r")
        found = esd_kept(t["_r"].to_numpy().astype(np.float64), t["_c"].to_numpy().astype(np.int64), alpha, tail)
        return pa.Table.from_arrays([*(t[k].slice(0, 1) for k in keys), *(pa.array([x], pa.float64()) for x in found)], [*keys, "_least", "_most", "_centre", "_mad"])

    return f


def esd_bounds(counts: DataFrame, keys: list[str], value: str, count: str, alpha: float = 0.05, tail: float | None = None) -> DataFrame:
    """Per key ``(_least, _most, _centre, _mad)``: a value whose rounded form lies outside the first two is an outlier."""
    rows = counts.select(*keys, rounded(F.col(value).cast("double")).alias("_r"), F.col(count).alias("_c")).groupBy(*keys, "_r").agg(F.sum("_c").alias("_c"))
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(_esd(keys, alpha, tail), f"{kinds}, _least double, _most double, _centre double, _mad double")


def seasonal_esd(df: DataFrame, source: str, row_id: str, position: str, value: str, period: int, trend_width: int, alpha: float = 0.05) -> DataFrame:
    """Readings whose residual from trend and season is beyond the generalised ESD limits of their source.

    Trend: the median of each run of ``trend_width`` positions; season: the median of the detrended readings per
    ``position % period``; residual: what is left, to 14 significant bits. The test is ``esd_kept``: median and MAD are taken anew after
    each removal. Returns ``(source, row_id, residual, deviate)``, the deviate in units of 1.4826 MAD of the readings that
    are no outliers (infinite where their MAD is 0). Null readings, sources or positions take no part, repeats of a row_id count
    once, equal residuals are flagged alike, and at most half of a source's readings are ever flagged.
    """
    rows = df.select(F.col(source).alias("_s"), F.col(row_id).alias("_id"), F.col(position).cast("long").alias("_p"), F.col(value).cast("double").alias("_v"))
    rows = rows.where("_s is not null and _p is not null and _v is not null").dropDuplicates(["_id"])
    rows = rows.withColumn("_b", F.floor(F.col("_p") / trend_width)).withColumn("_ph", F.pmod("_p", F.lit(period)))
    count = lambda d, *k: d.groupBy(*k).agg(F.count("*").alias("_c"))
    trend = counted_median(count(rows, "_s", "_b", "_v"), ["_s", "_b"], "_v", "_c", "_trend").drop("_n")
    rows = rows.join(trend, ["_s", "_b"]).withColumn("_v", rounded(F.col("_v") - F.col("_trend")))
    season = counted_median(count(rows, "_s", "_ph", "_v"), ["_s", "_ph"], "_v", "_c", "_season").drop("_n")
    rows = rows.join(season, ["_s", "_ph"]).select("_s", "_id", rounded(F.col("_v") - F.col("_season")).alias("_v"))
    bounds = esd_bounds(count(rows, "_s", "_v"), ["_s"], "_v", "_c", alpha)
    flagged = rows.join(bounds, "_s").where("_v < _least or _v > _most")
    deviate = F.when(F.col("_mad") > 0, F.abs(F.col("_v") - F.col("_centre")) / (1.4826 * F.col("_mad"))).otherwise(F.lit(math.inf))
    return flagged.select(F.col("_s").alias(source), F.col("_id").alias(row_id), F.col("_v").alias("residual"), deviate.alias("deviate"))


def _sweep(n_entity: int, n_fields: int, rising: list[int], run: int):
    """Kernel over rows sorted by entity, block, position and id: each own row once, with a bit per field that is stuck or out of line."""

    def flags(t: pa.Table) -> pa.RecordBatch | None:
        num = lambda c: t[c].to_numpy().astype(np.float64) if t[c].null_count else t[c].to_numpy()
        p, ids, block = num("p"), t["id"].combine_chunks(), t["b"].to_numpy()
        m = len(p)
        known = ~np.isnan(p.astype(np.float64))
        joined = np.append(False, block[1:] == block[:-1])  # the same group as the row before
        for i in range(n_entity):
            codes = t[f"e{i}"].combine_chunks().dictionary_encode()
            e = codes.indices.to_numpy(zero_copy_only=False).astype(np.float64)
            known &= ~np.isnan(e)
            joined[1:] &= (e[1:] == e[:-1]) | (np.isnan(e[1:]) & np.isnan(e[:-1]))
        code = ids.dictionary_encode().indices.to_numpy()
        again = joined & np.append(False, code[1:] == code[:-1])
        if again.any():
            return flags(t.filter(pa.array(~again)))
        after = joined & known & np.append(False, p[1:] == p[:-1] + 1)
        before = np.append(after[1:], False)
        bits = np.zeros(m, np.int32)
        for i in range(n_fields):
            column = t[f"v{i}"]
            null = column.is_null().to_numpy()
            v = column.fill_null(0).to_numpy()
            same = after & ~null & np.append(False, (v[1:] == v[:-1]) & ~null[:-1])
            head = np.flatnonzero(~same)
            size = np.diff(np.append(head, m))
            stuck = np.repeat(size >= run, size) & ~null & known
            if i in rising:
                a, z = np.append(0, v[:-1]), np.append(v[1:], 0)
                whole = after & before & ~null & ~np.append(True, null[:-1]) & ~np.append(null[1:], True)
                stuck |= whole & (a <= z) & ((v < a) | (v > z))
            bits |= stuck.astype(np.int32) << i
        own = t["own"].to_numpy()
        kept = pa.array(np.flatnonzero(own))
        out = [t[c].combine_chunks().take(kept) for c in ("id", "s", *(f"v{i}" for i in range(n_fields)), "bad")]
        return pa.RecordBatch.from_arrays([*out, pa.array(bits[own])], ["id", "s", *(f"v{i}" for i in range(n_fields)), "bad", "bits"])

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            # The last group may go on in the next batch.
            block = t["b"].to_numpy()
            start = len(block) - 1
            while start > 0 and block[start - 1] == block[-1]:
                start -= 1
            if start:
                yield flags(t.slice(0, start).combine_chunks())
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield flags(held.combine_chunks())

    return kernel


def implausible_readings(
    df: DataFrame,
    row_id: str,
    source: str,
    entity: list[str],
    position: str,
    ranges: dict[str, tuple[Column | None, Column | None]],
    spike_fields: list[str],
    rising_fields: list[str],
    spike_limit: float = 10.0,
    stuck_run: int = 10,
    block: int = 4096,
) -> DataFrame:
    """Each implausible reading as ``(row_id, field_name)``, once.

    ``ranges`` has per field the lowest and highest possible value (None: no bound; a null bound holds nothing back).
    A reading of ``spike_fields`` is a spike if its residual from the source's median is more than ``spike_limit``
    MADs. A reading is stuck if it is one of ``stuck_run`` or more equal readings at successive positions of an
    entity; a null or a missing position ends the run. A reading of ``rising_fields`` is out of line if its
    neighbours a, b (position one less, one more) are not null, a <= b, and it lies outside [a, b].

    Spikes are sought by the robust decomposition with the median of the source as trend and no season: the readings beyond the
    generalised ESD limits are the candidates, and those more than ``spike_limit`` (10 or more) MADs from the median are reported. No
    such reading is missed: the half of the readings nearest the median lies within one MAD of it, and none of them is taken away
    before a reading beyond ten, as the median of what is left stays among them; so that reading is, when its turn comes, nine MADs or
    more from the median of what is left, whose MAD is at most two: a deviate of 9 / (2 * 1.4826) = 3.03, more than any limit at
    the tail ``SPIKE_TAIL`` (at most 2.58).

    Nulls are never reported. Rows with a null row_id are dropped; repeats of a row_id count once. Rows with a null
    entity or position take part in range and spike checks but have no neighbours; a null source has no spikes. If two
    row_ids share a position, their order is by row_id and neither follows the other.
    """
    if spike_limit < 10:
        raise ValueError("spike_limit must be 10 or more")
    fields = list(ranges)
    at = {f: i for i, f in enumerate(fields)}
    bad = F.lit(0)
    for i, (lo, hi) in enumerate(ranges.values()):
        x = F.col(fields[i])
        outside = [F.coalesce(test, F.lit(False)) for test in ([x < lo] if lo is not None else []) + ([x > hi] if hi is not None else [])]
        for test in outside:
            bad = bad.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(F.lit(0)))
    keep = [F.col(row_id).alias("id"), F.col(source).alias("s"), *(F.col(c).alias(f"e{i}") for i, c in enumerate(entity)), F.col(position).cast("long").alias("p")]
    rows = df.select(*keep, *(F.col(f).cast("long").alias(f"v{i}") for i, f in enumerate(fields)), bad.cast("int").alias("bad")).where("id is not null")
    # A block and, where the row lies within stuck_run of its border, the neighbouring block; rows without neighbours lie anywhere.
    lonely = F.col("p").isNull()
    for i in range(len(entity)):
        lonely = lonely | F.col(f"e{i}").isNull()
    within, here = F.pmod("p", F.lit(block)), F.floor(F.col("p") / block)
    none = F.array().cast("array<bigint>")
    blocks = F.when(lonely, F.array(F.pmod(F.xxhash64("id"), F.lit(1 << 16)))).otherwise(
        F.concat(F.array(here), F.when(within < stuck_run, F.array(here - 1)).otherwise(none), F.when(within >= block - stuck_run, F.array(here + 1)).otherwise(none))
    )
    ent = [f"e{i}" for i in range(len(entity))]
    placed = rows.withColumn("k", F.explode(blocks)).withColumn("own", lonely | (F.col("k") == here)).withColumn("b", F.xxhash64(*ent, "k")).drop("k")
    placed = placed.repartition("b").sortWithinPartitions("b", *ent, "p", "id").select("b", *ent, "p", "id", "s", *(f"v{i}" for i in range(len(fields))), "bad", "own")
    of = lambda c: rows.schema[c].dataType.simpleString()
    values = ", ".join(f"v{i} bigint" for i in range(len(fields)))
    seen = cut(placed.mapInArrow(_sweep(len(entity), len(fields), [at[f] for f in rising_fields], stuck_run), f"id {of('id')}, s {of('s')}, {values}, bad int, bits int"))
    long = F.explode(F.array(*(F.struct(F.lit(at[f]).alias("f"), F.col(f"v{at[f]}").alias("v")) for f in spike_fields)))
    counts = cut(seen.where("s is not null").select("s", long.alias("x")).select("s", "x.*").where("v is not null").groupBy("s", "f", "v").agg(F.count("*").alias("c")))
    limits = robust_limits(counts, ["s", "f"], "v", "c").join(esd_bounds(counts, ["s", "f"], "v", "c", tail=SPIKE_TAIL), ["s", "f"])
    limits = limits.groupBy("s").agg(*(F.max(F.when(F.col("f") == at[f], F.col(c))).alias(f"{c}{at[f]}") for f in spike_fields for c in ("centre", "mad", "_least", "_most")))
    found = seen.join(limits, "s", "left")
    flags = []
    for i, f in enumerate(fields):
        is_bad = (F.col("bits").bitwiseOR(F.col("bad")).bitwiseAND(F.lit(1 << i))) != 0
        if f in spike_fields:
            x = F.col(f"v{i}")
            outlier = (rounded(x.cast("double")) < F.col(f"_least{i}")) | (rounded(x.cast("double")) > F.col(f"_most{i}"))
            is_bad = is_bad | F.coalesce(outlier & (F.abs(x - F.col(f"centre{i}")) > spike_limit * F.col(f"mad{i}")), F.lit(False))
        flags.append(F.when(is_bad & F.col(f"v{i}").isNotNull(), F.lit(f)))
    return found.select(F.col("id").alias(row_id), F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("field_name"))
