"""Exact percentiles per group of very large numeric columns, by distributed multi-select on mergeable summaries.

A summary is made where the rows lie: every task packs the values of each group and field into sorted pieces of different
values with their counts. Summaries of parts (days, files) merge by putting their pieces together, so a result is the same at
once or combined, and the rank error is 0. A hot group is simply many pieces of many tasks.

Selection works in rounds of one pass over the pieces, whatever their number. Every sought rank has an open range of values and
a pivot in it. A task counts its values of the range below, at and above the pivot, and proposes the median of its values
on either side, weighted by how many different values it has there. The counts say on which side the rank lies (or that it is the
pivot); the other side is ruled out, and the weighted median of the proposals for the side that is left is its next pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut

#: Rounds after which the selection gives up with an error; each rules out a quarter of a range's different values or more.
MAX_ROUNDS = 200
#: Rows packed at a time, which bounds a task's memory; more of them give more pieces.
PACK_ROWS = 2_000_000
#: Groups selected at a time; the driver holds their ranges (some 50 bytes a rank), the tasks read them.
BLOCK_GROUPS = 50_000
#: Ranges for which a task gathers its counts and proposals before it passes them on.
HELD_RANGES = 500_000
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order; the infinities lie within, both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(_HIGHEST), bits)


def _value_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0, codes ^ np.int64(_HIGHEST), codes).view(np.float64)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int64)), pa.array(values)).cast(pa.list_(pa.int64()))


def _pack(n_groups: int, fields: list[str]):
    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        # A number for each different group: columns as numbers of their values (0 for null), put together one by one.
        of = np.zeros(t.num_rows, np.int64)
        for c in t.columns[:n_groups]:
            codes = pa.compute.dictionary_encode(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
            number = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            of = np.unique(of * (len(codes.dictionary) + 1) + number, return_inverse=True)[1]
        row_of = np.zeros(int(of.max(initial=0)) + 1, np.int64)
        row_of[of] = np.arange(t.num_rows)  # a row of each group
        for i, field in enumerate(fields):
            column = t.column(n_groups + i)
            v = column.to_numpy(zero_copy_only=False).astype(np.float64)  # a null comes as NaN
            ok = ~np.isnan(v)
            code, g = _ordered(v[ok]), of[ok]
            if not len(code):
                continue
            order = np.lexsort((code, g))
            code, g = code[order], g[order]
            head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (g[1:] != g[:-1])))
            count, code, g = np.diff(np.append(head, len(code))), code[head], g[head]
            ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
            which = g[ends - 1]
            keys_of = [t.column(k).combine_chunks().take(pa.array(row_of[which])) for k in range(n_groups)]
            yield pa.RecordBatch.from_arrays(
                [*keys_of, pa.array([field] * len(which)), _lists(code, ends), _lists(count.astype(np.int64), ends)], [*t.column_names[:n_groups], "field", "codes", "counts"]
            )

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in it:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield from pieces(held)
                held, rows = [], 0
        if rows:
            yield from pieces(held)

    return kernel


def summarise(df: DataFrame, groups: list[str], fields: list[str], row_key: list[str], part: list[str] | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Packed pieces ``(*groups, *part, field, codes, counts)``: the different values in order, as order-keeping numbers, and their counts.

    Nulls and NaN are left out. Rows that repeat ``row_key`` count once, in one of their parts, also if they come in several; a row
    with a null in its key repeats only rows equal to it in the groups and fields. A part summarised on its own passes the rows of
    ``earlier`` parts, whose keys are then left out. A group may be null. Values are taken as double. Extra columns are not read.
    """
    by = [*groups, *(part or [])]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in row_key))
    rows = df.select(*dict.fromkeys([*row_key, *by]), *(c for c in fields if c not in row_key and c not in by))
    if earlier is not None:
        rows = rows.join(earlier.select(*row_key).where(known), row_key, "left_anti")
    rows = rows.withColumn("_alike", F.when(~known, F.to_json(F.struct(*groups, *fields)))).dropDuplicates([*row_key, "_alike"])
    plain = rows.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), *(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(fields)))
    schema = ", ".join([*(f"_g{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by)), "field string, codes array<bigint>, counts array<bigint>"])
    packed = plain.mapInArrow(_pack(len(by), fields), schema)
    return packed.select(*(F.col(f"_g{i}").alias(c) for i, c in enumerate(by)), "field", "codes", "counts")


def merge(*summaries: DataFrame, groups: list[str]) -> DataFrame:
    """One summary of all parts: their pieces together; columns outside ``groups`` are dropped."""
    return reduce(DataFrame.unionByName, (s.select(*groups, "field", "codes", "counts") for s in summaries))


def _search(flat: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Of many searches at once, each in its own sorted stretch of ``flat``: the first place whose value is above x (or, not ``right``, at it)."""
    lo, hi = start.copy(), end.copy()
    while True:
        busy = np.flatnonzero(lo < hi)
        if not len(busy):
            return lo
        mid = (lo[busy] + hi[busy]) // 2
        before = flat[mid] <= x[busy] if right else flat[mid] < x[busy]
        lo[busy[before]] = mid[before] + 1
        hi[busy[~before]] = mid[~before]


def _medians(t: np.ndarray, m: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted median (the lower one) of each target's proposals and the sum of their weights; the median is 0 where there are none."""
    order = np.lexsort((m, t))
    t, m, k = t[order], m[order], k[order]
    total = np.bincount(t, k, n).astype(np.int64)
    upto = np.cumsum(k) - (np.cumsum(total) - total)[t]  # within the target
    first = np.flatnonzero((upto * 2 >= total[t]) & ((upto - k) * 2 < total[t]))
    found = np.zeros(n, np.int64)
    found[t[first]] = m[first]
    return found, total


def _count_and_propose(targets_of: dict[str, list[int]], low: np.ndarray, high: np.ndarray, pivot: np.ndarray):
    """Kernel over pieces: per target the counts below, at and above its pivot and this task's proposals for both sides."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held, axis=1)
            held.clear()
            ts, of = np.unique(rows[0], return_inverse=True)
            n = len(ts)
            sums = []
            for c in rows[1:4]:
                total = np.zeros(n, np.int64)
                np.add.at(total, of, c)
                sums.append(total)
            left, right = rows[5] > 0, rows[7] > 0
            ml, kl = _medians(of[left], rows[4][left], rows[5][left], n)
            mr, kr = _medians(of[right], rows[6][right], rows[7][right], n)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ts, *sums, ml, kl, mr, kr)], ["t", "less", "equal", "more", "ml", "kl", "mr", "kr"])

        for batch in it:
            codes, counts = batch["codes"], batch["counts"]
            at = codes.offsets.to_numpy().astype(np.int64)
            flat, times = codes.values.to_numpy(), counts.values.to_numpy()
            upto = np.append(0, np.cumsum(times))
            aimed = [[t for g in ids for t in targets_of.get(g, ())] for ids in batch["ids"].to_pylist()]
            t = np.array([x for a in aimed for x in a], np.int64)
            if not len(t):
                continue
            piece = np.repeat(np.arange(len(aimed)), [len(a) for a in aimed])
            start, end = at[piece], at[piece + 1]
            a, b = _search(flat, start, end, low[t], True), _search(flat, start, end, high[t], False)
            c = np.maximum(a, _search(flat, start, end, pivot[t], False))
            d = np.maximum(a, _search(flat, start, end, pivot[t], True))
            some = len(flat) - 1
            held.append(np.stack([t, upto[c] - upto[a], upto[d] - upto[c], upto[b] - upto[d], flat[np.clip((a + c - 1) // 2, 0, some)], c - a, flat[np.clip((d + b - 1) // 2, 0, some)], b - d]))
            if sum(x.shape[1] for x in held) >= HELD_RANGES:
                yield flush()
        if held:
            yield flush()

    return kernel


def _pivot(m: str, k: str) -> str:
    """SQL: the weighted median of the tasks' proposals, of which there is one a task."""
    offers = f"array_sort(collect_list(if({k} > 0, struct({m} as m, {k} as k), null)))"
    half = f"aggregate({offers}, 0L, (a, x) -> a + x.k)"
    step = f"(a, x) -> struct(a.upto + x.k as upto, if(a.m is null and (a.upto + x.k) * 2 >= a.whole, x.m, a.m) as m, a.whole as whole)"
    return f"aggregate({offers}, struct(0L as upto, cast(null as bigint) as m, {half} as whole), {step}).m"


def _select_block(pieces: DataFrame, members: list[str], per_mille: list[int], rounds: list[int] | None) -> Iterator[tuple[str, int, int, int]]:
    """(gid, per_mille, code, n) of the groups of one block; their open ranges are the driver's, the values stay where they are."""
    q = np.tile(np.array(per_mille, np.int64), len(members))
    gid = np.repeat(np.arange(len(members)), len(per_mille))
    low, high, pivot, rank, n = (np.full(len(q), x, np.int64) for x in (_LOWEST, _HIGHEST, _LOWEST, 0, 0))
    done, open_ranks = np.zeros(len(q), bool), np.arange(len(q))
    for turn in range(MAX_ROUNDS):
        if rounds is not None:
            rounds.append(len(open_ranks))
        targets: dict[str, list[int]] = {}
        for t in open_ranks.tolist():
            targets.setdefault(members[gid[t]], []).append(t)
        told = pieces.mapInArrow(_count_and_propose(targets, low, high, pivot), "t bigint, less bigint, equal bigint, more bigint, ml bigint, kl bigint, mr bigint, kr bigint")
        aggregates = ["sum(less) as less", "sum(equal) as equal", "sum(more) as more", f"{_pivot('ml', 'kl')} as pl", f"{_pivot('mr', 'kr')} as pr"]
        got = told.groupBy("t").agg(*map(F.expr, aggregates)).toArrow()
        t, less, equal, more = (got[c].to_numpy() for c in ("t", "less", "equal", "more"))
        pl, pr = (got[c].fill_null(0).to_numpy() for c in ("pl", "pr"))
        if turn == 0:  # the first pivot lies below all values: the round counts the groups and proposes the first true pivots
            n[t] = more
            rank[t] = np.maximum(1, -(-more * q[t] // 1000))
        left = rank[t] <= less
        hit = ~left & (rank[t] <= less + equal)
        go = ~left & ~hit
        done[t[hit]] = True
        high[t[left]], pivot[t[left]] = pivot[t[left]], pl[left]
        rank[t[go]] -= (less + equal)[go]
        low[t[go]], pivot[t[go]] = pivot[t[go]], pr[go]
        open_ranks = np.flatnonzero(~done)
        if not len(open_ranks):
            break
    else:
        raise RuntimeError(f"not selected within {MAX_ROUNDS} rounds")
    for t in range(len(q)):
        yield members[gid[t]], int(q[t]), int(pivot[t]), int(n[t])


def multi_select(summary: DataFrame, groups: list[str], per_mille: list[int], scopes: dict[str, list[str]] | None = None, rounds: list[int] | None = None, block: int = BLOCK_GROUPS) -> DataFrame:
    """The values at the given percentiles (in thousandths): ``(scope, *groups, field, per_mille, value, n)``.

    ``scopes`` names the groupings to answer at once, each by some of ``groups`` (the others are null then); all of them by default, as
    scope 'group'. The percentile q of n values is the ceil(q*n)-th smallest (the first for q = 0); ties are counted, not broken; the
    rank error is 0. An empty summary gives no rows. Groups are worked in blocks of about ``block``, so that the driver holds a bounded
    number of ranges; ``rounds``, if given, receives the number of open ranks before each round.
    """
    scopes = scopes or {"group": groups}
    spark = summary.sparkSession
    gid = lambda name, keys: F.to_json(F.struct(F.lit(name).alias("scope"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "field"))
    ids = F.array(*(gid(name, keys) for name, keys in scopes.items()))
    pieces = cut(summary.select(ids.alias("ids"), *groups, "field", "codes", "counts"))
    within = F.array(
        *(
            F.struct(F.col("ids")[i].alias("gid"), F.lit(name).alias("scope"), *(F.col(k) if k in keys else F.lit(None).cast(summary.schema[k].dataType).alias(k) for k in groups), "field")
            for i, (name, keys) in enumerate(scopes.items())
        )
    )
    members = cut(pieces.select(F.explode(within).alias("x")).select("x.*").distinct())
    blocks = max(1, -(-members.count() // block))
    packed = pieces.select("ids", "codes", "counts")
    found = []
    for b in range(blocks):
        mine = packed if blocks == 1 else cut(packed.where(f"exists(ids, g -> pmod(xxhash64(g), {blocks}) = {b})"))
        names = [r.gid for r in members.where(f"pmod(xxhash64(gid), {blocks}) = {b}").select("gid").collect()]
        if names:
            rows = list(_select_block(mine, names, per_mille, rounds))
            columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(_value_of(np.array([r[2] for r in rows], np.int64))), pa.array([r[3] for r in rows], pa.int64())]
            found.append(spark.createDataFrame(pa.Table.from_arrays(columns, ["gid", "per_mille", "value", "n"])))
    if not found:
        return members.select("scope", *groups, "field", F.lit(0).alias("per_mille"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")).where("false")
    return reduce(DataFrame.unionByName, found).join(members, "gid").select("scope", *groups, "field", "per_mille", "value", "n")
