"""Runs of equal or nearly equal consecutive events, collapsed by adjacent agglomeration.

Every event starts as a run of its own in a doubly linked list. A priority queue holds the links between neighbouring
runs that meet the limits; the most similar pair is merged first, the list is relinked, and the merged run's
links to its new neighbours are judged again, until no link meets the limits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGE, MEAN = "edge", "mean"
#: Events worked at a time; longer sequences are worked whole.
CHUNK_EVENTS = 1_000_000


def agglomerate(label: np.ndarray, value: np.ndarray, breaks: np.ndarray, limit: float, linkage: str = EDGE, max_gap: int = 0) -> np.ndarray:
    """Number of the first event of each event's run.

    Two neighbouring runs can merge if their labels are equal, no break lies before the later one, at most ``max_gap`` unknown
    events (label -1) lie between, and they differ by ``limit`` or less: ``edge`` compares the two events that touch, ``mean`` the
    means of the runs. An unknown event is a run of its own.
    """
    n = len(label)
    known = np.flatnonzero(label >= 0)
    part = np.cumsum(breaks)[known]
    alike = (label[known][1:] == label[known][:-1]) & (part[1:] == part[:-1]) & (np.diff(known) <= max_gap + 1)
    joined = np.flatnonzero(alike)
    if not len(joined):
        return np.arange(n)
    # The list holds only events that may merge with a neighbour, numbered anew; all others are runs as they are.
    of_list = np.union1d(joined, joined + 1)
    can = np.isin(of_list, joined, assume_unique=True).tolist()  # this event and the next may merge
    held = known[of_list]
    v = value[held].astype(np.float64).tolist()
    m = len(v)
    prev_run, next_run, alive = list(range(-1, m - 1)), list(range(1, m + 1)), bytearray(b"\x01") * m
    tail, total, count = list(range(m)), list(v), [1] * m  # of each run, at its first event
    mean = linkage == MEAN
    apart = np.abs(np.diff(value[held].astype(np.float64)))
    first = np.flatnonzero(np.array(can[:-1]) & (apart <= limit))
    heap = list(zip(apart[first].tolist(), first.tolist(), (first + 1).tolist()))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        d, a, b = pop(heap)
        if not alive[a] or not alive[b] or next_run[a] != b:
            continue
        if mean and d != abs(total[a] / count[a] - total[b] / count[b]):
            continue  # judged before one of the two grew; the newer entry stands for it
        alive[b] = 0
        after = next_run[a] = next_run[b]
        if after < m:
            prev_run[after] = a
        end = tail[a] = tail[b]
        if mean:
            total[a] += total[b]
            count[a] += count[b]
            here, before = total[a] / count[a], prev_run[a]
            if before >= 0 and can[tail[before]]:
                d = abs(total[before] / count[before] - here)
                if d <= limit:
                    push(heap, (d, before, a))
            if after < m and can[end]:
                d = abs(here - total[after] / count[after])
                if d <= limit:
                    push(heap, (d, a, after))
        elif after < m and can[end]:
            d = abs(v[end] - v[after])
            if d <= limit:
                push(heap, (d, a, after))
    gone = np.zeros(n, bool)
    gone[held[np.frombuffer(alive, np.uint8) == 0]] = True
    heads = np.arange(n)
    heads[known] = np.maximum.accumulate(np.where(gone[known], 0, known))
    return heads


def _lists(column: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Values of a list column lined up with sequences of the given lengths; NaN where there is none."""
    offsets = np.arange(0)
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column)] if len(column) else offsets
    values = column.values.to_numpy(zero_copy_only=False)
    out = np.full(int(lengths.sum()), np.nan)
    n = np.minimum(sizes, lengths)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.cumsum(lengths) - lengths, n) + within] = values[np.repeat(offsets, n) + within]
    return out


def _runs_of(batch: pa.RecordBatch, limit: float, least: int, linkage: str, max_gap: int, durations: bool) -> pa.RecordBatch:
    texts = [(x or "").upper().encode("ascii", "replace") if x is None or len(x.upper()) == len(x) else x.encode("ascii", "replace") for x in batch["sequence"].to_pylist()]
    lengths = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    label = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16)
    value = _lists(batch["value"], lengths)
    label[(label == ord("N")) | (label == ord("?")) | np.isnan(value)] = -1
    breaks = np.zeros(len(label), bool)
    breaks[starts[lengths > 0]] = True
    first_of = agglomerate(label, np.nan_to_num(value), breaks, limit, linkage, max_gap)
    known = np.flatnonzero(label >= 0)
    at = np.flatnonzero(np.append(True, first_of[known][1:] != first_of[known][:-1])) if len(known) else known
    size = np.diff(np.append(at, len(known)))
    kept = size >= least
    heads, tails, size, at = known[at[kept]], known[at[kept] + size[kept] - 1], size[kept], at[kept]
    of = np.searchsorted(starts + lengths, heads, side="right")
    cols = [batch["id"].take(pa.array(of)), pa.array(heads - starts[of], pa.int32()), pa.array(tails - starts[of], pa.int32()), pa.array(size, pa.int32()), pa.array([chr(x) for x in label[heads]], pa.string())]
    names = ["id", "first_base", "last_base", "n_bases", "base"]
    if durations:
        width = _lists(batch["duration"], lengths)[known]
        given = np.append(0, np.cumsum(~np.isnan(width)))
        upto = np.append(0, np.cumsum(np.nan_to_num(width)))
        cols.append(pa.array((upto[at + size] - upto[at]).astype(np.int64), mask=given[at + size] == given[at]))
        names.append("duration")
    return pa.RecordBatch.from_arrays(cols, names)


def collapse_runs(df: DataFrame, row_id: str, sequence: str, value: str, limit: float, least: int, duration: str | None = None, linkage: str = EDGE, max_gap: int = 0) -> DataFrame:
    """Runs of ``least`` or more consecutive equal letters whose values meet the limit (see ``agglomerate``).

    Returns ``(row_id, first_base, last_base, n_bases, base[, duration])``, both positions included; duration is the sum
    of the array column ``duration`` over the run, null if none of its elements is known. Case doesn't matter; N, letters outside
    ASCII and letters without a value (array null, too short, or null there) are in no run, and part two runs unless at most ``max_gap``
    of them lie between; they are not counted. A null row_id or
    sequence gives nothing; repeats of a row count once; each sequence is worked whole within one task.
    """
    named = {row_id: "id", sequence: "sequence", value: "value"} | ({duration: "duration"} if duration else {})
    rows = df.select(*(df[c].alias(a) for c, a in named.items())).where("id is not null and sequence is not null")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = np.array([len(x) for x in batch["sequence"].to_pylist()], np.int64)
            at, upto = 0, np.cumsum(sizes)
            while at < batch.num_rows:
                done = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, done + CHUNK_EVENTS, side="right")))
                yield _runs_of(pa.RecordBatch.from_arrays([c.slice(at, end - at) for c in batch.columns], batch.schema.names), limit, least, linkage, max_gap, duration is not None)
                at = end

    schema = f"id {df.schema[row_id].dataType.simpleString()}, first_base int, last_base int, n_bases int, base string" + (", duration long" if duration else "")
    found = rows.mapInArrow(kernel, schema).dropDuplicates(["id", "first_base"])
    return found.withColumnRenamed("id", row_id)
