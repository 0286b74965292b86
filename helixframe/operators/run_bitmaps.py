"""Overlapping and gapped intervals per entity, by compressed run bitmaps.

The axis of an entity is cut into shards of ``2**shard_bits`` exact units. The intervals of a shard are
one bitmap, kept as its runs of set bits (pairs of 32-bit offsets). Bitmaps are built and united where the rows
are read, then united across tasks in two rounds (per salt, then per shard), so a hot entity or shard
never travels row by row. Set runs and clear runs come out of each shard; only the first and last run
of a shard can continue in a neighbour, so only those go through a window over the entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import cut

FLUSH_ROWS = 400_000


def merge_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open runs within each group; touching runs become one. Sorted by group, start."""
    if not len(start):
        return group, start, end
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    low = int(start.min())
    width = int(end.max()) - low + 2
    if (int(group.max()) + 1) * width < 1 << 62:
        base = group.astype(np.int64) * width - low
        reach = np.maximum.accumulate(base + end)
        fresh = np.empty(len(start), bool)
        fresh[0] = True
        fresh[1:] = (base + start)[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        return group[first], start[first], reach[last] - base[first]
    parts = []
    for g in np.unique(group):
        here = group == g
        _, s, e = merge_runs(np.zeros(int(here.sum()), np.int64), start[here], end[here])
        parts.append((np.full(len(s), g), s, e))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _encode(first: np.ndarray, count: int, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """One binary per group; ``first`` has each group's first run."""
    data = np.empty(2 * len(start), "<i4")
    data[0::2], data[1::2] = start, end
    offsets = np.append(first, count).astype(np.int64) * 8
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _decode(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and end of every run in a binary column."""
    rows, starts, ends, at = [], [], [], 0
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", "<i4")[offsets[0] // 4 : offsets[-1] // 4] if len(chunk) else np.empty(0, "<i4")
        rows.append(np.repeat(np.arange(at, at + len(chunk)), np.diff(offsets) // 8))
        starts.append(data[0::2].astype(np.int64))
        ends.append(data[1::2].astype(np.int64))
        at += len(chunk)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, starts, ends))


def _to_bitmaps(bits: int, salts: int):
    def build(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        code, names = _codes(t["k"])
        code, start, end = merge_runs(code, t["s"].to_numpy(), t["e"].to_numpy())
        lo, hi = start >> bits, (end - 1) >> bits
        n = hi - lo + 1
        row = np.repeat(np.arange(len(start)), n)
        shard = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        edge = shard << bits
        s, e, code = np.maximum(start[row], edge) - edge, np.minimum(end[row], edge + (1 << bits)) - edge, code[row]
        fresh = np.append(True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])) if len(row) else np.empty(0, bool)
        first = np.flatnonzero(fresh)
        salt = np.full(len(first), TaskContext.get().partitionId() % salts, np.int32)  # by task, so that a task run again sends each bitmap to the same place
        return pa.RecordBatch.from_arrays([names.take(pa.array(code[first])), pa.array(shard[first]), pa.array(salt), _encode(first, len(row), s, e)], ["k", "shard", "salt", "runs"])

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in it:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield build(held)
                held, rows = [], 0
        if rows:
            yield build(held)

    return kernel


def _whole_groups(it: Iterator[pa.RecordBatch], limit: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole (k, shard) groups from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        t = pa.Table.from_batches(held)
        last = (t["k"][-1], t["shard"][-1])
        n = t.num_rows - 1
        while n >= 0 and (t["k"][n], t["shard"][n]) == last:
            n -= 1
        if n >= 0:
            yield t.slice(0, n + 1)
        held = t.slice(n + 1).to_batches()
        size = sum(x.nbytes for x in held)
        if n < 0:  # one group larger than the limit: united at once, so that it shrinks
            united = _union(pa.Table.from_batches(held))
            held, size = [united], united.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _united(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, _ = _codes(t["k"])
    shard = t["shard"].to_numpy()
    fresh = np.append(True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1]))
    group_of_row = np.cumsum(fresh) - 1
    heads = t.take(pa.array(np.flatnonzero(fresh)))
    row, s, e = _decode(t["runs"])
    group, s, e = merge_runs(group_of_row[row], s, e)
    first = np.searchsorted(group, np.arange(heads.num_rows))
    return heads, group, s, e, first


def _union(t: pa.Table) -> pa.RecordBatch:
    heads, _, s, e, first = _united(t)
    return pa.RecordBatch.from_arrays([heads["k"].combine_chunks(), heads["shard"].combine_chunks(), _encode(first, len(s), s, e)], ["k", "shard", "runs"])


def _unite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_groups(x.select(["k", "shard", "runs"]) for x in it):
        yield _union(t)


def _extract(bits: int):
    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(it):
            heads, group, s, e, first = _united(t)
            base = heads["shard"].to_numpy()[group] << bits
            s, e = s + base, e + base
            last = np.append(first[1:], len(s)) - 1
            edge = np.zeros(len(s), bool)
            edge[first] = edge[last] = True
            inner = np.ones(len(s), bool)
            inner[last] = False
            gap = np.flatnonzero(inner)
            kind = np.concatenate([edge.astype(np.int32), np.full(len(gap), 2, np.int32)])
            of = np.concatenate([group, group[gap]])
            yield pa.RecordBatch.from_arrays(
                [heads["k"].combine_chunks().take(pa.array(of)), pa.array(heads["shard"].to_numpy()[of]), pa.array(kind), pa.array(np.concatenate([s, e[gap]])), pa.array(np.concatenate([e, s[gap + 1]]))],
                ["k", "shard", "kind", "s", "e"],
            )

    return kernel


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, shard_bits: int = 20, salts: int = 8) -> DataFrame:
    """Continuous covered periods of each entity and the gaps between them.

    Returns ``(key, kind, span_start, span_end)`` with kind ``period`` or ``gap``, half-open. Touching
    intervals are continuous; nothing is reported before the first or after the last period. Rows with a null
    key or bound or with ``start >= end`` cover nothing. Repeated rows change nothing; an empty table
    gives no rows. Only the three named columns are read. Positions lie within +-2**61.
    """
    key_type = df.schema[key].dataType
    fields = lambda *extra: T.StructType([T.StructField("k", key_type), T.StructField("shard", T.LongType()), *extra])
    runs = T.StructField("runs", T.BinaryType())
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("k is not null and s < e")
    parts = rows.mapInArrow(_to_bitmaps(shard_bits, salts), fields(T.StructField("salt", T.IntegerType()), runs))
    salted = parts.repartition("k", "shard", "salt").sortWithinPartitions("k", "shard").mapInArrow(_unite, fields(runs))
    pieces = salted.repartition("k", "shard").sortWithinPartitions("k", "shard").mapInArrow(
        _extract(shard_bits), fields(T.StructField("kind", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType()))
    )
    pieces = cut(pieces)
    done = pieces.where("kind <> 1").select("k", F.when(F.col("kind") == 2, "gap").otherwise("period").alias("kind"), "s", "e")
    w = Window.partitionBy("k").orderBy("s")
    edges = (
        pieces.where("kind = 1")
        .select("k", "shard", "s", "e", F.lag("e").over(w).alias("pe"), F.lag("shard").over(w).alias("ps"))
        .withColumn("island", F.sum(F.when(F.col("pe") == F.col("s"), 0).otherwise(1)).over(w))
    )
    stitched = edges.groupBy("k", "island").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min(F.when((F.col("pe") < F.col("s")) & (F.col("ps") != F.col("shard")), F.col("pe"))).alias("pe")
    )
    stitched = stitched.select(
        "k",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("s").alias("s"), F.col("e").alias("e")),
                    F.struct(F.lit("gap").alias("kind"), F.col("pe").alias("s"), F.col("s").alias("e")),
                ),
                lambda x: x["s"].isNotNull(),
            )
        ).alias("x"),
    ).select("k", "x.kind", "x.s", "x.e")
    return done.unionByName(stitched).select(F.col("k").alias(key), "kind", F.col("s").alias("span_start"), F.col("e").alias("span_end"))
