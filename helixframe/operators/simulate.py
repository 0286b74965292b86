"""Tiling, shredding, mutation, normalisation and error models; every draw depends on keys and a seed, never on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.seq import reverse_complement


def draw(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def tiles(df: DataFrame, row_id: str, seq: str, length: int, stride: int) -> DataFrame:
    """``(row_id, start, tile)``: windows of ``length`` every ``stride``; the last may be shorter, none is empty."""
    rows = df.where(F.length(seq) > 0).select(row_id, seq, F.explode(F.sequence(F.lit(0), F.length(seq) - 1, F.lit(stride))).alias("start"))
    return rows.select(row_id, "start", F.substring(F.col(seq), F.col("start") + 1, F.lit(length)).alias("tile"))


def split_pieces(df: DataFrame, row_id: str, seq: str, length: int) -> DataFrame:
    """Pieces of ``length`` side by side, without an empty last one."""
    return tiles(df, row_id, seq, length, length)


def shred(df: DataFrame, row_id: str, seq: str, coverage: float, length: int, seed: int = 0, both_strands: bool = True) -> DataFrame:
    """Random substrings of ``length``: ``(row_id, n, start, strand, read)``, enough for the coverage of each sequence.

    Starts are uniform; sequences shorter than ``length`` give their whole once per fold of coverage, rounded up.
    """
    count = F.ceil(F.length(seq) * coverage / length).cast("int")
    rows = df.where(F.length(seq) > 0).select(row_id, seq, F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).alias("n"))
    start = F.floor(draw(seed, row_id, "n") * (F.greatest(F.length(seq) - length, F.lit(0)) + 1)).cast("int")
    rows = rows.withColumn("start", start).withColumn("strand", (F.lit(int(both_strands)) * F.floor(draw(seed + 1, row_id, "n") * 2)).cast("int"))
    piece = F.substring(F.col(seq), F.col("start") + 1, F.lit(length))
    return rows.select(row_id, "n", "start", "strand", F.when(F.col("strand") == 1, reverse_complement(piece)).otherwise(piece).alias("read"))


def mutate(df: DataFrame, row_id: str, seq: str, p_ins: float, p_del: float, p_sub: float, seed: int = 0) -> DataFrame:
    """``(row_id, seq, changes)``: letters inserted before, deleted or replaced at random; changes are (pos, kind, letters) of the original.

    Draws come from the row's id and the seed, so a row changes alike wherever it is worked. Null sequences stay null.
    """
    rows = df.select(F.col(row_id), F.xxhash64(F.lit(seed), row_id).alias("_seed"), F.col(seq).alias("_seq"))
    kind = df.schema[row_id].dataType.simpleString()
    change = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("letters", pa.string())])

    def one(text: str, s: int) -> tuple[str, list[dict]]:
        rng = np.random.default_rng(s & (1 << 63) - 1)
        u, other = rng.random(len(text)), rng.integers(0, 4, len(text))
        out, changes = [], []
        for i in np.flatnonzero(u < p_ins + p_del + p_sub):
            letter = "ACGT"[other[i]]
            if u[i] < p_ins:
                changes.append({"pos": int(i), "kind": "insertion", "letters": letter})
            elif u[i] < p_ins + p_del:
                changes.append({"pos": int(i), "kind": "deletion", "letters": text[i]})
            else:
                letter = "ACGT"[(other[i] + 1) % 4] if letter == text[i].upper() else letter
                changes.append({"pos": int(i), "kind": "substitution", "letters": letter})
        at = 0
        for c in changes:
            out.append(text[at : c["pos"]])
            at = c["pos"]
            if c["kind"] != "deletion":
                out.append(c["letters"])
            at += c["kind"] != "insertion"
        return "".join([*out, text[at:]]), changes

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done = [one(t, s) if t is not None else (None, []) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([c for _, c in done], pa.list_(change))], [row_id, "seq", "changes"])

    return rows.mapInArrow(kernel, f"`{row_id}` {kind}, seq string, changes array<struct<pos:int,kind:string,letters:string>>")


def gc_normalised(df: DataFrame, row_id: str, seq: str, target: float, seed: int = 0) -> DataFrame:
    """Sequences whose share of G and C is moved to ``target`` by replacing as many random letters as that takes in the mean.

    Capital letters; null or empty sequences give no row. Draws come from the row's id and the seed.
    """
    rows = df.where(F.length(seq) > 0).select(F.col(row_id), F.xxhash64(F.lit(seed), row_id).alias("_seed"), F.upper(seq).alias("_seq"))

    def one(text: str, s: int) -> str:
        letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8).copy()
        rng = np.random.default_rng(s & (1 << 63) - 1)
        u, coin = rng.random(len(letters)), rng.integers(0, 2, len(letters))
        gc, at = np.isin(letters, np.frombuffer(b"GC", np.uint8)), np.isin(letters, np.frombuffer(b"AT", np.uint8))
        share = gc.mean()
        if share > target:
            swap, into = gc & (u < (share - target) / share), b"AT"
        else:
            swap, into = at & (u < (target - share) / max(1 - share, 1e-12)), b"GC"
        letters[swap] = np.frombuffer(into, np.uint8)[coin[swap]]
        return letters.tobytes().decode("ascii")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t, s) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.string())], [row_id, "seq"])

    return rows.mapInArrow(kernel, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, seq string")


def barcode_pairs(df: DataFrame, name: str, seq: str) -> DataFrame:
    """All ordered pairs of different barcodes joined into one: the table is a handful of primers, checked to be at most 2,000."""
    b = df.select(name, seq).dropna().distinct().limit(2_001).collect()
    if len(b) > 2_000:
        raise ValueError("more than 2,000 barcodes")
    rows = [(x[0], y[0], x[1] + y[1]) for x in b for y in b if x[0] != y[0]]
    return df.sparkSession.createDataFrame(rows, "first string, second string, seq string")


def context_model(pairs: DataFrame, context: str, outcome: str) -> DataFrame:
    """``(context, outcome, n, share, upto)``: how often each outcome follows a context, and the cumulated share, to draw from."""
    counts = pairs.groupBy(F.col(context).alias("context"), F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("context")
    upto = F.sum("n").over(w.orderBy("outcome").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    return counts.select("context", "outcome", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(upto / total, 6).alias("upto"))


def draw_outcomes(df: DataFrame, row_id: str, context: str, model: DataFrame, seed: int = 0) -> DataFrame:
    """One outcome per row by its context's cumulated shares: the first that the row's draw doesn't exceed."""
    u = df.select(row_id, F.col(context).alias("context"), draw(seed, row_id).alias("_u"))
    hit = u.join(model, "context").where(F.col("_u") < F.col("upto") + F.lit(5e-7))
    return hit.groupBy(row_id).agg(F.min_by("outcome", "upto").alias("outcome"))


def length_cdf(df: DataFrame, length: str) -> DataFrame:
    """``(length, n, upto)``: empirical lengths with their cumulated share, from counts."""
    from pyspark.sql import Window

    counts = df.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row per length
    upto = F.sum("n").over(every.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("length", "n", F.round(upto / F.sum("n").over(every), 6).alias("upto"))
