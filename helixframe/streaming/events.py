"""Event-time windows, sessions and duplicates, each for streams and, with the same code, for tables; streaming read mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.kmer_codes import kmers_of


def _late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def window_counts(df: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, value: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """``(window_start, window_end, keys, n[, total])`` per tumbling or, with ``slide``, sliding window; late rows beyond ``delay`` are dropped from streams."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    aggs = [F.count("*").alias("n")] + ([F.round(F.sum(value), 6).alias("total")] if value else [])
    out = _late(df.where(F.col(ts).isNotNull()), ts, delay).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, delay: str | None = "1 hour") -> DataFrame:
    """``(session_start, session_end, keys, n)``: rows less than ``gap`` apart are one session; its end is the last row plus the gap."""
    out = _late(df.where(F.col(ts).isNotNull()), ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicated(df: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; in streams within the watermark, so that the state stays bounded."""
    df = _late(df, ts, delay)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def seed_counts_kernel(index: dict[int, np.ndarray], k: int):
    """For ``mapInArrow`` on (read_id, seq): ``(read_id, contig_id, n_seeds)``, against an index of k-mer codes held by every worker."""
    codes = np.concatenate([v for v in index.values()]) if index else np.empty(0, np.int64)
    owner = np.repeat(np.array(list(index), np.int64), [len(v) for v in index.values()]) if index else np.empty(0, np.int64)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            of, _, words = kmers_of([x or "" for x in batch.column(1).to_pylist()], k)
            lo, hi = np.searchsorted(codes, words), np.searchsorted(codes, words, side="right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pair, count = np.unique(np.stack([np.repeat(of, n), owner[at]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[0])), pa.array(pair[1]), pa.array(count)], ["read_id", "contig_id", "n_seeds"])

    return kernel


def stream_seed_counts(reads: DataFrame, contigs: DataFrame, k: int, max_index: int = 50_000_000) -> DataFrame:
    """Seeds that each (streaming or stored) read ``(read_id, seq)`` shares with each contig ``(contig_id, seq)``; no state is kept.

    The contigs' k-mers go to every worker, so their number is checked first; above ``max_index`` it is an error (use the seed join).
    """
    total = contigs.agg(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0)))).first()[0] or 0
    if total > max_index:
        raise ValueError(f"{total} k-mers are too many to hold on every worker")
    rows = contigs.select("contig_id", "seq").where("seq is not null").collect()
    index = {r[0]: np.unique(kmers_of([r[1]], k)[2]) for r in rows}
    return reads.select("read_id", "seq").mapInArrow(seed_counts_kernel(index, k), "read_id long, contig_id long, n_seeds long")
