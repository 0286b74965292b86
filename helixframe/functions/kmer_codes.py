"""k-mers of many sequences at once, as numbers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[np.frombuffer(_letters, np.uint8)] = _i
CHUNK_LETTERS = 2_000_000


def rolling(code: np.ndarray, k: int) -> np.ndarray:
    """Number of every k letters, first letter highest, by doubling (k up to 31)."""
    total = len(code) - k + 1
    if total <= 0:
        return np.empty(0, np.int64)
    have, width = code.astype(np.int64), 1
    out, done = np.zeros(total, np.int64), 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            out = (out << 2 * width) | have[done : done + total]
            done += width
        if (k >> (bit + 1)) == 0:
            break
        have = (have[:-width] << 2 * width) | have[width:]
        width *= 2
    return out


def kmers_of(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and code of all k-mers of A, C, G, T (any case)."""
    raw = [x.encode("ascii", "replace") for x in texts]
    lengths = np.array([len(x) + 1 for x in raw], np.int64)
    starts = np.cumsum(lengths) - lengths
    code = _CODE[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)] if raw else np.empty(0, np.uint8)
    if len(code) < k:
        return (np.empty(0, np.int64),) * 3
    bad = np.append(0, np.cumsum(code > 3))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    words = rolling(code & 3, k)[at]
    of = np.searchsorted(starts, at, side="right") - 1
    return of, at - starts[of], words


def kmer_table(df: DataFrame, row_id: str, seq: str, k: int, keep_position: bool = True) -> DataFrame:
    """``(row_id[, pos], kmer)``: every k-mer of A, C, G, T with its position from 0, as a code (first letter highest).

    Case doesn't matter; k-mers with other letters are left out, as are rows with a null id or sequence. k is 1 to 31. Without
    positions, equal k-mers of one batch come as one row with their number in ``n``.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")
    rows = df.select(df[row_id].alias("id"), df[seq].alias("seq")).where("id is not null and seq is not null")

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
        texts, at = batch.column(1).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK_LETTERS):
                size += len(texts[end])
                end += 1
            yield batch.column(0).slice(at, end - at), texts[at:end]
            at = end

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, texts in parts(batch):
                of, pos, code = kmers_of(texts, k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(pos, pa.int32()), pa.array(code)], ["id", "pos", "kmer"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, texts in parts(batch):
                code, n = np.unique(kmers_of(texts, k)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["kmer", "n"])

    if not keep_position:
        return rows.mapInArrow(counted, "kmer long, n long")
    return rows.mapInArrow(placed, f"id {df.schema[row_id].dataType.simpleString()}, pos int, kmer long").withColumnRenamed("id", row_id)


def kmer_counts(df: DataFrame, row_id: str, seq: str, k: int) -> DataFrame:
    """``(kmer, n)`` of all rows; counted per batch first, so a hot k-mer is a few rows when it is shuffled."""
    return kmer_table(df, row_id, seq, k, keep_position=False).groupBy("kmer").agg(F.sum("n").alias("n"))
