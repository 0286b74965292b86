"""Word indexes as tables: locate, prefix ranges, longest repeats, shared-word components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.kmer_codes import _CODE, kmer_table
from helixframe.functions.seq import encode_two_bit
from helixframe.operators.graph import connected_components
from helixframe.session import cut


def locate(patterns: DataFrame, pattern_id: str, pattern: str, texts: DataFrame, text_id: str, seq: str, k: int) -> DataFrame:
    """``(pattern_id, text_id, pos)``: every place where a pattern of k letters A, C, G, T stands; other patterns match nothing."""
    p = patterns.where(F.length(pattern) == k).select(pattern_id, encode_two_bit(F.upper(pattern)).alias("kmer")).where("kmer is not null")
    return kmer_table(texts, text_id, seq, k).join(p, "kmer").select(pattern_id, text_id, "pos")


def prefix_table(texts: DataFrame, text_id: str, seq: str, k: int) -> DataFrame:
    """``(kmer, n, n_texts, first_pos, last_pos)``: how many suffixes begin with each prefix, in how many texts, and where at the ends."""
    t = kmer_table(texts, text_id, seq, k)
    per = t.groupBy("kmer", text_id).agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("z"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"), F.min("a").alias("first_pos"), F.max("z").alias("last_pos"))


def _window_hashes(k: int):
    """Kernel over (row, seq, places): the two hashes of the window of k letters at each place (null: at all), where all are A, C, G, T."""
    bases = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, text, places in zip(*(batch[c].to_pylist() for c in ("row", "seq", "places"))):
                code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                if len(code) < k:
                    continue
                bad = np.append(0, np.cumsum(code > 3))
                at = np.flatnonzero(bad[k:] == bad[:-k])
                if places is not None:
                    at = np.intersect1d(at, places)
                pair = []
                for base in bases:
                    # Prefix sums of mixed letter * base^i; a window's sum is brought to one exponent by its place's inverse power.
                    power = np.full(len(code), base, np.uint64)
                    power[0] = 1
                    power = np.multiply.accumulate(power)
                    total = np.append(np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * base * power))
                    inverse = np.full(len(code), np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
                    inverse[0] = 1
                    pair.append((total[at + k] - total[at]) * np.multiply.accumulate(inverse)[at])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row), pa.int64()), pa.array(at, pa.int32()), *(pa.array(p.view(np.int64)) for p in pair)], ["row", "at", "a", "b"])

    return kernel


def longest_repeat(texts: DataFrame, seq: str) -> tuple[int, int]:
    """Length of the longest string of A, C, G, T that stands in two places, and how many strings of that length do; (0, 0) if none.

    Repeats of length k imply repeats of every smaller length in the same places, so the length is found by bisection, and each step
    looks only at the places that repeated at the greatest length so far. A step compares 128-bit hashes; the strings found at
    the end are compared letter by letter. Texts may be of any length; each is one row.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.upper(seq).alias("seq")).where(F.length("seq") > 0).repartition(parts)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "seq"))
    longest = rows.agg(F.max(F.length("seq"))).first()[0] or 0
    everywhere = rows.select("row", "seq", F.lit(None).cast("array<int>").alias("places"))

    def repeated(k: int, within: DataFrame) -> DataFrame:
        """(row, places) of the windows of k letters whose hash is met twice."""
        seen = within.mapInArrow(_window_hashes(k), "row long, at int, a long, b long")
        twice = seen.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
        return cut(seen.join(twice, ["a", "b"]).groupBy("row").agg(F.collect_list("at").alias("places")))

    def true_repeats(k: int, places: DataFrame) -> int:
        found = rows.join(places, "row").select("seq", F.explode("places").alias("at"))
        return found.groupBy(F.substring("seq", F.col("at") + 1, F.lit(k)).alias("s")).count().where("count > 1").count()

    low, high, at, within = 0, min(16, longest), None, everywhere
    while high > low:
        found = repeated(high, within)
        if found.limit(1).count():
            low, at, within = high, found, rows.join(found, "row").select("row", "seq", "places")
            if low == longest:
                break
            high = min(2 * high, longest)
        else:
            break
    while high - low > 1:
        middle = (low + high) // 2
        found = repeated(middle, within)
        if found.limit(1).count():
            low, at, within = middle, found, rows.join(found, "row").select("row", "seq", "places")
        else:
            high = middle
    while low:
        n = true_repeats(low, at)
        if n:
            return low, n
        low -= 1  # equal hashes of different strings, which isn't met in practice
        at = repeated(low, everywhere) if low else at
    return 0, 0


def shared_word_components(texts: DataFrame, text_id: str, seq: str, k: int) -> DataFrame:
    """``(v, component)``: texts that share a word of k letters, directly or through others. A word links its texts to the least one, never all pairs."""
    t = kmer_table(texts, text_id, seq, k).select("kmer", F.col(text_id).cast("long").alias("v")).distinct()
    hub = t.groupBy("kmer").agg(F.min("v").alias("src"), F.count("*").alias("n")).where("n > 1").select("kmer", "src")
    edges = t.join(hub, "kmer").select("src", F.col("v").alias("dst")).where("src <> dst").distinct()
    alone = texts.select(F.col(text_id).cast("long").alias("src")).where("src is not null").withColumn("dst", F.col("src"))
    return connected_components(edges.unionByName(alone))
