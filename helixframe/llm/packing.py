"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths, which the capacity bounds, is worked on the driver: shallow combinations of length classes that
fill the capacity are enumerated, non-negative least squares finds how often to repeat each so that together they use up
the histogram, the counts are rounded down, and each is filled with real lengths, the last one or two chosen to leave
nothing over. What is left is packed greedily in the same way. The result is a list of patterns (lengths, times). Items get
their container from their rank among the items of their length, which is counted in buckets, never in one task.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut

#: Where the public tokenizer's vocabulary lies and how it splits text are parameters; this is the default file.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to this public vocabulary.
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES, DEPTH = 32, 8
_LOADED: dict[str, Callable[[str], int]] = {}


def token_counter(path: str = TOKENIZER_FILE, pattern: str = TOKENIZER_PATTERN) -> Callable[[str], int]:
    """Number of tokens of a text, by a vocabulary file of byte ranks. Loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = lambda text: len(encoding.encode_ordinary(text))
    return _LOADED[path]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set: columns enter one at a time, those that turn negative leave."""
    x = np.zeros(a.shape[1])
    held: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[held] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        held.append(j)
        while held:
            best = np.linalg.lstsq(a[:, held], b, rcond=None)[0]
            if (best > 0).all():
                break
            now = x[held]
            short = best <= 0
            step = float((now[short] / np.maximum(now[short] - best[short], 1e-300)).min())
            x[held] = now + step * (best - now)
            gone = [c for c in held if x[c] <= 1e-12]
            x[gone] = 0
            held = [c for c in held if c not in gone]
        x[:] = 0
        if held:
            x[held] = best
    return x


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling tuples of length classes 1..classes, ``depth`` long at most, that sum to ``classes``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < depth:
            for c in range(min(left, most), 0, -1):
                if c * (depth - len(head)) < left:
                    break
                extend((*head, c), left - c, c)

    extend((), classes, classes)
    return found


class _Stock:
    """Counts of lengths left, with the largest length up to a bound found fast."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            self.left[length] += count

    def largest(self, most: int, least: int = 1, used: Counter | None = None) -> int:
        for length in np.flatnonzero(self.left[least : most + 1])[::-1] + least:
            if not used or self.left[length] > used[int(length)]:
                return int(length)
        return 0

    def fill(self, space: int, used: Counter) -> None:
        """Add to ``used`` what fills the space best: one or two lengths that fit exactly, else the largest that fits, and so on."""
        while space > 0:
            free = self.left[: space + 1].copy()
            for length, n in used.items():
                if length <= space:
                    free[length] -= n
            if free[space] > 0:
                used[space] += 1
                return
            low = np.arange(1, space // 2 + 1)
            pairs = low[(free[low] > 0) & (free[space - low] > 0) & ((low * 2 < space) | (free[low] > 1))]
            if len(pairs):
                best = pairs[np.minimum(free[pairs], free[space - pairs]).argmax()]
                used[int(best)] += 1
                used[int(space - best)] += 1
                return
            rest = np.flatnonzero(free[1:] > 0)
            if not len(rest):
                return
            used[int(rest[-1]) + 1] += 1
            space -= int(rest[-1]) + 1

    def take(self, used: Counter, most: int) -> int:
        """Use the pattern as often as the stock allows, ``most`` times at most."""
        times = min([most, *(int(self.left[length]) // n for length, n in used.items())])
        for length, n in used.items():
            self.left[length] -= n * times
        return times


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (falling lengths, times) that hold every item of the histogram once, none over the capacity."""
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError("a length is outside 1..capacity")
    stock, patterns = _Stock(histogram, capacity), []

    def use(used: Counter, most: int) -> int:
        times = stock.take(used, most)
        patterns.append((tuple(sorted(used.elements(), reverse=True)), times))
        return times

    if stock.left[capacity]:
        use(Counter([capacity]), int(stock.left[capacity]))
    classes = min(classes, capacity)
    of = lambda c: (math.ceil((c - 1) * capacity / classes), c * capacity // classes)  # lengths above the first, up to the second
    edges = [of(c) for c in range(1, classes + 1)]
    share = np.array([stock.left[lo + 1 : hi + 1].sum() for lo, hi in edges], float)
    if share.sum():
        ways = combinations(classes, depth)
        a = np.zeros((classes, len(ways)))
        for j, way in enumerate(ways):
            for c in way:
                a[c - 1, j] += 1
        times = np.floor(nnls(a, share)).astype(np.int64)
        for j in sorted(range(len(ways)), key=lambda j: (-ways[j][0], -times[j])):  # the longest first, while there is most to fill up with
            wanted = int(times[j])
            while wanted > 0:
                used: Counter = Counter()
                space = capacity
                for c in ways[j][:-1]:  # the last part is what fills the space that is really left
                    lo, hi = edges[c - 1]
                    length = stock.largest(min(hi, space), lo + 1, used)
                    if length:
                        used[length] += 1
                        space -= length
                if not used:
                    break
                stock.fill(space, used)
                wanted -= max(1, use(used, wanted))
    while (first := stock.largest(capacity)) > 0:
        used = Counter([first])
        stock.fill(capacity - first, used)
        use(used, int(stock.left[first]) if len(used) == 1 and used[first] == 1 else 1 << 62)
    return patterns


def measure(df: DataFrame, row_id: str, text: str, capacity: int, path: str = TOKENIZER_FILE, pattern: str = TOKENIZER_PATTERN) -> DataFrame:
    """Items to pack: ``(row_id, piece, token_start, n_tokens)``.

    A text of up to ``capacity`` tokens is one item, a longer one is cut every ``capacity`` tokens. Null ids and null or blank texts
    (white space only) are no items; repeats of a row_id count once. Texts are counted whole.
    """

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path, pattern)
        for batch in it:
            n = np.array([count(t) if t.strip() else 0 for t in batch.column(1).to_pylist()], np.int64)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(np.minimum(capacity, n[row] - piece * capacity), pa.int32())],
                ["id", "piece", "token_start", "n_tokens"],
            )

    rows = df.select(df[row_id].alias("id"), df[text].alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(kernel, f"id {df.schema[row_id].dataType.simpleString()}, piece int, token_start long, n_tokens int").dropDuplicates(["id", "piece"]).withColumnRenamed("id", row_id)


def pack(items: DataFrame, keys: list[str], length: str, capacity: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """``items`` with a ``container_id`` from 0; lengths in a container sum to ``capacity`` at most, no item is split.

    ``keys`` must tell items apart; every length must lie in 1..capacity. An empty table stays empty. Extra columns are kept.
    """
    items = cut(items)
    histogram = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # a row per length: bounded by the capacity
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, times, first container
    upto: Counter = Counter()
    base = 0
    for lengths, times in plan(histogram, capacity):
        for x, n in Counter(lengths).items():
            slots.setdefault(x, []).append((upto[x], times, base))
            upto[x] += n * times
        base += times
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in slots.items()}

    buckets = max(8, sum(histogram.values()) // rows_per_bucket)
    placed = items.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    offsets = placed.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    offsets = offsets.select(length, "_bucket", (F.sum("_n").over(Window.partitionBy(length).orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_bucket", length).orderBy(*keys)) - 1
    ranked = placed.withColumn("_rank", local.cast("long")).join(offsets, [length, "_bucket"])
    ranked = ranked.select(*items.columns, (F.col("_rank") + F.col("_offset")).alias("_rank"))

    names = [*items.columns, "container_id"]

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, rank = batch[length].to_numpy(zero_copy_only=False), batch["_rank"].to_numpy(zero_copy_only=False)
            out = np.zeros(len(size), np.int64)
            for x in np.unique(size):
                here = np.flatnonzero(size == x)
                first, times, start = tables[int(x)]
                i = np.searchsorted(first, rank[here], side="right") - 1
                out[here] = start[i] + (rank[here] - first[i]) % times[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names)

    return ranked.mapInArrow(kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", container_id long")
