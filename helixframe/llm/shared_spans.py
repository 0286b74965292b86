"""Long exact spans shared between records, by prefix-partitioned suffix trees.

A span of ``least`` letters that stands in two records makes two suffixes agree to that depth: the suffix tree of all records has an
internal node of string depth ``least`` or more with leaves of both. The tree is built in parts that fit in memory:

1. Equal texts become one text with the number of its records. Texts are packed two bits a letter into chunks.
2. A suffix whose first letters stand nowhere else has no such node above it. Each chunk sends the hashes of its suffixes' first
   letters, Elias-Fano coded (about a byte and a half a suffix), to hash shards, which answer with those met twice. Only suffixes so
   marked go on; a hash met by chance costs work, never a result.
3. The marked suffixes are counted by prefix, and a prefix with too many is lengthened, letter group by letter group, until
   each group of neighbouring prefixes is one tree that fits in memory. Equal suffixes of a chunk travel as one.
4. A group sorts its suffixes, which are the leaves in tree order, and takes the longest common prefix (LCP) of neighbours: a run of
   LCPs of ``least`` is a deep node. Its records and the letters before its leaves say whether it is shared and left-diverse.
5. Chunks get back two bits a suffix. Shared suffixes cover the shared spans. Maximal repeats can begin only at left-diverse
   nodes, so only these suffixes are taken to their full length, and their subtrees' internal nodes are enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut

#: Letters of a chunk; a longer text is cut into overlapping pieces.
CHUNK_LETTERS = 2_000_000
#: Letters hashed in the first pass, at most.
WORD = 24
#: Suffixes of a group and leaves of a subtree in one task, at most (but for equal ones).
GROUP_SUFFIXES, SUBTREE_LEAVES = 1_000_000, 100_000
#: Hash values there are for each suffix of a shard: the share of suffixes marked by chance is about its inverse.
SPACE = 64
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_UNPACK = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
#: Bits of a leaf: 0 to 3 the letter before it, 4 none before it, 5 several leaves, 6 of a text that several records have.
_NONE, _SEVERAL, _COPIES = 16, 32, 64


def _words(code: np.ndarray, k: int) -> np.ndarray:
    """Every k letters (k <= 32) as a number, letter by letter from the high end, by doubling."""
    have, size, out, done = code.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            out = have if out is None else (out[: len(have) - done] << np.uint64(2 * size)) | have[done : done + len(out[: len(have) - done])]
            done += size
        if size * 2 > k:
            break
        have = (have[:-size] << np.uint64(2 * size)) | have[size:]
        size *= 2
    return out[: max(0, len(code) - k + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """Rising different numbers below 2**bits in Elias-Fano code."""
    n = len(values)
    if not n:
        return b""
    k = max(0, bits - int(n).bit_length())
    low = ((values[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.empty((n, 0), np.uint8)
    high = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    return n.to_bytes(8, "little") + bytes([k]) + np.packbits(low.reshape(-1)).tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    n, k = int.from_bytes(data[:8], "little"), data[8]
    size = -(-n * k // 8)
    low = np.unpackbits(np.frombuffer(data, np.uint8, size, 9), count=n * k).reshape(n, k).astype(np.uint64) if k else np.zeros((n, 0), np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=9 + size)))[:n] - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(k)) | (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _chunks(least: int):
    """Kernel: texts packed into chunks. Between texts stands a letter that parts them; a long text's pieces overlap by ``least`` - 1."""

    def packed(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        code = _CODE[np.frombuffer(b"".join(x[4] + b"\n" for x in held), np.uint8)]
        pad = np.append(code & 3, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
        body = (pad[:, 0] << 6) | (pad[:, 1] << 4) | (pad[:, 2] << 2) | pad[:, 3]
        cols = [[chunk], *([[x[i] for x in held]] for i in range(4)), [[len(x[4]) for x in held]], [body.astype(np.uint8).tobytes()], [np.flatnonzero(code > 3).astype(np.int32).tobytes()], [len(code)]]
        types = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["chunk", "keys", "low", "high", "at", "size", "body", "bad", "n"])

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held, letters = [], 0
        for batch in it:
            for key, low, high, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("ascii", "replace")
                for at in range(0, max(1, len(raw) - least + 1), CHUNK_LETTERS):
                    piece = raw[at : at + CHUNK_LETTERS + least - 1]
                    if held and letters + len(piece) > CHUNK_LETTERS + least:
                        yield packed(chunk, held)
                        chunk, held, letters = chunk + 1, [], 0
                    held.append((key, low, high, at, piece))
                    letters += len(piece) + 1
        if held:
            yield packed(chunk, held)

    return kernel


def _letters(body: bytes, bad: bytes, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a chunk's letters and the places where a suffix of ``least`` known letters begins."""
    code = _UNPACK[np.frombuffer(body, np.uint8)].reshape(-1)[:n]
    stops = np.zeros(n + 1, np.int32)
    stops[np.frombuffer(bad, np.int32) + 1] = 1
    stops = np.cumsum(stops)
    return code, np.flatnonzero(stops[least:] == stops[: n + 1 - least])


def _hashed(code: np.ndarray, places: np.ndarray, least: int, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(_words(code, min(least, WORD))[places])
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64), h & np.uint64((1 << bits) - 1)


def _text_of(row: dict, places: np.ndarray) -> np.ndarray:
    ends = np.cumsum(np.array(row["size"], np.int64) + 1)
    return np.searchsorted(ends, places, side="right")


def _offer(least: int, shards: int, bits: int):
    """Kernel: per chunk and shard the hashes met once there, and those known to be met twice (here, or in copies of the text)."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                code, places = _letters(row["body"], row["bad"], row["n"], least)
                shard, value = _hashed(code, places, least, shards, bits)
                several = (np.array(row["low"]) != np.array(row["high"]))[_text_of(row, places)]
                order = np.lexsort((value, shard))
                shard, value, several = shard[order], value[order], several[order]
                head = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (value[1:] != value[:-1]))) if len(order) else np.empty(0, np.int64)
                twice = (np.diff(np.append(head, len(order))) > 1) | (np.maximum.reduceat(several, head) if len(head) else np.empty(0, bool))
                shard, value = shard[head], value[head]
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                out = [(s, pack_sorted(value[a:b][~twice[a:b]], bits), pack_sorted(value[a:b][twice[a:b]], bits)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                if out:
                    s, once, more = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([row["chunk"]] * len(s), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["shard", "chunk", "once", "twice"])

    return kernel


def _answer(bits: int):
    """Of one shard: each chunk's hashes that are met twice in all."""

    def f(t: pa.Table) -> pa.Table:
        chunks, once, twice = t["chunk"].to_pylist(), [unpack_sorted(x) for x in t["once"].to_pylist()], [unpack_sorted(x) for x in t["twice"].to_pylist()]
        values = np.sort(np.concatenate([*once, *twice, *twice]))  # those known to be met twice count twice
        met = np.unique(values[1:][values[1:] == values[:-1]])
        marked = []
        for a, b in zip(once, twice):
            own = np.sort(np.concatenate([a, b]))
            marked.append(pack_sorted(own[np.isin(own, met, assume_unique=True)], bits))
        shard = t["shard"][0].as_py()
        rows = [(c, shard, m) for c, m in zip(chunks, marked) if m]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["chunk", "shard", "marked"])

    return f


def _columns(body: np.ndarray) -> list[np.ndarray]:
    """Rows of packed letters as numbers of 8 bytes, first to last."""
    width = -(-body.shape[1] // 8) * 8
    padded = np.zeros((len(body), width), np.uint8)
    padded[:, : body.shape[1]] = body
    return list(padded.view(">u8").astype(np.uint64).T)


def _leaves(least: int, shards: int, bits: int):
    """Kernel: a chunk's marked suffixes in order, equal ones as one, with their places."""
    width, spare = -(-least // 4), (-least % 4) * 2

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                code, places = _letters(row["body"], row["bad"], row["n"], least)
                shard, value = _hashed(code, places, least, shards, bits)
                keep = np.zeros(len(places), bool)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for x in row["marks"]:
                    here = order[cuts[x["shard"]] : cuts[x["shard"] + 1]]
                    marked = unpack_sorted(x["marked"])
                    at = np.minimum(np.searchsorted(marked, value[here]), len(marked) - 1)
                    keep[here] = marked[at] == value[here]
                places = places[keep]
                if not len(places):
                    continue
                padded = np.append(code, np.zeros(4 * width + 4, np.uint8))
                four = (padded[:-3] << 6) | (padded[1:-2] << 4) | (padded[2:-1] << 2) | padded[3:]
                body = four[places[:, None] + 4 * np.arange(width)]
                body[:, -1] &= np.uint8((0xFF << spare) & 0xFF)
                text = _text_of(row, places)
                low, high = np.array(row["low"])[text], np.array(row["high"])[text]
                bad = np.zeros(row["n"] + 1, bool)
                bad[np.frombuffer(row["bad"], np.int32) + 1] = True
                bad[0] = True
                first_of_text = np.array(row["at"])[text]  # a piece's first letter may have one before it, in the piece before
                before = np.where(bad[places], np.where((first_of_text > 0) & ((places == 0) | (_text_of(row, np.maximum(places - 1, 0)) != text)), _NONE | _SEVERAL, _NONE), 1 << code[np.maximum(places - 1, 0)])
                bits_of = (before | np.where(low != high, _SEVERAL | _COPIES, 0)).astype(np.uint8)
                columns = _columns(body)
                order = np.lexsort(columns[::-1])
                fresh = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0))
                head = np.flatnonzero(fresh)
                of = np.cumsum(fresh) - 1
                joined = np.bitwise_or.reduceat(bits_of[order], head) | np.where(np.diff(np.append(head, len(order))) > 1, _SEVERAL, 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]], pa.int64()), pa.array([len(head)], pa.int32()), pa.array([body[order[head]].tobytes()], pa.binary()), pa.array([joined.tobytes()], pa.binary()),
                        pa.array([np.minimum.reduceat(low[order], head).astype(np.int64).tobytes()], pa.binary()), pa.array([np.maximum.reduceat(high[order], head).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([places[order].astype(np.int32).tobytes()], pa.binary()), pa.array([of.astype(np.int32).tobytes()], pa.binary()),
                    ],
                    ["chunk", "n", "body", "before", "low", "high", "places", "of"],
                )

    return kernel


def _prefix_counts(kept: DataFrame, width: int, size: int, within: list[bytes] | None) -> dict[bytes, int]:
    """How many suffixes have each prefix of ``size`` packed bytes (four letters each), of those that begin like one of ``within``."""
    parents = np.array(within, f"S{size - 1}") if within is not None and size > 1 else None

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for body in batch.column(0).to_pylist():
                rows = np.frombuffer(body, np.uint8).reshape(-1, width)[:, :size]
                if parents is not None:
                    rows = rows[np.isin(np.ascontiguousarray(rows[:, :-1]).view(f"S{size - 1}").reshape(-1), parents)]
                keys, n = np.unique(np.ascontiguousarray(rows).view(f"V{size}").reshape(-1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n.astype(np.int64))], ["prefix", "c"])

    found = kept.select("body").mapInArrow(kernel, "prefix binary, c long").groupBy("prefix").agg(F.sum("c").alias("c")).collect()
    return {bytes(r.prefix): r.c for r in found}


def prefix_groups(kept: DataFrame, width: int, most: int) -> list[bytes]:
    """First prefixes of the groups, in order: neighbouring prefixes together up to ``most`` suffixes, longer prefixes where there are more.

    There are about two groups for every ``most`` suffixes, and at most 256 counts for each prefix that is lengthened.
    """
    size = min(2, width)
    counts = _prefix_counts(kept, width, size, None)
    final: dict[bytes, int] = {}
    while counts:
        large = [k for k, c in counts.items() if c > most and size < width]
        final |= {k: c for k, c in counts.items() if c <= most or size == width}
        if not large:
            break
        size += 1
        counts = _prefix_counts(kept, width, size, large)
    bounds, have = [], most + 1
    for key in sorted(final):
        if have + final[key] > most:
            bounds.append(key)
            have = 0
        have += final[key]
    return bounds


def _by_group(width: int, bounds: list[bytes]):
    """Kernel: the suffixes of a chunk, which are in order, cut at the groups' borders."""
    edges = _columns(np.frombuffer(b"".join(b.ljust(width, b"\0") for b in bounds), np.uint8).reshape(-1, width))

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                body = np.frombuffer(row["body"], np.uint8).reshape(-1, width)
                columns = _columns(body)
                merged = [np.concatenate([e, c]) for e, c in zip(edges, columns)]
                # An edge comes before the suffixes equal to it.
                order = np.lexsort([np.concatenate([np.zeros(len(bounds), np.int8), np.ones(len(body), np.int8)]), *merged[::-1]])
                starts = np.flatnonzero(order < len(bounds)) - np.arange(len(bounds))
                ends = np.append(starts[1:], len(body))
                out = [(g, row["chunk"], a, row["body"][a * width : b * width], row["before"][a:b], row["low"][a * 8 : b * 8], row["high"][a * 8 : b * 8]) for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())) if a < b]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4))], ["group", "chunk", "first", "body", "before", "low", "high"])

    return kernel


def common_letters(columns: list[np.ndarray], least: int) -> np.ndarray:
    """LCP, in letters, of each row of packed letters with the row before it (0 for the first), at most ``least``."""
    n = len(columns[0])
    lcp, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    open_[:1] = False
    for c in columns:
        differ = np.append(np.uint64(0), c[1:] ^ c[:-1])
        # The leading zero bits of the difference, two a letter; exact, as the upper and lower halves are taken apart.
        upper, lower = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(upper > 0, np.frexp(upper)[1] + 32, np.frexp(lower)[1])
        same = (64 - bits) // 2
        lcp = np.where(open_, lcp + same, lcp)
        open_ &= differ == 0
    return np.minimum(lcp, least)


def _tree(least: int):
    """Of one group: which suffixes lie below a deep node that several records share, and below one that is left-diverse too."""
    width = -(-least // 4)

    def f(t: pa.Table) -> pa.Table:
        sizes = [len(x) for x in t["before"].to_pylist()]
        join = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        columns, before, low, high = _columns(join("body", np.uint8).reshape(-1, width)), join("before", np.uint8), join("low", np.int64), join("high", np.int64)
        order = np.lexsort(columns[::-1])
        lcp = common_letters([c[order] for c in columns], least)
        head = np.flatnonzero(lcp < least)  # a node's leaves: from here on all LCPs are deep
        node = np.cumsum(lcp < least) - 1
        shared = np.minimum.reduceat(low[order], head) != np.maximum.reduceat(high[order], head)
        letters = np.bitwise_or.reduceat(before[order], head)
        several = (np.diff(np.append(head, len(order))) > 1) | (letters & _SEVERAL > 0)
        kinds = np.unpackbits((letters & 31)[:, None], axis=1).sum(axis=1)
        diverse = shared & ((kinds > 1) | several & (letters & _NONE > 0))
        deep, wide = np.zeros(len(order), bool), np.zeros(len(order), bool)
        deep[order], wide[order] = shared[node], diverse[node]
        ends = np.cumsum(sizes)
        out = [(c, a, np.packbits(deep[e - n : e]).tobytes(), np.packbits(wide[e - n : e]).tobytes(), n) for c, a, n, e in zip(t["chunk"].to_pylist(), t["first"].to_pylist(), sizes, ends) if deep[e - n : e].any()]
        kinds_of = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds_of)], ["chunk", "first", "deep", "wide", "n"])

    return f


def _answered(df: DataFrame, row_id: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key, text; per chunk its suffixes' places and the answers of the trees)."""
    if least < 4:
        raise ValueError("least must be 4 or more")
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    keyed = rows.select("id", F.md5("text").alias("key"), "text")
    texts = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("text").alias("text"))
    chunks = cut(texts.select("key", "low", "high", "text").mapInArrow(_chunks(least), "chunk long, keys array<string>, low array<bigint>, high array<bigint>, at array<bigint>, size array<int>, body binary, bad binary, n int"))
    letters = chunks.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    cores = max(2, spark.sparkContext.defaultParallelism)
    shards = max(cores, -(-letters // 4_000_000))
    bits = min(33, max(8, int(SPACE * letters / shards).bit_length()))
    offered = chunks.mapInArrow(_offer(least, shards, bits), "shard int, chunk long, once binary, twice binary")
    answers = offered.groupBy("shard").applyInArrow(_answer(bits), "chunk long, shard int, marked binary")
    marks = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "marked")).alias("marks"))
    kept = cut(chunks.join(marks, "chunk").mapInArrow(_leaves(least, shards, bits), "chunk long, n int, body binary, before binary, low binary, high binary, places binary, of binary"))
    total = kept.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    width = -(-least // 4)
    bounds = prefix_groups(kept, width, max(20_000, min(GROUP_SUFFIXES, total // (2 * cores)))) or [b""]
    grouped = kept.select("chunk", "body", "before", "low", "high").mapInArrow(_by_group(width, bounds), "group int, chunk long, first int, body binary, before binary, low binary, high binary")
    told = grouped.groupBy("group").applyInArrow(_tree(least), "chunk long, first int, deep binary, wide binary, n int")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("first", "deep", "wide", "n")).alias("told"))
    return keyed, chunks.select("chunk", "keys", "at", "size").join(kept.select("chunk", "places", "of"), "chunk").join(told, "chunk")


def _places(row: dict, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's places whose suffix has the answer ``which``, rising; their texts; their places in the texts."""
    of, places = np.frombuffer(row["of"], np.int32), np.frombuffer(row["places"], np.int32).astype(np.int64)
    hit = np.zeros(int(of[-1]) + 1, bool)
    for x in row["told"]:
        hit[x["first"] : x["first"] + x["n"]] = np.unpackbits(np.frombuffer(x[which], np.uint8), count=x["n"]).astype(bool)
    found = np.sort(places[hit[of]])
    sizes = np.array(row["size"], np.int64) + 1
    text = np.searchsorted(np.cumsum(sizes), found, side="right")
    return found, text, found - (np.cumsum(sizes) - sizes)[text] + np.array(row["at"], np.int64)[text]


def _spans(least: int):
    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                _, text, at = _places(row, "deep")
                if len(at):
                    head = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] - at[:-1] > least)))
                    last = np.append(head[1:], len(at)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([row["keys"][i] for i in text[head]]), pa.array(at[head], pa.int64()), pa.array(at[last] + least, pa.int64())], ["key", "s", "e"])

    return kernel


def _wide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row in batch.to_pylist():
            _, text, at = _places(row, "wide")
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([row["keys"][i] for i in text]), pa.array(at, pa.int64())], ["key", "at"])


def shared_spans(df: DataFrame, row_id: str, text: str, least: int = 60) -> DataFrame:
    """Longest stretches of each record covered by pieces of ``least`` letters that also stand in another record.

    Returns ``(row_id, span_start, span_end)``, half-open; overlapping and touching pieces are one stretch. Only capital A, C,
    G, T count, all other letters part the text. Ids are whole numbers; rows with a null id or text give nothing, and
    repeats of an id are the same record, never another. ``least`` is any number from 4 on.
    """
    keyed, pieces = _answered(df, row_id, text, least)
    spans = pieces.mapInArrow(_spans(least), "key string, s long, e long")
    spans = keyed.select("id", "key").join(spans, "key").select("id", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")).distinct()
    w = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(reach >= F.col("s"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "_island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
    return spans.select(F.col("id").cast(df.schema[row_id].dataType).alias(row_id), "span_start", "span_end")


NODE = "repeat string, length int, n_records long, n_places long"


def _subtree(t: pa.Table) -> pa.Table:
    """Left-diverse internal nodes of one prefix's subtree, by the LCPs of its sorted suffixes."""
    rows = sorted(zip(t["suffix"].to_pylist(), t["before"].to_pylist(), t["key"].to_pylist(), t["copies"].to_pylist()))
    # A text of several records is several leaves, of which two say all.
    leaves = [(s, b, k, c, n) for s, b, k, c in rows for n in ([c] if c == 1 else [1, c - 1])]
    lcp = [0, *(len(commonprefix([a[0], b[0]])) for a, b in zip(leaves, leaves[1:])), 0]
    out, stack = [], []
    for i in range(1, len(leaves) + 1):
        left = i - 1
        while stack and stack[-1][0] > lcp[i]:
            depth, left = stack.pop()
            inside = leaves[left:i]
            before = {x[1] for x in inside}
            records = sum({x[2]: x[3] for x in inside}.values())
            if records > 1 and (len(before) > 1 or "" in before):
                out.append((inside[0][0][:depth], depth, records, sum(x[4] for x in inside)))
        if i < len(leaves) and (not stack or stack[-1][0] < lcp[i]):
            stack.append((lcp[i], left))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["repeat", "length", "n_records", "n_places"])


def _depth(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        depth = [len(commonprefix([a, b])) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["g"], pa.array(depth, pa.int32())], ["g", "d"])


def maximal_repeats(df: DataFrame, row_id: str, text: str, least: int = 60, subtree: int = SUBTREE_LEAVES) -> DataFrame:
    """Maximal repeats of ``least`` letters or more that stand in two records or more: ``(repeat, length, n_records, n_places)``.

    A repeat is maximal if it can't be lengthened to either side in all its places: an internal node of the tree with different letters
    before it. The ends of a text, and of a stretch of A, C, G, T, differ from everything. A subtree of more than ``subtree`` leaves is
    taken apart by its branches, node by node, until every part fits. Nulls and repeated ids as in ``shared_spans``.
    """
    keyed, pieces = _answered(df, row_id, text, least)
    texts = keyed.groupBy("key").agg(F.count_distinct("id").alias("copies"), F.first("text").alias("text"))
    starts = pieces.mapInArrow(_wide, "key string, at long").distinct().join(texts, "key")
    letter = F.expr("if(at > 0, substring(text, cast(at as int), 1), '')")
    leaves = starts.select("key", "copies", F.regexp_extract(F.expr("substring(text, cast(at as int) + 1)"), "^[ACGT]+", 0).alias("suffix"), F.when(letter.isin("A", "C", "G", "T"), letter).otherwise("").alias("before"))
    leaves = cut(leaves.select(F.substring("suffix", 1, least).alias("g"), "*"))
    nodes = None
    while True:
        large = cut(leaves.groupBy("g").agg(F.count("*").alias("n"), F.min("suffix").alias("a"), F.max("suffix").alias("b")).where(F.col("n") > subtree))
        more = large.limit(1).count() > 0
        small = (leaves.join(large, "g", "left_anti") if more else leaves).groupBy("g").applyInArrow(_subtree, NODE)
        nodes = small if nodes is None else nodes.unionByName(small)
        if not more:
            return nodes
        # The top node of a large subtree, from counts; its children are the next subtrees.
        part = leaves.join(large.select("g", "a", "b").mapInArrow(_depth, "g string, d int"), "g").withColumn("child", F.expr("substring(suffix, d + 1, 1)"))
        records = part.select("g", "key", "copies").distinct().groupBy("g").agg(F.sum("copies").alias("n_records"))
        tops = part.groupBy("g", "d").agg(F.expr("substring(min(suffix), 1, d)").alias("repeat"), F.sum("copies").alias("n_places"), F.count_distinct("before").alias("kinds"), F.max(F.col("before") == "").alias("open"))
        tops = tops.join(records, "g").where((F.col("n_records") > 1) & ((F.col("kinds") > 1) | F.col("open")))
        nodes = nodes.unionByName(tops.select("repeat", F.col("d").alias("length"), "n_records", "n_places"))
        leaves = cut(part.where("child <> ''").select(F.expr("substring(suffix, 1, d + 1)").alias("g"), "key", "copies", "suffix", "before"))
