"""Read mapping: seeds, chains, candidates, base-level alignment, filters, mapping quality."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import dp
from helixframe.functions.kmer_codes import kmer_counts
from helixframe.functions.seq import reverse_complement
from helixframe.operators.relational import best_hits
from helixframe.operators.seeds import contiguous_groups, maximal_matches, seed_join
from helixframe.session import cut


@dataclass(frozen=True)
class MapParams:
    """Options of a mapping run; scores are costs, so lower is better."""

    k: int = 14
    max_hits: int = 1000
    max_gap: int = 500
    min_chain_bases: int = 50
    candidates: int = 10
    band: int = 24
    pad: int = 40
    tile: int = 1 << 16
    min_read_length: int = 50
    max_score: int = -200
    min_identity: float = 70.0
    min_length: int = 50
    min_map_qv: int = 0
    best_n: int = 10
    policy: str = "bestn"
    seed: int = 0
    no_self: bool = False
    scores: dp.Scores = dp.Scores.named("long_read", insertion=5, deletion=5)


ANCHOR = "array<struct<q:int,t:int,length:int>>"


def chains(anchors: DataFrame, indel: float = 0.0, max_gap: int | None = None, max_ratio: float | None = None) -> DataFrame:
    """Best colinear chain of each (q_id, t_id, part): ``(…, q_start, q_end, t_start, t_end, weight, n_anchors, anchors)``.

    A group's anchors are bounded by the lengths of its two reads, or the read's length times a repeat cap. Chains of one anchor are kept.
    """
    grouped = anchors.groupBy("q_id", "t_id", "part").agg(F.collect_list(F.struct("q", "t", "length")).cast(ANCHOR).alias("anchors"))
    kinds = {c: grouped.schema[c].dataType.simpleString() for c in ("q_id", "t_id", "part")}

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[] for _ in range(7)]
            for group in batch["anchors"].to_pylist():
                group.sort(key=lambda a: (a["q"], a["t"], -a["length"]))
                q, t, n = (np.array([a[c] for a in group], np.int64) for c in ("q", "t", "length"))
                kept = [group[i] for i in dp.chain(q, t, n, indel, max_gap, max_ratio)]
                first, last = kept[0], kept[-1]
                for o, v in zip(out, (first["q"], last["q"] + last["length"], first["t"], last["t"] + last["length"], sum(a["length"] for a in kept), len(kept), kept)):
                    o.append(v)
            numbers = [pa.array(o, pa.int32()) for o in out[:6]]
            kept_type = pa.list_(pa.struct([("q", pa.int32()), ("t", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, pa.array(out[6], kept_type)], ["q_id", "t_id", "part", "q_start", "q_end", "t_start", "t_end", "weight", "n_anchors", "anchors"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", q_start int, q_end int, t_start int, t_end int, weight int, n_anchors int, anchors {ANCHOR}"
    return grouped.mapInArrow(kernel, schema)


def with_log_p(found: DataFrame, targets: DataFrame, target_id: str, seq: str, k: int) -> DataFrame:
    """Chains with ``log_p``: the natural log probability of meeting their anchors by chance.

    Of each anchor, its first k letters count with their share among the targets' k-mers and every further letter with 1/4;
    every anchor but the first also pays the chance of its place, one over the k-mers of all targets.
    """
    words = kmer_counts(targets, target_id, seq, k)
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    flat = found.select("q_id", "t_id", "part", F.posexplode("anchors").alias("i", "a")).join(targets.select(F.col(target_id).alias("t_id"), F.col(seq).alias("_seq")), "t_id")
    code = F.conv(F.translate(F.upper(F.expr(f"substring(_seq, a.t + 1, {k})")), "ACGT", "0123"), 4, 10).cast("long")
    each = flat.select("q_id", "t_id", "part", "i", F.col("a.length").alias("length"), code.alias("kmer")).join(words, "kmer")
    log_p = F.log(F.col("n") / total) + (F.col("length") - k) * math.log(0.25) + F.when(F.col("i") > 0, F.lit(-math.log(total))).otherwise(0.0)
    return found.join(each.groupBy("q_id", "t_id", "part").agg(F.round(F.sum(log_p), 6).alias("log_p")), ["q_id", "t_id", "part"])


def align_pairs(pairs: DataFrame, scores: dp.Scores, mode: str = "global", band: int | None = None, guide: str | None = None, method: str = "dp", keep_strings: bool = False, quality: str | None = None) -> DataFrame:
    """Pairs with columns ``query`` and ``target`` aligned; all other columns are kept, ``guide`` is dropped.

    ``quality`` names an array column with the query's quality values, by which its letters' scores are multiplied (see dp.align_many).

    Adds ``score, q_start, q_end, t_start, t_end, cigar, n_match, n_mismatch, n_ins, n_del, pct_similarity, drift`` and, if asked,
    the three gapped strings. ``method``: ``dp`` (see dp.align), ``sparse``, ``extend`` (from the starts), ``extend_back`` (from the ends), ``one_gap``. A null sequence, or a band that
    nothing passes, gives nulls.
    """
    kept = [c for c in pairs.columns if c != guide]
    ints = ["score", "q_start", "q_end", "t_start", "t_end", "n_match", "n_mismatch", "n_ins", "n_del", "drift"]
    texts = ["cigar", *(("q_string", "ticks", "t_string") if keep_strings else ())]

    def solve(qs: list[str], ts: list[str], gs: list, qvs: list | None) -> list[dp.Alignment | None]:
        if method == "sparse":
            return [dp.sparse_align(q, t, scores) for q, t in zip(qs, ts)]
        if method == "extend":
            return dp.extend_many(qs, ts, scores)
        if method == "extend_back":
            return dp.extend_back_many(qs, ts, scores)
        if method == "one_gap":
            return [dp.one_gap(q, t, scores) for q, t in zip(qs, ts)]
        return dp.align_many(qs, ts, scores, mode, band, [[(x["q"], x["t"], x["length"]) for x in g] if g else None for g in gs], qualities=qvs)

    def row(a: dp.Alignment | None, q: str, t: str) -> dict:
        if a is None:
            return {}
        found = {"score": a.score, "q_start": a.q_start, "q_end": a.q_end, "t_start": a.t_start, "t_end": a.t_end, "cigar": a.cigar(), "drift": a.drift(), **a.stats()}
        return found | dict(zip(("q_string", "ticks", "t_string"), a.strings(q, t))) if keep_strings else found

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            guides = batch[guide].to_pylist() if guide else [None] * batch.num_rows
            qs, ts = batch["query"].to_pylist(), batch["target"].to_pylist()
            known = [i for i in range(len(qs)) if qs[i] is not None and ts[i] is not None]
            rows: list[dict] = [{}] * len(qs)
            qvs = batch[quality].to_pylist() if quality else None
            for i, a in zip(known, solve([qs[i] for i in known], [ts[i] for i in known], [guides[i] for i in known], [qvs[i] for i in known] if qvs else None)):
                rows[i] = row(a, qs[i], ts[i])
            arrays = [batch[c] for c in kept] + [pa.array([r.get(c) for r in rows], pa.int32()) for c in ints]
            arrays += [pa.array([r.get("pct_similarity") for r in rows], pa.float64())] + [pa.array([r.get(c) for r in rows], pa.string()) for c in texts]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *ints, "pct_similarity", *texts])

    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} int" for c in ints] + ["pct_similarity double"] + [f"{c} string" for c in texts])
    # Alignment is the costly step: pairs are spread evenly first, however few files they came from.
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(kernel, schema)


def mapping_quality(hits: list[dict], overlap: float = 0.75, cap: int = 254) -> list[int]:
    """Qualities of one read's hits (q_start, q_end, score, n_match), in their order.

    Hits that overlap on the read by more than ``overlap`` of the shorter compete, first fit in order of score. A hit alone gets the cap;
    others -10 log10 of the chance of being wrong, from scores as log odds over the competitors with nearly as many matches.
    """
    order = sorted(range(len(hits)), key=lambda i: (hits[i]["score"], hits[i]["q_start"], i))
    parts: list[list[int]] = []
    for i in order:
        a = hits[i]
        for part in parts:
            b = hits[part[0]]
            shared = min(a["q_end"], b["q_end"]) - max(a["q_start"], b["q_start"])
            if shared > overlap * max(1, min(a["q_end"] - a["q_start"], b["q_end"] - b["q_start"])):
                part.append(i)
                break
        else:
            parts.append([i])
    found = [0] * len(hits)
    for part in parts:
        most = max(hits[i]["n_match"] for i in part)
        rivals = [i for i in part if hits[i]["n_match"] * 1.2 >= most]
        logs = [-hits[i]["score"] / 10 for i in rivals]
        top = max(logs)
        total = top + math.log10(sum(10 ** (x - top) for x in logs))
        for i in part:
            if len(part) == 1:
                found[i] = cap
                continue
            p = 10 ** (-hits[i]["score"] / 10 - total)
            found[i] = cap if p >= 1 else min(cap, int(-10 * math.log10(max(1 - p, 1e-26)))) if i in rivals else 0
    return found


def with_mapping_quality(df: DataFrame, read: str, row_id: str) -> DataFrame:
    """Hits with ``map_qv``; a read's hits (as many as candidates are kept) are judged together."""
    fields = ["q_start", "q_end", "score", "n_match"]
    grouped = df.groupBy(read).agg(F.sort_array(F.collect_list(F.struct(row_id, *fields))).alias("hits"))
    id_type = df.schema[row_id].dataType.simpleString()

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, qv = [], []
            for hits in batch.column(0).to_pylist():
                ids += [h[row_id] for h in hits]
                qv += mapping_quality(hits)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type.value_type.field(0).type), pa.array(qv, pa.int32())], [row_id, "map_qv"])

    return df.join(grouped.select("hits").mapInArrow(kernel, f"`{row_id}` {id_type}, map_qv int"), row_id)


def with_windows(found: DataFrame, contigs: DataFrame, tile: int) -> DataFrame:
    """``found`` with ``target``, the letters of contig ``t_id`` (of ``contigs``: t_id, seq) from ``_lo`` to ``_hi``.

    Contigs are cut into tiles, and a window is put together from the tiles it touches, so no row ever holds a contig; the tiles are
    met by an equi-join on contig and tile. An empty window gives an empty text.
    """
    tiles = contigs.select("t_id", F.col("seq"), F.explode(F.expr(f"sequence(0, greatest(length(seq) - 1, 0) div {tile})")).alias("_tile"))
    tiles = tiles.select("t_id", "_tile", F.expr(f"substring(seq, _tile * {tile} + 1, {tile})").alias("_letters"))
    rows = found.withColumn("_row", F.concat_ws(":", *(c for c in ("q_id", "t_id", "part", "_lo", "_hi"))))
    touched = rows.select("_row", "t_id", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {tile}, greatest(_hi - 1, _lo) div {tile})")).alias("_tile"))
    cut_out = F.expr(f"substring(_letters, greatest(_lo - _tile * {tile}, 0) + 1, least(_hi - _tile * {tile}, {tile}) - greatest(_lo - _tile * {tile}, 0))")
    # An empty window at a contig's end lies beyond the last tile.
    parts = touched.join(tiles, ["t_id", "_tile"], "left").select("_row", F.struct("_tile", F.coalesce(cut_out, F.lit("")).alias("s")).alias("x"))
    whole = parts.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("target"))
    return rows.join(whole, "_row").drop("_row")


def map_reads(reads: DataFrame, contigs: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Alignments of reads ``(read_id LONG, seq)`` to contigs ``(contig_id LONG, seq)``, both strands.

    Returns one row per hit: ``hit_id, read_id, contig_id, strand, q_length, t_length, score, q_start, q_end, t_start, t_end, cigar, n_match,
    n_mismatch, n_ins, n_del, pct_similarity, weight, n_anchors, map_qv, hit_rank, is_primary``. Coordinates are those of the read strand that
    aligns and of the forward contig. Null sequences, reads under the least length and letters other than A, C, G, T seed nothing.
    Shuffles: the k-mer join, the hits of a read and contig, the candidates of a read.
    """
    r = reads.where(F.length("seq") >= p.min_read_length).select((F.col("read_id") * 2).alias("q_id"), F.upper("seq").alias("seq"))
    r = r.unionByName(r.select((F.col("q_id") + 1).alias("q_id"), reverse_complement("seq").alias("seq")))
    c = contigs.where("seq is not null").select(F.col("contig_id").alias("t_id"), F.upper("seq").alias("seq"))
    hits = seed_join(r, c, "q_id", "t_id", "seq", p.k, p.max_hits)
    if p.no_self:
        hits = hits.where(F.expr("q_id div 2") != F.col("t_id"))
    found = chains(contiguous_groups(maximal_matches(hits, p.k), p.max_gap)).where(F.col("weight") >= p.min_chain_bases)
    best = Window.partitionBy(F.expr("q_id div 2")).orderBy(F.desc("weight"), "t_id", "t_start", "q_id")
    found = found.withColumn("_c", F.row_number().over(best)).where(F.col("_c") <= p.candidates)
    found = found.join(r.select("q_id", F.col("seq").alias("query")), "q_id").join(c.select("t_id", F.length("seq").alias("_t_length")), "t_id")
    # The window of the contig that the whole read can reach from its chain.
    reach = lambda n: (n * 1.3).cast("int") + p.pad
    lo = F.greatest(F.lit(0), F.col("t_start") - reach(F.col("q_start")))
    hi = F.least(F.col("_t_length"), F.col("t_end") + reach(F.length("query") - F.col("q_end")))
    found = with_windows(found.withColumn("_lo", lo).withColumn("_hi", hi), c, p.tile)
    guide = F.transform("anchors", lambda a: F.struct(a["q"].alias("q"), (a["t"] - F.col("_lo")).alias("t"), a["length"].alias("length")))
    pairs = found.select(
        "q_id", "t_id", "weight", "n_anchors", "_lo", F.length("query").alias("q_length"), F.col("_t_length").alias("t_length"), "query", "target", guide.alias("guide"),
    )
    done = align_pairs(pairs, p.scores, "local", p.band, "guide").drop("query", "target", "drift")
    done = done.withColumn("t_start", F.col("t_start") + F.col("_lo")).withColumn("t_end", F.col("t_end") + F.col("_lo")).drop("_lo")
    done = done.where((F.col("score") <= p.max_score) & (F.col("pct_similarity") >= p.min_identity) & (F.col("q_end") - F.col("q_start") >= p.min_length))
    # Of hits that lie in another of the same strand and contig with a score as good, only the better stays; a read has few.
    done = done.withColumn("strand", (F.col("q_id") % 2).cast("int")).withColumn("read_id", F.expr("q_id div 2")).withColumnRenamed("t_id", "contig_id").drop("q_id")
    done = done.withColumn("hit_id", F.concat_ws(":", "read_id", "contig_id", "strand", "t_start", "t_end", "q_start", "q_end")).dropDuplicates(["hit_id"])
    done = cut(done)  # read twice below
    a, b = done.alias("a"), done.select("hit_id", "read_id", "contig_id", "strand", "t_start", "t_end", "score").alias("b")
    same = (F.col("a.read_id") == F.col("b.read_id")) & (F.col("a.contig_id") == F.col("b.contig_id")) & (F.col("a.strand") == F.col("b.strand")) & (F.col("a.hit_id") != F.col("b.hit_id"))
    within = (F.col("a.t_start") >= F.col("b.t_start")) & (F.col("a.t_end") <= F.col("b.t_end"))
    worse = (F.col("a.score") > F.col("b.score")) | (F.col("a.score") == F.col("b.score")) & (F.col("a.hit_id") > F.col("b.hit_id"))
    done = a.join(b, same & within & worse, "left_anti")
    done = with_mapping_quality(done, "read_id", "hit_id").where(F.col("map_qv") >= p.min_map_qv)
    return best_hits(done, "read_id", "score", ["contig_id", "strand", "t_start", "q_start"], p.best_n, p.policy, p.seed)


def unaligned(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads without a hit."""
    return reads.join(hits.select("read_id"), "read_id", "left_anti")


def map_with_retry(reads: DataFrame, contigs: DataFrame, p: MapParams, sensitive: MapParams, min_identity: float = 80.0) -> DataFrame:
    """Mapping with a second, more sensitive pass for reads without a hit of ``min_identity``; their first hits are replaced."""
    first = map_reads(reads, contigs, p)
    good = first.where(F.col("pct_similarity") >= min_identity).select("read_id").distinct()
    again = map_reads(reads.join(good, "read_id", "left_anti"), contigs, sensitive)
    return first.join(good, "read_id", "left_semi").unionByName(again)
