"""Evaluation texts that leak into training text, by a distributed positional inverted index.

The index is stored, and no search touches a text again. A segment (some millions of letters of documents that lie together) has one
row per bucket of terms, with the terms' counts and sorted positions, and one with its documents. Its rows lie together, so
neither building nor searching moves a posting: a search takes from each segment the buckets it needs, and only matches move. Items
come as a table, are spread by bucket, and are broadcast in blocks of bounded size, each of which is one pass over the index.

A phrase search takes every window of ``n`` words of an item at its rarest term, counted over all documents. That term's postings,
each shifted by the term's place in the item, are the candidates; they are intersected with the shifted postings of the terms
beside it, and what is left with those of the next ones, outwards. Runs of matches on one diagonal are exact phrase matches.
A proximity search starts from the rarest of an item's rarest terms and keeps, term by term, the positions that have it nearby in
the same document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.session import cut

#: Characters that count as absent: soft hyphen, zero-width space, non-joiner and joiner, byte order mark (fixed values).
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF])
_WORD = re.compile(r"[^\W_]+")
#: Letters of text in a segment, about; a longer document is a segment of its own.
SEGMENT_CHARS = 8_000_000
#: Term buckets of a segment. The row after the last one holds the segment's documents.
BUCKETS = 64
#: Item words searched in one pass over the index, about; they are broadcast to it.
BLOCK_WORDS = 1_000_000
_SEEN_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\ufeff]")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in folded case, invisible characters taken out."""
    if not text.isascii() and _SEEN_INVISIBLE.search(text):
        text = text.translate(INVISIBLE)
    return _WORD.findall(text.casefold())


def pack_postings(place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Rising positions of terms, one after the other, as steps of 1, 2 or 4 bytes, whichever the term's longest step needs: widths, data."""
    head = np.cumsum(counts) - counts
    step = np.diff(place, prepend=0)
    step[head] = place[head]
    longest = np.maximum.reduceat(step, head)
    width = np.where(longest < 1 << 8, 1, np.where(longest < 1 << 16, 2, 4))
    ends = np.cumsum(counts * width)
    data = np.zeros(int(ends[-1]), np.uint8)
    each = np.repeat(width, counts)
    at = np.repeat(ends - counts * width, counts) + (np.arange(len(place)) - np.repeat(head, counts)) * each
    for b in range(4):
        here = each > b
        data[at[here] + b] = (step[here] >> (8 * b)) & 0xFF
    return width.astype(np.uint8), data.tobytes()


def _segment(number: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """The rows of one segment, by bucket. Between two documents one position stays free, so no phrase runs across."""
    terms: dict[str, int] = {}
    sizes, flat = [], []
    for t in texts:
        found = words(t)
        sizes.append(len(found))
        flat += [terms.setdefault(w, len(terms)) for w in found]
    token = np.array(flat, np.int64)
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    place = np.arange(len(token)) + np.repeat(np.arange(len(sizes)), sizes)
    names = list(terms)
    bucket = np.array([crc32(w.encode()) % BUCKETS for w in names], np.int64)
    order = np.argsort(bucket, kind="stable")  # terms by bucket
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    place = place[np.argsort(rank[token], kind="stable")] if len(names) else place
    counts = np.bincount(rank[token], minlength=len(names)) if len(names) else np.empty(0, np.int64)
    upto = np.append(0, np.cumsum(counts))
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    rows = []
    for b, (a, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < e:
            width, data = pack_postings(place[upto[a] : upto[e]], counts[a:e])
            rows.append((number, b, "\n".join(names[i] for i in order[a:e]), counts[a:e].astype("<u4").tobytes(), width.tobytes(), data, None, None))
    rows.append((number, BUCKETS, None, None, None, None, ids, ends.tolist()))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["segment", "bucket", "terms", "counts", "widths", "positions", "doc_ids", "doc_ends"])


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of (doc_id, text) batches, one segment at a time."""
    number = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in it:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and size + len(t) > SEGMENT_CHARS:
                yield _segment(number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield _segment(number, ids, texts)


INDEX_SCHEMA = "segment bigint, bucket int, terms string, counts binary, widths binary, positions binary, doc_ids array<bigint>, doc_ends array<bigint>"


def index_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The index of all documents with an id and a text that isn't null; whole texts, every term and position."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(_segments, INDEX_SCHEMA)


@dataclass
class Index:
    """A stored index, to be searched any number of times. A segment's rows follow each other in ``rows``, by bucket."""

    rows: DataFrame


def build_index(docs: DataFrame, doc_id: str, text: str) -> Index:
    """An index of the documents in the session's shared folder."""
    return Index(cut(index_rows(docs, doc_id, text)))


def write_index(docs: DataFrame, doc_id: str, text: str, path: str) -> None:
    """The index as a Parquet table."""
    index_rows(docs, doc_id, text).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> Index:
    """A written index. Files may be split when they are read, so segments are put in order again."""
    return Index(spark.read.parquet(path).repartition("segment").sortWithinPartitions("segment", "bucket"))


def _item_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])


def _term_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each wanted term stands in the segments."""
    for batch in it:
        seen: dict[str, int] = {}
        for terms, counts, wanted in zip(*(batch[c].to_pylist() for c in ("terms", "counts", "wanted"))):
            of = dict(zip(terms.split("\n"), np.frombuffer(counts, "<u4").tolist()))
            for w in wanted:
                if w in of:
                    seen[w] = seen.get(w, 0) + of[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


_BUCKET = f"cast(pmod(crc32(encode(word, 'UTF-8')), {BUCKETS}) as int)"


def _by_bucket(terms: DataFrame) -> DataFrame:
    return terms.select("word").distinct().groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.collect_list("word").alias("wanted"))


def _blocks(items: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """(item_id, words) of each different item, in blocks of about ``BLOCK_WORDS`` words."""
    rows = items.select(items[item_id].cast("long").alias("item_id"), items[text].alias("text")).where("item_id is not null and text is not null")
    split = cut(rows.mapInArrow(_item_words, "item_id bigint, words array<string>").distinct())
    total = split.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // BLOCK_WORDS) or 1
    return [split if n == 1 else split.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def _counted(index: Index, block: DataFrame) -> DataFrame:
    """(item_id, words, at, word, n): the words of each item with their places and their counts over all documents, 0 for none."""
    placed = block.select("item_id", "words", F.posexplode("words").alias("at", "word"))
    told = index.rows.select("bucket", "terms", "counts").join(F.broadcast(_by_bucket(placed)), "bucket").select("terms", "counts", "wanted")
    counts = told.mapInArrow(_term_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return placed.join(counts, "word", "left").fillna(0, ["n"])


def _search(index: Index, wanted: DataFrame, work: DataFrame, find, schema: str) -> DataFrame:
    """``find(postings, doc_ids, doc_ends, work)`` for every segment, with the postings of the wanted words and the rows of ``work``.

    Both tables come from one block of items, so they are broadcast: the words to their buckets, the work to the row of the documents.
    """
    kind = work.schema.simpleString()
    everything = work.agg(F.collect_list(F.struct(*work.columns)).alias("work")).select(F.lit(BUCKETS).alias("bucket"), F.lit(None).cast("array<string>").alias("wanted"), "work")
    told = _by_bucket(wanted).select("bucket", "wanted", F.lit(None).cast(f"array<{kind}>").alias("work")).unionByName(everything)

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        segment = None
        for batch in it:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if row["segment"] != segment:
                    segment, held = row["segment"], {}
                if row["bucket"] < BUCKETS:
                    counts, widths = np.frombuffer(row["counts"], "<u4").astype(np.int64), np.frombuffer(row["widths"], np.uint8)
                    ends = np.cumsum(counts * widths)
                    of = {w: i for i, w in enumerate(row["terms"].split("\n"))}
                    for w in row["wanted"]:
                        i = of.get(w)
                        if i is not None:
                            data = row["positions"][int(ends[i] - counts[i] * widths[i]) : int(ends[i])]
                            held[w] = np.cumsum(np.frombuffer(data, f"<u{widths[i]}"), dtype=np.int64)
                elif held:
                    yield from find(held, np.array(row["doc_ids"], np.int64), np.array(row["doc_ends"], np.int64), row["work"])

    return index.rows.join(F.broadcast(told), "bucket").mapInArrow(kernel, schema)


def _present(postings: np.ndarray, at: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(postings, at), len(postings) - 1)
    return postings[i] == at


def _anchors(n: int):
    """Kernel: of each item with its counts, the rarest places of its windows, each with the stretch of the item its windows cover."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for item, ws, pairs in zip(*(batch[c].to_pylist() for c in ("item_id", "words", "counts"))):
                counts = np.zeros(len(ws), np.int64)
                for p in pairs:
                    counts[p["at"]] = p["n"]
                if len(ws) < n:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(counts, n)
                usable = (windows > 0).all(axis=1)
                anchors = np.arange(len(windows)) + windows.argmin(axis=1)
                for anchor in np.unique(anchors[usable]).tolist():
                    starts = np.flatnonzero(usable & (anchors == anchor))
                    lo, hi = int(starts[0]), int(starts[-1]) + n
                    out.append((item, anchor, lo, ws[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())))], ["item_id", "anchor", "lo", "stretch"])

    return kernel


def _phrases(n: int):
    def find(postings: dict[str, np.ndarray], doc_ids: np.ndarray, doc_ends: np.ndarray, work: list[dict]) -> Iterator[pa.RecordBatch]:
        found = []
        for x in work:
            lists = [postings.get(w) for w in x["stretch"]]
            at = x["anchor"] - x["lo"]
            if lists[at] is None:
                continue
            diagonal = lists[at] - at
            # Every window has the term before or the term after its rarest: both shifted lists are intersected first.
            near = np.zeros(len(diagonal), bool)
            for o in (at - 1, at + 1):
                if 0 <= o < len(lists) and lists[o] is not None:
                    near |= _present(lists[o], diagonal + o)
            diagonal = diagonal[near]
            first, last = np.full(len(diagonal), at), np.full(len(diagonal), at + 1)
            for step, edge in ((-1, first), (1, last)):
                alive, o = np.arange(len(diagonal)), at + step
                while len(alive) and 0 <= o < len(lists) and lists[o] is not None:
                    alive = alive[_present(lists[o], diagonal[alive] + o)]
                    edge[alive] += step
                    o += step
            ok = last - first >= n
            if ok.any():
                found.append((np.full(ok.sum(), x["item_id"]), diagonal[ok] - x["lo"], first[ok] + x["lo"], last[ok] + x["lo"]))
        if not found:
            return
        item, diagonal, first, last = (np.concatenate(c) for c in zip(*found))
        # Runs of overlapping windows on one diagonal are parts of one match.
        order = np.lexsort((last, first, diagonal, item))
        item, diagonal, first, last = item[order], diagonal[order], first[order], last[order]
        fresh = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (first[1:] > last[:-1]))
        head = np.flatnonzero(fresh)
        item, diagonal, first, last = item[head], diagonal[head], first[head], np.maximum.reduceat(last, head)
        doc = np.searchsorted(doc_ends, diagonal + first, side="right")
        place = diagonal + first - np.append(0, doc_ends)[doc]
        columns = [doc_ids[doc], item, place.astype(np.int32), first.astype(np.int32), (last - first).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return find


def phrase_matches(index: Index, items: DataFrame, item_id: str, text: str, n: int = 10) -> DataFrame:
    """Longest common stretches of ``n`` words or more: ``(doc_id, item_id, doc_word, item_word, n_words)``, both places from 0.

    Items of fewer than ``n`` words, null or empty texts and null ids match nothing; repeated items change nothing; a repeated
    document id gives the matches of all its texts.
    """
    found = []
    for block in _blocks(items, item_id, text):
        per_item = _counted(index, block).groupBy("item_id", "words").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
        anchors = cut(per_item.mapInArrow(_anchors(n), "item_id bigint, anchor int, lo int, stretch array<string>"))
        wanted = anchors.select(F.explode("stretch").alias("word"))
        found.append(_search(index, wanted, anchors, _phrases(n), "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int"))
    return reduce(DataFrame.unionByName, found).distinct()


def phrase_search(index: Index, items: DataFrame, item_id: str, text: str, n: int = 10) -> DataFrame:
    """``(doc_id, item_id)``, each pair once: ``n`` consecutive words of the item stand consecutively and in order in the document."""
    return phrase_matches(index, items, item_id, text, n).select("doc_id", "item_id").distinct()


def _close(within: int):
    def find(postings: dict[str, np.ndarray], doc_ids: np.ndarray, doc_ends: np.ndarray, work: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, items = [], []
        for x in work:
            lists = [postings.get(w) for w in x["rarest"]]
            if any(p is None for p in lists):
                continue
            at = lists[0]
            doc = np.searchsorted(doc_ends, at, side="right")
            for p in lists[1:]:
                i = np.searchsorted(p, at)
                ok = np.zeros(len(at), bool)
                for q in (p[np.minimum(i, len(p) - 1)], p[np.maximum(i - 1, 0)]):
                    ok |= (np.abs(q - at) < within) & (np.searchsorted(doc_ends, q, side="right") == doc)
                at, doc = at[ok], doc[ok]
            doc = np.unique(doc_ids[doc])
            docs.append(doc)
            items.append(np.full(len(doc), x["item_id"]))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(items), pa.int64())], ["doc_id", "item_id"])

    return find


def proximity_search(index: Index, items: DataFrame, item_id: str, text: str, terms: int = 6, within: int = 40) -> DataFrame:
    """``(doc_id, item_id)``: the item's ``terms`` rarest words all stand less than ``within`` words from the rarest one in the document.

    Rarity is how often a word stands in all documents (repeated rows as often as they are given), of equals the first by letters, so a
    pair doesn't depend on how the documents are split. Words that stand in no document are passed over; an item with fewer
    than ``terms`` other words matches nothing.
    """
    found = []
    for block in _blocks(items, item_id, text):
        counted = _counted(index, block).where("n > 0").select("item_id", "words", "word", "n").distinct()
        by = Window.partitionBy("item_id", "words").orderBy("n", "word")
        ranked = counted.withColumn("o", F.row_number().over(by)).where(F.col("o") <= terms).groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("o", "word"))).alias("r"))
        rarest = cut(ranked.where(F.size("r") == terms).select("item_id", F.col("r.word").alias("rarest")))
        found.append(_search(index, rarest.select(F.explode("rarest").alias("word")), rarest, _close(within), "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, found).distinct()
