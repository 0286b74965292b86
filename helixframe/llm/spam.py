"""Pages of repeated keywords, link lists and product tags, found by thresholds on stretches of text.

A text is cut into stretches of about two dozen words along its lines. Of each stretch: the share of function words, of
words in links, of the most frequent word, of the most frequent word pair, of word pairs and of whole lines that the page
repeats, the density of separators and the share of tokens with digits. A stretch without sentences (few function words) that is
repetitive or split by separators, and that isn't a listing of data, is junk, and so is one made of links. A page is reported if
more than half of its words stand in junk stretches. All thresholds are calibrated per language on a bounded sample of rated
pages; the fixed defaults stand where there are too few. No list of selling words is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """
a about above after all also although am an and any are as at be because been before being below between both but by can could did do does down
during each either every few for from had has have he her here his how i if in into is it its just many more most much must my neither no nor not
nothing of off on once one only or other our out over own per she should since so some still such than that the their them then there these they
this those though through to too twice under until up us was we were what when where which while who why will with within without would yet you your
aber alle als also am an auch auf aus bei beim bis da damit dann das dass davon dem den denn der des die dies diese dieser doch dort durch ein eine
einem einen einer eines er erst es fiel für hat haben hier hinter ich ihr im in ist ja jede jedes jeder kann kein keine man mehr mit nach nicht noch nur ob
oder ohne sehr seit sich sie sind so um und uns unter von vor war waren was weil wenn wer wie wir wird wurde wurden zu zum zur zwischen über
au aux avec ce ces cette chez comme dans de des donc du elle en encore entre est et été il ils je la le les leur lui mais même ne nous on ont ou où par
pas plus pour puis qu que qui quand rien sa sans se sera ses si son sont sous sur tant tout tous très un une vers vous y à étaient était
al algo ante antes así aunque cada como con contra cuando de del desde donde el ella ellos en entre era eran es esta este están está fue ha han hay la las lo los
más me mi mientras muy nada ni no nos o para pero por porque que se según ser si sin sobre su sus también tan tras un una unos y ya
""".split()
)
_LINK = r"(?:https?://|www\.)\S+|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,9}/\S*"
_TOKEN = re.compile(_LINK + r"|[^\W_]+|[|,;/·•*#+~<>=]+|::|(?<=\s)[-–—](?=\s)|\n")
_WORD = re.compile(r"[^\W_]+")
_SEQUENCE = re.compile(r"[ACGTNacgtn]{12,}$")
STRETCH, LEAST = 24, 8
#: A stretch of fewer words is too short to be called repetitive.
JUDGED = 5
#: Share of repeated word pairs from which a stretch counts as said over and over.
REPETITIVE = 0.6
#: At most so many rated pages, of at most so many letters each, are used to calibrate.
MAX_RATED, MAX_RATED_CHARS = 2_000, 100_000
BREAK, SEPARATOR = 0, 1
LANGUAGES = ("en", "de", "fr", "es")


@dataclass(frozen=True)
class Limits:
    """Thresholds of a stretch. ``function`` and ``data``: what is less is no sentence, no data; the others: least share that makes junk."""

    function: float = 0.2
    data: float = 0.46
    link: float = 0.4
    top: float = 0.25
    gram: float = 0.3
    repeat: float = 0.2
    duplicate: float = 0.3
    separator: float = 0.15


#: Thresholds tried in the calibration, for each limit in this order; a default stays unless another one does better.
TRIED = {
    "function": (0.12, 0.16, 0.25),
    "data": (0.3, 0.36, 0.42),
    "link": (0.25, 0.55),
    "separator": (0.1, 0.25, 0.35),
    "repeat": (0.1, 0.3, 0.5),
    "top": (0.18, 0.34),
    "gram": (0.2, 0.4),
    "duplicate": (0.15, 0.5),
}


@dataclass(frozen=True)
class Model:
    by_language: dict[str, Limits] = field(default_factory=dict)
    share: float = 0.5

    def limits(self, lang: str) -> Limits:
        return self.by_language.get(lang, self.by_language.get("", Limits()))


def language(lang: str | None) -> str:
    """The language in lower case; '' if it is null or none of the known ones."""
    lang = (lang or "").strip().lower()[:2]
    return lang if lang in LANGUAGES else ""


@dataclass
class Stretches:
    """Features per stretch; ``doc`` is the number of its text."""

    doc: np.ndarray
    words: np.ndarray
    function: np.ndarray
    data: np.ndarray
    link: np.ndarray
    top: np.ndarray
    gram: np.ndarray
    repeat: np.ndarray
    duplicate: np.ndarray
    separator: np.ndarray


class Vocabulary:
    """Numbers of tokens and what is known of each, kept over the batches of a worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number = {"\n": BREAK}
        self.kind: list[tuple[int, int, int, int]] = [(0, 0, 0, 0), (0, 0, 0, 0)]  # words, function, link, data

    def add(self, token: str) -> int:
        c = token[0]
        if not (c.isalnum() or c == "_") and not (len(token) > 2 and _WORD.search(token)):
            self.number[token] = SEPARATOR
            return SEPARATOR
        low = token.lower()
        inner = _WORD.findall(token)
        link = len(inner) > 1 or "/" in token or "." in token
        n = max(1, len(inner))
        digits = not link and (any(x.isdigit() for x in token) or bool(_SEQUENCE.match(token)))
        kind = (n, int(low in FUNCTION_WORDS), n if link else 0, int(digits))
        i = self.number.get(low)
        if i is None or self.kind[i] != kind:
            i = len(self.kind)
            self.kind.append(kind)
            self.number.setdefault(low, i)
        self.number[token] = i
        return i


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _said_again(token: np.ndarray, line: np.ndarray, doc: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Whether each word stands in a line of two words or more that its text has at least twice; lines are equal by their words."""
    at = np.flatnonzero(is_word)
    again = np.zeros(len(token), bool)
    if not len(at):
        return again
    head = np.flatnonzero(np.append(True, line[at][1:] != line[at][:-1]))
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, size)
    code = np.add.reduceat(_mixed(token[at].astype(np.uint64) * np.uint64(1_000_003) + place.astype(np.uint64)), head)
    code = _mixed(code ^ _mixed(doc[at][head].astype(np.uint64)))
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    again[at] = np.repeat((times[inverse] >= 2) & (size >= 2), size)
    return again


def stretches(texts: list[str], vocabulary: Vocabulary) -> Stretches:
    if len(vocabulary.number) > 2_000_000:
        vocabulary.clear()
    get, add = vocabulary.number.get, vocabulary.add
    flat: list[int] = []
    counts = []
    for t in texts:
        found = _TOKEN.findall(t)
        counts.append(len(found) + 1)
        ids = [get(x) for x in found]
        if None in ids:
            ids = [add(x) if i is None else i for x, i in zip(found, ids)]
        flat += ids
        flat.append(BREAK)
    token = np.array(flat, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    kind = np.array(vocabulary.kind, np.int64)
    words = kind[token, 0]
    # Lines: between breaks. Stretches: a line of LEAST words or more is cut every STRETCH words; shorter ones are put together.
    is_word = words > 0
    line = np.cumsum(token == BREAK) - (token == BREAK)
    upto = np.cumsum(words) - words
    line_start = np.minimum.reduceat(upto, np.flatnonzero(np.append(True, line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
    line_words = np.bincount(line, words, minlength=len(line_start)).astype(np.int64) if len(line) else np.empty(0, np.int64)
    line_doc = doc[np.flatnonzero(np.append(True, line[1:] != line[:-1]))] if len(line) else line_start
    long = line_words >= LEAST
    # A new group of lines begins at each long line, after one, at a new text, and where STRETCH words are full.
    fresh = np.append(True, long[1:] | long[:-1] | (line_doc[1:] != line_doc[:-1])) if len(long) else long
    group = np.cumsum(fresh) - 1
    group_start = line_start[np.flatnonzero(fresh)]
    part = (upto - group_start[group[line]]) // STRETCH
    key = group[line] * (int(part.max(initial=0)) + 1) + part
    # A break after a short line of words separates like a comma.
    ends_line = (token == BREAK) & (line_words[line] > 0) & ~long[line]
    kept = is_word | (token == SEPARATOR) | ends_line
    again = _said_again(token, line, doc, is_word)
    key, doc, token, words, again, kind_of = key[kept], doc[kept], token[kept], words[kept], again[kept], kind
    if not len(key):
        empty = np.empty(0)
        return Stretches(empty.astype(np.int64), *[empty] * 9)
    order = np.argsort(key, kind="stable")
    key, doc, token, words, again = key[order], doc[order], token[order], words[order], again[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    n = len(heads)
    total = np.bincount(of, words, n)
    count = np.maximum(np.bincount(of, words > 0, n), 1)
    safe = np.maximum(total, 1)
    plain = np.flatnonzero((words > 0) & (kind_of[token, 2] == 0))

    def most(of_each: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How often the most frequent code of each stretch stands there."""
        found = np.zeros(n, np.int64)
        if len(code):
            numbers = np.unique(code, return_inverse=True)[1]
            uniq, times = np.unique(of_each * np.int64(len(code) + 1) + numbers, return_counts=True)
            np.maximum.at(found, uniq // (len(code) + 1), times)
        return found

    top = most(of[plain], token[plain])
    # Word pairs, of words that aren't data: the most frequent one of the stretch, and those that the text has three times or more.
    spoken = plain[kind_of[token[plain], 3] == 0]
    gram, repeat = np.zeros(n, np.int64), np.zeros(len(spoken))
    if len(spoken) > 1:
        t, d, o = token[spoken], doc[spoken], of[spoken]
        pair = t[:-1] * np.int64(len(kind_of)) + t[1:]
        inside = o[:-1] == o[1:]
        gram = most(o[:-1][inside], pair[inside])
        code = _mixed(pair.astype(np.uint64)) ^ _mixed(d[:-1].astype(np.uint64) + np.uint64(1 << 40))
        _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
        hit = (times[inverse] >= 3) & (d[:-1] == d[1:])
        repeat[:-1] = hit
        repeat[1:] = np.maximum(repeat[1:], hit)
    share = lambda k: np.bincount(of, kind_of[token, k], n)
    return Stretches(
        doc[heads], total, share(1) / safe, share(3) / count, share(2) / safe, top / count, np.where(gram > 1, 2 * gram, 0) / count,
        np.bincount(of[spoken], repeat, n) / count, np.bincount(of, words * again, n) / safe, np.bincount(of, token <= SEPARATOR, n) / count,
    )


def junk(s: Stretches, limits: list[Limits]) -> np.ndarray:
    """Whether each stretch is junk, by the limits of its text."""
    if not len(s.doc):
        return np.zeros(0, bool)
    at = lambda name: np.array([getattr(x, name) for x in limits])[s.doc]
    listed = np.zeros(len(s.doc), bool)
    for name in ("top", "gram", "repeat", "duplicate", "separator"):
        listed |= getattr(s, name) >= at(name)
    # Phrases said over and over may hold a few more function words ("near me", "for", "no").
    few = s.function < at("function") * np.where(s.repeat >= REPETITIVE, 1.5, 1.0)
    wordless = few & (s.data < at("data")) & (s.words >= JUDGED)
    return (s.link >= at("link")) | wordless & listed


def junk_share(texts: list[str], langs: list[str | None], model: Model, vocabulary: Vocabulary) -> np.ndarray:
    """Share of each text's words in junk stretches; 0 for a text without words."""
    s = stretches(texts, vocabulary)
    bad = junk(s, [model.limits(language(x)) for x in langs])
    words = np.bincount(s.doc, s.words, len(texts))
    return np.bincount(s.doc, s.words * bad, len(texts)) / np.maximum(words, 1)


def fit(texts: list[str], langs: list[str | None], spam: list[bool], least_rated: int = 30, share: float = 0.5) -> Model:
    """Thresholds from rated pages, limit by limit; a language with fewer than ``least_rated`` takes those of all pages.

    A limit is moved only where that leaves at least one page in a hundred, and one page, less wrongly judged: as a few ratings are
    wrong, smaller gains are chance.
    """
    s = stretches(texts, Vocabulary())
    of = np.array([language(x) for x in langs], object)
    truth = np.array(spam, bool)
    words = np.maximum(np.bincount(s.doc, s.words, len(texts)), 1)

    def wrong(limits: Limits, here: np.ndarray) -> int:
        bad = junk(s, [limits] * len(texts))
        return int((((np.bincount(s.doc, s.words * bad, len(texts)) / words > share) != truth) & here).sum())

    chosen: dict[str, Limits] = {}
    for lang in ("", *LANGUAGES):
        here = np.ones(len(texts), bool) if not lang else of == lang
        if here.sum() < least_rated:
            continue
        limits = chosen.get("", Limits())
        least, gain = wrong(limits, here), max(1, here.sum() / 100)
        for name, values in TRIED.items():
            tried = [(wrong(replace(limits, **{name: v}), here), i, v) for i, v in enumerate(values)]
            errors, _, value = min(tried)
            if errors <= least - gain:
                least, limits = errors, replace(limits, **{name: value})
        chosen[lang] = limits
    return Model(by_language=chosen, share=share)


def calibrate(docs: DataFrame, doc_id: str, text: str, lang: str, ratings: DataFrame, label: str, spam_label: str) -> Model:
    """A model fitted to rated pages. Ratings that contradict each other evenly are left out; at most ``MAX_RATED`` pages are used."""
    rated = ratings.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.avg(F.when(F.col(label) == spam_label, 1.0).otherwise(0.0)).alias("_spam"))
    rated = rated.where("_spam <> 0.5").orderBy(F.xxhash64(doc_id), doc_id).limit(MAX_RATED)
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= MAX_RATED_CHARS)).select(doc_id, text, lang).join(F.broadcast(rated), doc_id)
    rows = sorted(rows.collect(), key=lambda r: r[0])
    return fit([r[1] for r in rows], [r[2] for r in rows], [r[3] > 0.5 for r in rows])


def junk_shares(docs: DataFrame, doc_id: str, text: str, lang: str, model: Model, chunk_chars: int = 2_000_000) -> DataFrame:
    """``(doc_id, junk_share)`` of every document with an id; a null, blank or wordless text has share 0. Whole texts are read."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in it:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            langs = batch.column(2).to_pylist()
            shares, at = [np.empty(0)], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < chunk_chars):
                    size += len(texts[end])
                    end += 1
                shares.append(junk_share(texts[at:end], langs[at:end], model, vocabulary))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(shares))], ["id", "junk_share"])

    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), docs[lang].alias("lang")).where("id is not null")
    return rows.mapInArrow(kernel, f"id {docs.schema[doc_id].dataType.simpleString()}, junk_share double").withColumnRenamed("id", doc_id)


def junk_pages(docs: DataFrame, doc_id: str, text: str, lang: str, model: Model) -> DataFrame:
    """Ids of the pages of which more than half the words stand in junk stretches, each once."""
    return junk_shares(docs, doc_id, text, lang, model).where(F.col("junk_share") > model.share).select(doc_id).distinct()
