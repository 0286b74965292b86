"""Dynamic programming on sequences and anchors, vectorised by row. Lower scores are better."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

_CODE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[np.frombuffer(_letters, np.uint8)] = _i
INF = 1 << 28
#: Matrix cells that are held at a time when many pairs are aligned.
GROUP_CELLS = 4_000_000

#: Fixed values: (match, mismatch) of the named score matrices; N costs nothing but in the first, where it is 0 too.
MATRICES = {"long_read": (-5, 6), "log_prob": (0, 15), "edit": (0, 1), "qv": (-1, 1)}
#: Which ends are free: query prefix, target prefix, query suffix, target suffix.
MODES = {
    "global": (False, False, False, False),
    "query_fit": (False, True, False, True),
    "target_fit": (True, False, True, False),
    "overlap": (False, True, True, False),
    "prefix": (False, False, True, True),
    "suffix": (True, True, False, False),
    "ends_free": (True, True, True, True),
    "local": (True, True, True, True),
}


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


@dataclass(frozen=True)
class Scores:
    """Scores of an alignment. A gap of n letters costs ``open + n * ext``; with ``long_open`` the lesser of that and
    ``long_open + n * long_ext``. ``homopolymer_insertion`` replaces the insertion extension where a letter repeats the one before."""

    matrix: tuple[int, ...]
    insertion: int = 5
    deletion: int = 5
    open: int = 0
    long_open: int | None = None
    long_ext: int = 0
    homopolymer_insertion: int | None = None

    @staticmethod
    def named(name: str, **other: int) -> "Scores":
        match, mismatch = MATRICES[name]
        return Scores(tuple(match if i == j and i < 4 else 0 if 4 in (i, j) else mismatch for i in range(5) for j in range(5)), **other)

    @staticmethod
    def parse(text: str, **other: int) -> "Scores":
        """25 whole numbers in the order A C G T N."""
        values = tuple(int(x) for x in text.split())
        if len(values) != 25:
            raise ValueError("a score matrix has 25 numbers")
        return Scores(values, **other)

    @property
    def table(self) -> np.ndarray:
        return np.array(self.matrix, np.int64).reshape(5, 5)


@dataclass
class Alignment:
    score: int
    q_start: int
    q_end: int
    t_start: int
    t_end: int
    ops: list[tuple[int, str]] = field(default_factory=list)

    def cigar(self) -> str:
        return "".join(f"{n}{o}" for n, o in self.ops)

    def blocks(self) -> list[tuple[int, int, int]]:
        """(q, t, length) of the gapless stretches, in sequence positions."""
        found: list[tuple[int, int, int]] = []
        q, t = self.q_start, self.t_start
        for n, o in self.ops:
            if o in "=X":
                if found and found[-1][0] + found[-1][2] == q and found[-1][1] + found[-1][2] == t:
                    found[-1] = (found[-1][0], found[-1][1], found[-1][2] + n)
                else:
                    found.append((q, t, n))
            q += n * (o in "=XI")
            t += n * (o in "=XD")
        return found

    def stats(self) -> dict[str, int | float]:
        n = {o: sum(x for x, p in self.ops if p == o) for o in "=XID"}
        total = sum(n.values())
        return {"n_match": n["="], "n_mismatch": n["X"], "n_ins": n["I"], "n_del": n["D"], "pct_similarity": 100.0 * n["="] / total if total else 0.0}

    def strings(self, q: str, t: str) -> tuple[str, str, str]:
        """The two sequences with gaps and a line of ticks between them."""
        a, b, ticks, i, j = [], [], [], self.q_start, self.t_start
        for n, o in self.ops:
            a.append(q[i : i + n] if o in "=XI" else "-" * n)
            b.append(t[j : j + n] if o in "=XD" else "-" * n)
            ticks.append(("|" if o == "=" else " ") * n)
            i += n * (o in "=XI")
            j += n * (o in "=XD")
        return "".join(a), "".join(ticks), "".join(b)

    def drift(self) -> int:
        """Largest distance from the diagonal it began on."""
        most = at = 0
        for n, o in self.ops:
            at += n * (o == "I") - n * (o == "D")
            most = max(most, abs(at))
        return most


def _pack(steps: list[str], q: np.ndarray, t: np.ndarray, i: int, j: int) -> list[tuple[int, str]]:
    """Run lengths of the steps from (i, j) on, with aligned letters told apart."""
    ops: list[tuple[int, str]] = []
    for s in steps:
        if s == "M":
            s = "=" if q[i] == t[j] and q[i] < 4 else "X"
            i, j = i + 1, j + 1
        elif s == "I":
            i += 1
        else:
            j += 1
        if ops and ops[-1][1] == s:
            ops[-1] = (ops[-1][0] + 1, s)
        else:
            ops.append((1, s))
    return ops


def align(query: str, target: str, scores: Scores, mode: str = "global", band: int | None = None, guide: list[tuple[int, int, int]] | None = None, trace: bool = True) -> Alignment | None:
    """Best alignment of two sequences; see ``align_many``."""
    return align_many([query], [target], scores, mode, band, [guide], trace)[0]


def align_many(
    queries: list[str], targets: list[str], scores: Scores, mode: str = "global", band: int | None = None, guides: list | None = None, trace: bool = True, qualities: list | None = None
) -> list[Alignment | None]:
    """Best alignment of each query with its target, rows of all matrices at a time.

    ``band`` keeps to so many columns on either side of the diagonal or, with a guide (blocks of another alignment), of that
    one. None if the band lets nothing through. Without ``trace`` only the score and the end are found. Ties: aligned letters go before
    insertions, those before deletions; of equal ends the first. Pairs are taken in groups of like size and bounded memory; with a band
    a pair holds 2 * band + 1 columns. ``qualities``: per query None or a quality per letter, by which the
    score of that letter with any other is multiplied (a null counts as 0, a letter beyond the list as 1).
    """
    found: list[Alignment | None] = [None] * len(queries)
    guides = guides or [None] * len(queries)
    order = sorted(range(len(queries)), key=lambda k: (len(queries[k]), len(targets[k])))
    at = 0
    while at < len(order):
        end, m = at, 0
        while end < len(order):
            m_new = max(m, len(targets[order[end]]) + 1)
            held = m_new if band is None else min(m_new, 2 * band + 1)
            if end > at and held * (len(queries[order[end]]) + 1) * (end - at + 1) > GROUP_CELLS:
                break
            m, end = m_new, end + 1
        part = order[at:end]
        for k, a in zip(part, _group([queries[k] for k in part], [targets[k] for k in part], scores, mode, band, [guides[k] for k in part], trace, None if qualities is None else [qualities[k] for k in part])):
            found[k] = a
        at = end
    return found


def _group(queries, targets, scores, mode, band, guides, trace, qualities=None) -> list[Alignment | None]:
    qs, ts = [codes(x) for x in queries], [codes(x) for x in targets]
    count = len(qs)
    ns, ms = np.array([len(x) for x in qs]), np.array([len(x) for x in ts])
    n, m = int(ns.max()), int(ms.max())
    q, t = np.full((count, n), 4, np.int64), np.full((count, m), 4, np.int64)
    for k in range(count):
        q[k, : ns[k]], t[k, : ms[k]] = qs[k], ts[k]
    free_qp, free_tp, free_qs, free_ts = MODES[mode]
    local, sub = mode == "local", scores.table
    open_, d_ext, two = scores.open, scores.deletion, scores.long_open is not None
    each = np.arange(count)
    weights = None
    if qualities is not None:
        weights = np.ones((count, n), np.int64)
        for k, quality in enumerate(qualities):
            if quality is not None:
                known = [0 if x is None else int(x) for x in quality[: ns[k]]]
                weights[k, : len(known)] = known
    # Only a window of columns is held of each row: all of them, or those of the band, which moves right from row to row.
    width = m + 1 if band is None else min(m + 1, 2 * band + 1)
    middle = np.zeros((count, n + 1), np.int64)
    if band is not None:
        for k in range(count):
            middle[k, : ns[k] + 1] = _centres(int(ns[k]), int(ms[k]), guides[k])
            middle[k, ns[k] + 1 :] = middle[k, ns[k]]
    low = np.zeros((count, n + 1), np.int64) if band is None else np.clip(middle - band, 0, m + 1 - width)
    window = np.arange(width, dtype=np.int64)
    t_padded = np.concatenate([t, np.full((count, 1), 4, np.int64)], axis=1)

    def outside(i: int, cols: np.ndarray) -> np.ndarray:
        gone = cols > ms[:, None]
        if band is not None:
            c = middle[:, i][:, None]
            gone |= (cols < c - band) | (cols > c + band)
        return gone

    def moved(row: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The row above, seen from this row's window moved by ``shift``; infinite beyond it."""
        if width == m + 1:
            if not np.any(shift):
                return row
            back = -int(shift[0])
            return np.concatenate([np.full((count, back), INF, np.int64), row[:, : width - back]], axis=1)
        at = window[None, :] + shift[:, None]
        return np.where((at >= 0) & (at < width), np.take_along_axis(row, np.clip(at, 0, width - 1), axis=1), INF)

    def in_row(row: np.ndarray, j: np.ndarray, i: int) -> np.ndarray:
        at = j - low[:, i]
        return np.where((at >= 0) & (at < width), row[each, np.clip(at, 0, width - 1)], INF)

    cols = low[:, 0][:, None] + window
    gap_d = open_ + d_ext * cols
    if two:
        gap_d = np.minimum(gap_d, scores.long_open + scores.long_ext * cols)
    gap_d = np.where(cols == 0, 0, gap_d)
    h = np.zeros((count, width), np.int64) if free_tp else gap_d
    h[outside(0, cols)] = INF
    f, g = np.full((count, width), INF, np.int64), np.full((count, width), INF, np.int64)
    source = np.zeros((n + 1, count, width), np.uint8) if trace else None
    parts = np.full((n + 1, count, width), INF, np.int32) if trace else None
    best, end_i, end_j = np.full(count, INF, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    if local:
        best[:] = 0
    elif free_qs:
        best, end_j = np.minimum(in_row(h, ms, 0), INF), ms.copy()

    def close(i: int) -> None:
        """Ends in the last row of the pairs whose query is i long."""
        if local:
            return
        if free_ts:
            at = h.argmin(axis=1)
            j, v = at + low[:, i], h[each, at]
            take = (ns == i) & (v < best)
        else:
            j, v = ms, in_row(h, ms, i)
            take = (ns == i) & ((v < best) | (not free_qs))
        best[take], end_i[take], end_j[take] = v[take], i, j[take]

    close(0)
    i_cost = np.zeros(count, np.int64)
    for i in range(1, n + 1):
        ext = np.full(count, scores.insertion, np.int64)
        if scores.homopolymer_insertion is not None and i > 1:
            ext[q[:, i - 1] == q[:, i - 2]] = scores.homopolymer_insertion
        i_cost += ext
        e = ext[:, None]
        shift = low[:, i] - low[:, i - 1]
        cols = low[:, i][:, None] + window
        above, f = moved(h, shift), moved(f, shift)
        f = np.minimum(f, above + open_) + e
        ins = f
        if two:
            g = np.minimum(moved(g, shift), above + scores.long_open) + scores.long_ext
            ins = np.minimum(f, g)
        pair = sub[q[:, i - 1][:, None], np.take_along_axis(t_padded, np.clip(cols - 1, 0, m), axis=1)]
        if weights is not None:
            pair = pair * weights[:, i - 1][:, None]
        diag = np.where(cols == 0, INF, moved(h, shift - 1) + pair)
        part = np.minimum(diag, ins)
        first = 0 if free_qp else np.minimum(open_ + i_cost, scores.long_open + scores.long_ext * i) if two else open_ + i_cost
        part = np.where(cols == 0, np.broadcast_to(np.asarray(first), (count,))[:, None], part)
        out = outside(i, cols)
        part[out] = INF
        dele = np.full((count, width), INF, np.int64)
        dele[:, 1:] = open_ + d_ext * cols[:, 1:] + np.minimum.accumulate(part - d_ext * cols, axis=1)[:, :-1]
        if two:
            dele[:, 1:] = np.minimum(dele[:, 1:], scores.long_open + scores.long_ext * cols[:, 1:] + np.minimum.accumulate(part - scores.long_ext * cols, axis=1)[:, :-1])
        dele[out] = INF
        h = np.minimum(np.minimum(part, dele), INF)
        if trace:
            row = np.where(diag <= h, 0, np.where(part <= h, 1, 2)).astype(np.uint8)
            row[cols == 0] = 3 if free_qp else 1
            if local:
                row[h >= 0] = 3
            source[i], parts[i] = row, np.minimum(part, INF)
        if local:
            np.minimum(h, 0, out=h)
            h[out] = INF
            at = h.argmin(axis=1)
            v = h[each, at]
            take = (i <= ns) & (v < best)
            best[take], end_i[take], end_j[take] = v[take], i, (at + low[:, i])[take]
        elif free_qs:
            v = in_row(h, ms, i)
            take = (i <= ns) & (v < best)
            best[take], end_i[take], end_j[take] = v[take], i, ms[take]
        close(i)
    done: list[Alignment | None] = []
    for k in range(count):
        if best[k] >= INF // 2:
            done.append(None)
        elif not trace:
            done.append(Alignment(int(best[k]), -1, int(end_i[k]), -1, int(end_j[k])))
        else:
            weight = None if weights is None else weights[k]
            done.append(_walk(qs[k], ts[k], scores, _Rows(source[:, k], low[k]), _Rows(parts[:, k], low[k]), int(best[k]), (int(end_i[k]), int(end_j[k])), free_qp, free_tp, local, weight))
    return done


@dataclass
class _Rows:
    """Rows of a matrix of which a window is held."""

    cells: np.ndarray
    low: np.ndarray

    def at(self, i: int, j: int) -> int:
        return int(self.cells[i, j - self.low[i]])

    def upto(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The held columns up to j and their values."""
        cols = np.arange(self.low[i], j + 1)
        return cols, self.cells[i, : len(cols)].astype(np.int64)[: self.cells.shape[1]]


def _centres(n: int, m: int, guide: list[tuple[int, int, int]] | None) -> np.ndarray:
    """The column each row's band lies around: the diagonal of equal shares, or the guide's path."""
    if not guide:
        return np.arange(n + 1) + np.round(np.linspace(0, m - n, n + 1)).astype(np.int64)
    xs, ys = [0], [max(0, guide[0][1] - guide[0][0])]
    for a, b, k in guide:
        xs += [a, a + k]
        ys += [b, b + k]
    return np.clip(np.round(np.interp(np.arange(n + 1), xs, ys)), 0, m).astype(np.int64)


def _walk(q, t, scores, source, parts, best, end, free_qp, free_tp, local, weight=None) -> Alignment:
    i, j = end
    steps: list[str] = []
    # Plain numbers are read faster than array elements, one at a time.
    q, t, sub, low = q.tolist(), t.tolist(), scores.table.tolist(), source.low.tolist()
    gap = lambda k, ext: min(scores.open + ext * k, scores.long_open + scores.long_ext * k) if scores.long_open is not None else scores.open + ext * k
    value = best
    while i > 0 or j > 0:
        if local and value >= 0:
            break
        if i == 0:
            if not free_tp:
                steps += ["D"] * j
                j = 0
            break
        s = source.cells[i, j - low[i]]
        if j == 0:
            if not free_qp:
                steps += ["I"] * i
                i = 0
            break
        if s == 0:
            cost = sub[q[i - 1]][t[j - 1]]
            value -= cost if weight is None else cost * int(weight[i - 1])
            steps.append("M")
            i, j = i - 1, j - 1
        elif s == 1:
            # An insertion: the length whose cost accounts for the value found above.
            k, cost_ext, found = 0, 0, False
            while k < i and not found:
                k += 1
                at = i - k + 1
                homo = scores.homopolymer_insertion is not None and at > 1 and q[at - 1] == q[at - 2]
                cost_ext += scores.homopolymer_insertion if homo else scores.insertion
                cost = min(scores.open + cost_ext, scores.long_open + scores.long_ext * k) if scores.long_open is not None else scores.open + cost_ext
                above = _value(parts, scores, i - k, j, free_tp, free_qp, local, gap)
                found = above + cost == value
            steps += ["I"] * k
            i, value = i - k, value - cost
        elif s == 2:
            k = 0
            while k < j - parts.low[i]:
                k += 1
                if parts.at(i, j - k) + gap(k, scores.deletion) == value:
                    break
            steps += ["D"] * k
            value -= gap(k, scores.deletion)
            j -= k
        else:
            break
    steps.reverse()
    return Alignment(best, i, end[0], j, end[1], _pack(steps, q, t, i, j))


def _value(parts, scores, i, j, free_tp, free_qp, local, gap) -> int:
    """The score at a cell, from the stored part without deletions."""
    if i == 0:
        return 0 if j == 0 or free_tp else gap(j, scores.deletion)
    cols, row = parts.upto(i, j)
    if not len(row) or cols[0] > j or j - parts.low[i] >= parts.cells.shape[1]:
        return INF
    k = j - cols
    cost = np.minimum(scores.open + scores.deletion * k, scores.long_open + scores.long_ext * k) if scores.long_open is not None else scores.open + scores.deletion * k
    best = int((row + np.where(k > 0, cost, 0)).min())
    return min(best, 0) if local else best


def extend(query: str, target: str, scores: Scores, drop: int = 30, max_rises: int = 10, band: int = 15) -> Alignment:
    """Alignment from the start of both sequences as far as it pays; see ``extend_many``."""
    return extend_many([query], [target], scores, drop, max_rises, band)[0]


def extend_many(queries: list[str], targets: list[str], scores: Scores, drop: int = 30, max_rises: int = 10, band: int = 15) -> list[Alignment]:
    """Alignment of each query with its target from the start of both as far as it pays: it ends after ``max_rises`` rows in a row that are
    more than ``drop`` above the best. Rows of many pairs are taken at a time, in groups of like size and bounded memory."""
    ends = [(0, 0)] * len(queries)
    order = sorted(range(len(queries)), key=lambda k: (len(queries[k]), len(targets[k])))
    at = 0
    while at < len(order):
        end, held = at, 0
        while end < len(order):
            held = 2 * len(queries[order[end]]) + 16 * (2 * band + 1)
            if end > at and held * (end - at + 1) > GROUP_CELLS:
                break
            end += 1
        part = order[at:end]
        for k, found in zip(part, _extended([queries[k] for k in part], [targets[k] for k in part], scores, drop, max_rises, band)):
            ends[k] = found
        at = end
    some = [k for k, (i, _) in enumerate(ends) if i]
    solved = align_many([queries[k][: ends[k][0]] for k in some], [targets[k][: ends[k][1]] for k in some], scores, "global", band=band + 1)
    done = dict(zip(some, solved))
    return [done.get(k) or Alignment(0, 0, 0, 0, 0) for k in range(len(queries))]


def _extended(queries: list[str], targets: list[str], scores: Scores, drop: int, max_rises: int, band: int) -> list[tuple[int, int]]:
    """Where each pair's extension ends. Held are the 2 * band + 1 columns around the diagonal; a pair that is done is left out before long."""
    width = 2 * band + 1
    reach = max(map(len, queries)) + band
    ns, ms = np.array([len(x) for x in queries]), np.array([len(x) for x in targets])
    q, t = _by_place(queries), _by_place([x[:reach] for x in targets], band, reach)
    kind = _kind(scores, 2 * reach)
    sub, insertion, deletion = scores.table.astype(kind).ravel(), kind(scores.insertion), kind(scores.deletion)
    window = np.arange(width)[:, None]
    h = np.where((window >= band) & (window - band <= ms), deletion * (window - band), INF).astype(kind)
    who = np.arange(len(queries))
    end_i, end_j = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    best, rises = np.zeros(len(queries), kind), np.zeros(len(queries), np.int64)
    for i in range(1, len(q) + 1):
        live = (rises <= max_rises) & (i <= ns) & (i - band <= ms)
        n_live = np.count_nonzero(live)
        if not n_live:
            break
        if 2 * n_live < len(live):
            q, t, h = q[:, live], t[:, live], h[:, live]
            ns, ms, who, best, rises = ns[live], ms[live], who[live], best[live], rises[live]
            live = np.ones(n_live, bool)
        # Column w is target place i - band + w: the letters' pair comes from the same column of the row above, an insertion from the next.
        row = h + sub.take(5 * q[i - 1] + t[i - 1 : i - 1 + width], mode="clip")
        np.minimum(row[:-1], h[1:] + insertion, out=row[:-1])
        first = max(0, band - i)
        row[:first] = INF
        for w in range(first + 1, width):
            np.minimum(row[w], row[w - 1] + deletion, out=row[w])
        if i + band > ms.min():
            row[window - band + i > ms] = INF
        h = row
        at = h.argmin(axis=0)
        value = h[at, np.arange(len(at))]
        better = live & (value < best)
        worse = live & ~better & (value > best + drop)
        best[better] = value[better]
        end_i[who[better]], end_j[who[better]] = i, at[better] + i - band
        rises[better] = 0
        rises[worse] += 1
    return list(zip(end_i.tolist(), end_j.tolist()))


def extend_back(query: str, target: str, scores: Scores, drop: int = 30, max_rises: int = 10, band: int = 15) -> Alignment:
    """``extend`` from the ends of both sequences towards their starts."""
    return extend_back_many([query], [target], scores, drop, max_rises, band)[0]


def extend_back_many(queries: list[str], targets: list[str], scores: Scores, drop: int = 30, max_rises: int = 10, band: int = 15) -> list[Alignment]:
    """``extend_many`` from the ends of both sequences towards their starts."""
    found = extend_many([x[::-1] for x in queries], [x[::-1] for x in targets], scores, drop, max_rises, band)
    return [Alignment(a.score, len(q) - a.q_end, len(q) - a.q_start, len(t) - a.t_end, len(t) - a.t_start, a.ops[::-1]) for a, q, t in zip(found, queries, targets)]


def one_gap(query: str, target: str, scores: Scores) -> Alignment:
    """The best alignment with one gap at most, which is as long as the two differ."""
    q, t = codes(query), codes(target)
    short, gap = min(len(q), len(t)), abs(len(q) - len(t))
    sub = scores.table
    head = np.append(0, np.cumsum(sub[q[:short], t[:short]]))
    tail = np.append(np.cumsum(sub[q[len(q) - short :], t[len(t) - short :]][::-1])[::-1], 0)
    at = int((head + tail).argmin()) if gap else short
    kind = "I" if len(q) > len(t) else "D"
    cost = scores.open + gap * (scores.insertion if kind == "I" else scores.deletion) if gap else 0
    steps = ["M"] * at + [kind] * gap + ["M"] * (short - at)
    return Alignment(int(head[at] + tail[at]) + cost, 0, len(q), 0, len(t), _pack(steps, q, t, 0, 0))


def three_way(a: str, b: str, c: str, scores: Scores) -> int:
    """Score of the best alignment of three sequences; see ``three_way_many``."""
    return three_way_many([(a, b, c)], scores)[0]


def three_way_many(triples: list[tuple[str, str, str]], scores: Scores) -> list[int]:
    """Score of the best alignment of each three sequences by the sum of pairs; a letter against a gap costs ``deletion``, two gaps nothing.

    The cells of all triples of a group are filled at a time; two layers of each cube are held. Groups are of like size and bounded memory.
    The time grows with the product of the three lengths, so short texts only.
    """
    found = [0] * len(triples)
    order = sorted(range(len(triples)), key=lambda k: tuple(map(len, triples[k])))
    at = 0
    while at < len(order):
        end, m, o = at, 0, 0
        while end < len(order):
            _, b, c = triples[order[end]]
            m_new, o_new = max(m, len(b)), max(o, len(c))
            if end > at and 4 * (m_new + 1) * (o_new + 1) * (end - at + 1) > GROUP_CELLS:
                break
            m, o, end = m_new, o_new, end + 1
        for k, score in zip(order[at:end], _three_group([triples[k] for k in order[at:end]], scores)):
            found[k] = int(score)
        at = end
    return found


def _by_place(texts: list[str], front: int = 0, length: int | None = None) -> np.ndarray:
    """Codes with a row for each place and a column for each text; N before the first letter and after the last."""
    length = max(map(len, texts)) if length is None else length
    out = np.full((len(texts), front + length), 4, np.uint8)
    for k, text in enumerate(texts):
        out[k, front : front + len(text)] = codes(text)
    return np.ascontiguousarray(out.T)


def _kind(scores: Scores, steps: int) -> type:
    """The narrowest type for which no sum of so many scores is large beside INF."""
    largest = max(map(abs, (*scores.matrix, scores.insertion, scores.deletion)))
    return np.int32 if largest * (steps + 1) < INF else np.int64


def _three_group(triples: list[tuple[str, str, str]], scores: Scores) -> np.ndarray:
    x, y, z = (_by_place(list(texts)) for texts in zip(*triples))
    ns, ms, os = (np.array(list(map(len, texts))) for texts in zip(*triples))
    n, m, o, count = len(x), len(y), len(z), len(triples)
    kind = _kind(scores, 3 * (n + m + o))
    sub, gap = scores.table.astype(kind).ravel(), kind(2 * scores.deletion)  # a letter against two gaps, or two letters against one
    pairs = lambda p, q: sub.take(5 * p + q, mode="clip")
    yz = pairs(y[:, None], z[None]) if m and o else np.zeros((m, o, count), kind)
    each, found = np.arange(count), np.zeros(count, np.int64)
    above = layer = np.zeros((0, 0, 0), kind)
    for i in range(n + 1):
        above, layer = layer, np.full((m + 1, o + 1, count), INF, kind)
        if i:
            xy, xz = pairs(x[i - 1][None], y), pairs(x[i - 1][None], z)
        else:
            layer[0, 0] = 0
        for j in range(m + 1):
            row = layer[j]  # the third's places; its own gaps come last
            if i:
                np.minimum(row, above[j] + gap, out=row)
                np.minimum(row[1:], above[j, :-1] + (xz + gap), out=row[1:])
            if j:
                np.minimum(row, layer[j - 1] + gap, out=row)
                np.minimum(row[1:], layer[j - 1, :-1] + (yz[j - 1] + gap), out=row[1:])
            if i and j:
                np.minimum(row, above[j - 1] + (xy[j - 1] + gap), out=row)
                np.minimum(row[1:], above[j - 1, :-1] + (xy[j - 1] + xz + yz[j - 1]), out=row[1:])
            for k in range(1, o + 1):
                np.minimum(row[k], row[k - 1] + gap, out=row[k])
        done = ns == i
        if done.any():
            found[done] = layer[ms[done], os[done], each[done]]
    return found


def forward_probability(query: str, quality: np.ndarray, target: str, p_ins: float = 0.05, p_del: float = 0.05) -> float:
    """log10 of the summed probability of all global alignments; a letter's error is 10^(-quality/10), spread over the other three."""
    q, t = codes(query), codes(target)
    err = np.power(10.0, -np.asarray(quality, float) / 10)
    keep = 1 - p_ins - p_del
    row = np.array([p_del**j for j in range(len(t) + 1)])
    scale = 0.0
    for i in range(len(q)):
        hit = np.where(t == q[i], 1 - err[i], err[i] / 3)
        nxt = np.empty(len(t) + 1)
        nxt[0] = row[0] * p_ins / 4
        into = row[1:] * p_ins / 4 + row[:-1] * keep * hit
        for j in range(len(t)):  # a deletion follows on the same row
            nxt[j + 1] = into[j] + nxt[j] * p_del
        top = nxt.max()
        if top > 0:
            nxt /= top
            scale += math.log10(top)
        row = nxt
    return scale + (math.log10(row[-1]) if row[-1] > 0 else -math.inf)


# chaining


def chain(q: np.ndarray, t: np.ndarray, length: np.ndarray, indel: float = 0.0, max_gap: int | None = None, max_ratio: float | None = None) -> list[int]:
    """Indices of the colinear anchors, none overlapping another on query or target, of the largest sum of lengths.

    With ``indel`` each unit of shift between neighbours costs so much; ``max_gap`` and ``max_ratio`` bound the gaps between
    neighbours. Without these three the sweep is O(n log n), else O(n^2). Ties go to the anchors that come first.
    """
    n = len(q)
    if not n:
        return []
    if indel == 0 and max_gap is None and max_ratio is None:
        return _sweep(q, t, length)
    order = np.lexsort((t, q))
    q, t, length = q[order], t[order], length[order].astype(float)
    total, back = length.copy(), np.full(n, -1)
    for i in range(1, n):
        gq, gt = q[i] - (q[:i] + length[:i]), t[i] - (t[:i] + length[:i])
        ok = (gq >= 0) & (gt >= 0)
        if max_gap is not None:
            ok &= (gq <= max_gap) & (gt <= max_gap)
        if max_ratio is not None:
            ok &= (np.maximum(gq, gt) + 1) <= max_ratio * (np.minimum(gq, gt) + 1)
        if ok.any():
            with_it = np.where(ok, total[:i] - indel * np.abs(gq - gt), -np.inf)
            j = int(with_it.argmax())
            if with_it[j] > 0:
                total[i], back[i] = with_it[j] + length[i], j
    at, found = int(total.argmax()), []
    while at >= 0:
        found.append(int(order[at]))
        at = int(back[at])
    return found[::-1]


def _sweep(q: np.ndarray, t: np.ndarray, length: np.ndarray) -> list[int]:
    """Starts and ends in order of the query; a Fenwick tree over target ends keeps the best chain that ends so far."""
    n = len(q)
    ends = np.unique(t + length)
    best, who = [0.0] * (len(ends) + 1), [-1] * (len(ends) + 1)
    order = np.lexsort((t, q))
    total, back = np.zeros(n), np.full(n, -1)
    closing = np.argsort(q + length, kind="stable")
    c = 0
    for i in order:
        while c < n and q[closing[c]] + length[closing[c]] <= q[i]:
            e = int(closing[c])
            p = int(np.searchsorted(ends, t[e] + length[e])) + 1
            while p < len(best):
                if total[e] > best[p]:
                    best[p], who[p] = total[e], e
                p += p & -p
            c += 1
        p = int(np.searchsorted(ends, t[i], side="right"))
        top, pick = 0.0, -1
        while p > 0:
            if best[p] > top:
                top, pick = best[p], who[p]
            p -= p & -p
        total[i], back[i] = top + length[i], pick
    at, found = int(total.argmax()), []
    while at >= 0:
        found.append(at)
        at = int(back[at])
    return found[::-1]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def coarse_chain(q: np.ndarray, t: np.ndarray, cell: int) -> np.ndarray:
    """Which points lie in cells of the best path through a grid of ``cell`` wide cells, weighted by their points."""
    if not len(q):
        return np.zeros(0, bool)
    x, y = (q - q.min()) // cell, (t - t.min()) // cell
    grid = np.zeros((int(x.max()) + 1, int(y.max()) + 1), np.int64)
    np.add.at(grid, (x, y), 1)
    total = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
    for i in range(grid.shape[0]):
        for j in range(grid.shape[1]):
            total[i + 1, j + 1] = grid[i, j] + max(total[i, j], total[i, j + 1], total[i + 1, j])
    keep = np.zeros_like(grid, bool)
    i, j = grid.shape
    while i > 0 and j > 0:
        keep[i - 1, j - 1] = True
        before = total[i, j] - grid[i - 1, j - 1]
        i, j = (i - 1, j - 1) if total[i - 1, j - 1] == before else (i - 1, j) if total[i - 1, j] == before else (i, j - 1)
    return keep[x, y]


def sparse_align(query: str, target: str, scores: Scores, k: int = 11, least_k: int = 5, recurse_over: int = 1000, ends: int = 50) -> Alignment:
    """Global alignment through a chain of equal k-letter words; what lies between is aligned with shorter words or, where it is small or at the ends, in full."""

    def between(a: str, b: str, word: int, edge: bool) -> list[tuple[int, str]]:
        if not a or not b:
            return [(len(a), "I")] if a else [(len(b), "D")] if b else []
        if len(a) * len(b) <= recurse_over or word < least_k or edge and max(len(a), len(b)) <= ends:
            return align(a, b, scores).ops
        return solve(a, b, word)

    def solve(a: str, b: str, word: int) -> list[tuple[int, str]]:
        where: dict[str, list[int]] = {}
        for j in range(len(b) - word + 1):
            where.setdefault(b[j : j + word], []).append(j)
        points = [(i, j) for i in range(len(a) - word + 1) for j in where.get(a[i : i + word], ()) if "N" not in a[i : i + word]]
        if not points:
            return solve(a, b, word - 4) if word - 4 >= least_k else align(a, b, scores).ops
        # Words that follow each other on a diagonal are one fragment.
        runs: dict[int, list[list[int]]] = {}
        for i, j in points:
            of = runs.setdefault(j - i, [])
            if of and of[-1][0] + of[-1][1] - word + 1 == i:
                of[-1][1] += 1
            else:
                of.append([i, word])
        frag = [(i, i + d, n) for d, of in runs.items() for i, n in of]
        fq, ft, fl = (np.array(x) for x in zip(*frag))
        ops: list[tuple[int, str]] = []
        i = j = 0
        for f in chain(fq, ft, fl):
            ops += between(a[i : fq[f]], b[j : ft[f]], word - 4, i == 0)
            ops.append((int(fl[f]), "="))
            i, j = int(fq[f] + fl[f]), int(ft[f] + fl[f])
        return ops + between(a[i:], b[j:], word - 4, True)

    merged: list[tuple[int, str]] = []
    for n, o in solve(query.upper(), target.upper(), k):
        if merged and merged[-1][1] == o:
            merged[-1] = (merged[-1][0] + n, o)
        elif n:
            merged.append((n, o))
    found = Alignment(0, 0, len(query), 0, len(target), merged)
    found.score = rescore(query, target, found, scores)
    return found


def rescore(query: str, target: str, found: Alignment, scores: Scores) -> int:
    """The score of an alignment under other scores."""
    q, t, sub, total = codes(query), codes(target), scores.table, 0
    i, j = found.q_start, found.t_start
    for n, o in found.ops:
        if o in "=X":
            total += int(sub[q[i : i + n], t[j : j + n]].sum())
        else:
            ext = scores.insertion if o == "I" else scores.deletion
            cost = scores.open + ext * n
            total += min(cost, scores.long_open + scores.long_ext * n) if scores.long_open is not None else cost
        i += n * (o in "=XI")
        j += n * (o in "=XD")
    return total


def drop_adjacent_indels(ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Insertions and deletions that meet: as many letters of both as match in number become mismatches."""
    out: list[tuple[int, str]] = []
    for n, o in ops:
        if out and {o, out[-1][1]} == {"I", "D"}:
            m = min(n, out[-1][0])
            rest, kind = (n - m, o) if n > m else (out[-1][0] - m, out[-1][1])
            out.pop()
            out.append((m, "X"))
            if rest:
                out.append((rest, kind))
        elif out and out[-1][1] == o:
            out[-1] = (out[-1][0] + n, o)
        else:
            out.append((n, o))
    return out
