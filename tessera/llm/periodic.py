"""Periodic run detection: stretches of a text in which the same words come round and round.

A run is a maximal stretch of words with smallest period q (words q apart are identical)
and a length of at least ``least`` words and ``power`` periods. The texts of one Arrow slice
get one suffix array over word numbers (prefix doubling in numpy; a word's number contains
its text's, so intervals never mix texts, and every text ends in a symbol of its own).
Longest common prefixes come from the ranks that the doubling leaves. For each interval of
the array (depth d, found as nearest smaller neighbours of the prefix lengths, so no tree
nodes are built) the suffixes i of the smaller child ask the inverse array whether i + d or
i - d lies in the other child: then the words at i repeat once, with period d, and the next
word differs. Such a branching square is rotated to the left as far as it goes; rotations
with one right end and multiples of a known period are one run.

Lemma used to leave texts out early: a run of n words with period q has a suffix and another
q words further on that agree in n - q >= least * (power - 1) / power words, so a text in
which no stretch of that many words comes twice has no run.

Defined cases: null, empty and blank text have no words and no run, and collapse to empty;
repeated rows and clashing or null ids are texts of their own; an empty table gives an empty
result; other columns are not read. A very long text is a slice of its own: memory is
proportional to its number of words times the logarithm of its longest repeat. Ties: one
stretch has one smallest period, and runs of different periods may overlap; all are returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, slices, texts

LEAST = 24
POWER = 3
BLOCK = 1 << 21  # suffixes asked at once
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string"


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks by the first 1, 2, 4, ... symbols. The last
    symbol of ``x`` must be unique, and so must be every symbol that ends a text."""
    n = len(x)
    sa = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[sa[1:]] != x[sa[:-1]]))
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    levels, h = [], 1
    while True:
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        size = np.diff(np.append(first, n))
        at = np.flatnonzero(np.repeat(size > 1, size))  # places whose order is still open
        if not len(at):
            return sa, rank, levels
        s = sa[at]
        key = rank[s] * n + rank[s + h]
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[at] = s
        new[at] = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        rank[s] = np.repeat(first, np.diff(np.append(first, n)))[at]
        h *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[j]``: symbols that suffixes ``sa[j - 1]`` and ``sa[j]`` share; ``lcp[0] = 0``."""
    out = np.zeros(len(sa), np.int64)
    a, b, n = sa[:-1].copy(), sa[1:].copy(), np.zeros(len(sa) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a, b, n = a + step, b + step, n + step
    out[1:] = n
    return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every j with lcp[j] > 0: (j, left, right), the places [left, right) of the interval
    of depth lcp[j] that j cuts into the children [left, j) and [j, right)."""
    n = len(lcp)
    left, right = np.zeros(n, np.int64).tolist(), np.full(n, n).tolist()
    stack, depth = [], []
    for j, v in enumerate(lcp.tolist()):
        while depth and depth[-1] > v:
            right[stack.pop()] = j
            depth.pop()
        left[j] = stack[-1] if stack else 0
        stack.append(j)
        depth.append(v)
    j = np.flatnonzero(lcp > 0)
    return j, np.array(left)[j], np.array(right)[j]


def squares(x: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Branching squares ``(i, d)`` of which a long enough run can be rotated: the d words at i
    and at i + d agree and the words after them differ."""
    sa, isa, levels = suffix_array(x)
    lcp = common_prefixes(sa, levels)
    del levels
    j, left, right = intervals(lcp)
    d = lcp[j]
    small_left = j - left <= right - j
    start, size = np.where(small_left, left, j), np.where(small_left, j - left, right - j)
    other, end = np.where(small_left, j, left), np.where(small_left, right, j)
    found_i, found_d = [], []
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(j):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
        own = np.repeat(np.arange(at, to), size[at:to])
        i = sa[np.arange(len(own)) - np.repeat(bounds[at:to] - bounds[at], size[at:to]) + start[own]]
        for sign in (1, -1):
            k = i + sign * d[own]
            ok = (k >= 0) & (k < len(x))
            place = isa[np.where(ok, k, 0)]
            hit = np.flatnonzero(ok & (place >= other[own]) & (place < end[own]))
            first, dd = np.minimum(i[hit], k[hit]), d[own[hit]]
            # the run must reach this far to the left, so this word must agree too
            back = first - np.maximum(least - 2 * dd, (power - 2) * dd)
            good = np.flatnonzero(back >= 0)
            good = good[x[back[good]] == x[back[good] + dd[good]]]
            found_i.append(first[good])
            found_d.append(dd[good])
        at = to
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_d or [np.zeros(0, np.int64)])


def rotations(x: np.ndarray, i: int, d: int) -> int:
    """By how many words the square of period d at i can be moved to the left."""
    k, step = 0, 32
    while i > k:
        a = max(0, i - k - step)
        differ = np.flatnonzero(x[a:i - k] != x[a + d:i - k + d])
        if len(differ):
            return i - (a + int(differ[-1]) + 1)
        k, step = i - a, 2 * step
    return k


def merged(x: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of ``x`` in order of start and period."""
    i, d = squares(x, least, power)
    runs, known = [], {}
    for k in np.lexsort((d, i + 2 * d)).tolist():  # by right end, shortest period first
        a, q = int(i[k]), int(d[k])
        end = a + 2 * q
        if any(s <= a and q % p == 0 for s, p in known.get(end, ())):
            continue  # a multiple of the period of a run that ends here
        s = a - rotations(x, a, q)
        if end - s >= max(least, power * q):
            known.setdefault(end, []).append((s, q))
            runs.append((s, end - s, q))
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def _repeats(x: np.ndarray, size: int) -> np.ndarray:
    """Places whose ``size`` symbols also come elsewhere (a hash may add more)."""
    if len(x) <= size:
        return np.zeros(0, np.int64)
    h, have = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(29)
        while have < size:
            step = min(have, size - have)
            g = h[:len(h) - step] * np.uint64(0xBF58476D1CE4E5B9)
            h = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + h[step:]
            have += step
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    return np.concatenate((order[1:][same], order[:-1][same]))


def find_runs(docs: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in docs]
    long = [k for k, w in enumerate(ids) if len(w) >= least]

    def joined(which):
        """Symbols of these texts, a text's own number in each, one more symbol at its end."""
        v = len(number) + 1
        x = np.concatenate([np.append(ids[k], v - 1) + n * v for n, k in enumerate(which)])
        return x, np.cumsum([0] + [len(ids[k]) + 1 for k in which])

    if not long:
        return out
    x, start = joined(long)
    again = _repeats(x, -(-least * (power - 1) // power))
    keep = np.unique(np.searchsorted(start, again, "right") - 1)
    if not len(keep):
        return out
    which = [long[k] for k in keep.tolist()]
    x, start = joined(which)
    for s, n, q in merged(x, least, power):
        k = int(np.searchsorted(start, s, "right")) - 1
        out[which[k]].append((s - int(start[k]), n, q))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period (exact; ties: first start, then period)."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return b" ".join([w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per row ``(doc_id, n_words, runs, best, collapsed)``: all runs by start and period, that
    with the greatest exponent (null without a run), and the text with each run cut down to
    its first period."""
    if power < 2 or least < 2:
        raise ValueError("a run is at least two periods")
    kind = docs.schema[id_col].dataType
    named = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    of = lambda r: dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [t.split() for t in texts(b.column(1))]
            runs = find_runs(words, least, power)
            best = [greatest(r) for r in runs]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(w) for w in words], pa.int64()),
                pa.array([[of(r) for r in x] for x in runs], pa.list_(named)), pa.array([r and of(r) for r in best], named),
                pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")
