"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some run of its words is within
``floor((1 - similarity) n)`` word edits of the item's n words (words: runs of letters and
digits, lower-cased; in scripts that put no space between words, such as Chinese, Japanese,
Thai, Lao, Khmer and Burmese, every letter is a word).

1. Windows that cannot match are left out by the q-gram lemma, which loses nothing: n words
   with at most d edits keep n - q + 1 - q d of their q-grams, so a window needs that many
   q-grams of the items.
2. CGK: from a window's first word, a random walk reads a word at each of J steps and moves
   on by the random bit of (word, step). Equal random bits for window and item keep the two
   walks together, and after an edit they meet again, so edit distance becomes Hamming
   distance of the words read. ``WALKS`` walks each give ``SAMPLES`` keys, the words read at
   ``BITS`` sampled steps. Steps are drawn below twice the shortest item of a length class,
   so the walk covers item-sized windows. Keys equal to an item's key are candidates.
   Repetitions are chosen for a recall over 0.99 at the similarity bound (see the tests).
3. Candidates are verified exactly: the edit distance of the whole item to its best run of
   words around the window.

Items are the stated query set: they are taken in blocks of at most ``BLOCK_CHARS`` characters,
each block is broadcast, and every block meets all documents in one pass. Documents are read where
they lie; nothing is shuffled but the matches of documents found by several blocks.

Defined cases: null or empty documents and items without words match nothing; items with
equal texts are all reported; repeated documents are reported again; a null id is reported
as null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices

SIMILARITY = 0.8
WALKS = 8
SAMPLES = 6
BITS = 2
SEED = 4
BLOCK_CHARS = 16 << 20
_WORD = re.compile(r"\w+")
#: Thai, Lao, Tibetan; Burmese; Khmer; ideographic signs, kana; Han; half-width kana; Han beyond the basic plane
_UNSPACED = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
             "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_WORD_OR_LETTER = re.compile(rf"[^\W{_UNSPACED}]+|(?!\W)[{_UNSPACED}]")


def words(text: str | None) -> list[str]:
    return (_WORD if text.isascii() else _WORD_OR_LETTER).findall(text.lower()) if text else []


def allowed(n: int, similarity: float) -> int:
    """Edits allowed for n words."""
    return int(np.floor((1 - similarity) * n + 1e-9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class LengthClass:
    """Items of like length: their q-grams and their CGK keys."""
    q: int
    least: int                     # q-grams a matching window has at least
    width: int                     # words of the longest matching window
    shortest: int
    grams: np.ndarray              # sorted
    keys: np.ndarray               # sorted
    owners: np.ndarray             # item of each key


@dataclass
class Items:
    ids: list
    texts: list[np.ndarray]        # word numbers, from 1
    vocab: dict[str, int]
    similarity: float
    walks: int
    samples: int
    bits: int
    classes: list[LengthClass] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple], similarity: float = SIMILARITY, walks: int = WALKS, samples: int = SAMPLES,
           bits: int = BITS) -> Items:
        rows = [(i, words(t)) for i, t in items]
        rows = [(i, w) for i, w in rows if w]
        vocab: dict[str, int] = {}
        texts = [np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.int64) for _, w in rows]
        self = cls([i for i, _ in rows], texts, vocab, similarity, walks, samples, bits)
        by: dict[tuple[int, int], list[int]] = {}
        for k, t in enumerate(texts):
            n, d = len(t), allowed(len(t), similarity)
            q = next((q for q in (3, 2, 1) if n - q + 1 - q * d >= 1), 0)
            by.setdefault((q, n.bit_length()), []).append(k)
        for (q, _), members in sorted(by.items()):
            lens = [len(texts[k]) for k in members]
            least = min(n - q + 1 - q * allowed(n, similarity) for n in lens) if q else 0
            grams = [g for k in members for g in self.grams(texts[k], q).tolist()] if q else []
            c = LengthClass(q, least, max(n + allowed(n, similarity) for n in lens), min(lens), np.unique(np.array(grams, np.int64)),
                            np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys, owners = [], []
            for k in members:
                keys.append(self.walk(texts[k], np.zeros(1, np.int64), np.array([len(texts[k])]), c.shortest)[0])
                owners.append(np.full(len(keys[-1]), k))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            c.keys, c.owners = keys[order], owners[order]
            self.classes.append(c)
        return self

    def grams(self, x: np.ndarray, q: int) -> np.ndarray:
        """Numbers of the q-grams of known words; 0 where a word is unknown."""
        v, n = len(self.vocab) + 1, max(0, len(x) - q + 1)
        g, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            g = g * v + x[k:k + n]
            ok &= x[k:k + n] > 0
        return np.where(ok, g, 0)

    def walk(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int) -> np.ndarray:
        """(starts, walks * samples) keys of the windows from ``starts``; 0: no key.
        ``ends``: where each window's text ends. A walk past it reads word -1."""
        w, steps = self.walks, 2 * shortest
        rng = np.random.default_rng([SEED, shortest])
        take = np.sort(np.stack([[rng.choice(steps, min(self.bits, steps), replace=False) for _ in range(self.samples)] for _ in range(w)]), 2)
        seeds = rng.integers(1, 2**63, (w, (steps + 63) // 64), dtype=np.uint64)
        m, lanes = len(starts), np.arange(w)
        padded = np.append(x, -1)
        key = np.tile(_mix((lanes[:, None] * self.samples + np.arange(self.samples) + 1).astype(np.uint64)), (m, 1, 1))
        known = np.ones(key.shape, bool)
        place = np.repeat(starts[:, None], w, 1)
        stop = ends[:, None]
        for j in range(steps):
            inside = place < stop
            word = np.where(inside, padded[np.minimum(place, len(x))], -1)
            for r, s in zip(*np.nonzero((take == j).any(2)), strict=True):
                key[:, r, s] = _mix(key[:, r, s] * np.uint64(0x9E3779B97F4A7C15) + (word[:, r] + 2).astype(np.uint64))
                known[:, r, s] &= word[:, r] != 0
            bit = _mix((word + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seeds[lanes, j // 64]) >> np.uint64(j % 64) & np.uint64(1)
            place = place + (inside & (bit == 1))
        return np.where(known, key | np.uint64(1), 0).reshape(m, -1)

    def windows(self, x: np.ndarray, c: LengthClass) -> np.ndarray:
        """Starts of windows with enough q-grams of the class (all starts if q is 0)."""
        if not c.q:
            return np.arange(len(x))
        g = self.grams(x, c.q)
        hit = np.zeros(len(x), np.int64)
        some = np.flatnonzero(g)
        if len(some) < c.least:
            return some[:0]
        at = np.minimum(np.searchsorted(c.grams, g[some]), len(c.grams) - 1)
        hit[some[c.grams[at] == g[some]]] = 1
        total = np.concatenate(([0], np.cumsum(hit)))
        ends = np.minimum(np.arange(len(x)) + c.width - c.q + 1, len(x))
        return np.flatnonzero((total[ends] - total[:-1] >= c.least) & (hit == 1) | self._near(total, ends, c, hit))

    def _near(self, total, ends, c: LengthClass, hit) -> np.ndarray:
        """A match may begin with edited words: starts up to an item's edits before a hit."""
        enough = total[ends] - total[:-1] >= c.least
        reach = allowed(c.width, self.similarity) + c.q
        after = np.minimum(np.arange(len(hit)) + reach, len(hit))
        return enough & (total[after] - total[:-1] > 0)

    def candidates(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) pairs that share a key; ``ends``: the text end of every word."""
        items, starts = [], []
        for c in self.classes:
            at = self.windows(x, c)
            for i in range(0, len(at), 4096):
                s = at[i:i + 4096]
                keys = self.walk(x, s, ends[s], c.shortest)
                row = np.repeat(s, keys.shape[1])[keys.ravel() > 0]
                keys = keys.ravel()[keys.ravel() > 0]
                lo, hi = np.searchsorted(c.keys, keys), np.searchsorted(c.keys, keys, side="right")
                n = hi - lo
                place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo
                items.append(c.owners[place])
                starts.append(np.repeat(row, n))
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def matches(self, x: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) of the best run of each matching item,
        over texts laid end to end in ``x``; ``begins`` has their bounds."""
        own = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        item, start = self.candidates(x, begins[1:][own])
        best: dict[tuple[int, int], tuple] = {}
        i = 0
        while i < len(item):
            k, t = int(item[i]), int(own[start[i]])
            n, d = len(self.texts[k]), allowed(len(self.texts[k]), self.similarity)
            j = i + 1  # starts close together are one region
            while j < len(item) and item[j] == k and own[start[j]] == t and start[j] - start[j - 1] <= n:
                j += 1
            a, b = max(int(begins[t]), int(start[i]) - n - d), min(int(begins[t + 1]), int(start[j - 1]) + n + 2 * d + 1)
            found = None
            if np.isin(x[a:b], self.texts[k]).sum() >= n - d:  # else too few of its words are there
                found = nearest_run(self.texts[k], x[a:b])
            if found and found[0] <= d:
                got = (found[0], a + found[1] - int(begins[t]), found[2])
                best[t, k] = min(best.get((t, k), got), got)
            i = j
        return [(t, k, *v) for (t, k), v in sorted(best.items())]


def _rows(pattern: np.ndarray, text: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of the whole pattern to runs of text by the run's end; runs start
    anywhere (``free``) or at the text's start."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free else at.copy()
    for p in pattern.tolist():
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != p))
        row = np.minimum.accumulate(new - at) + at
    return row


def nearest_run(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, length) of the run of text nearest to the pattern."""
    ends = _rows(pattern, text, True)
    end = int(ends.argmin())
    back = _rows(pattern[::-1], text[:end][::-1], False)
    length = int(back.argmin())
    return int(ends[end]), end - length, length


def _numbers(texts: list[str | None], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    get, parts, begins = vocab.get, [], [0]
    for t in texts:
        parts.extend([get(w, 0) for w in words(t)])
        begins.append(len(parts))
    return np.array(parts, np.int64), np.array(begins, np.int64)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters."""
    items = benchmark.select(col(id_col).alias("id"), col(text_col).alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.char_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for k in range(n):
        mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in mine.collect()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, item_words, distance, similarity, first_word, n_words)``: the
    best run of every matching document and item."""
    sc = docs.sparkSession.sparkContext
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, item_words int, distance int, similarity double, first_word long, n_words int"
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = sc.broadcast(Items.of(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            kinds = pa.schema([("item_id", pa.from_numpy_dtype(np.int64) if item_type == "bigint" else pa.string()), ("item_words", pa.int32()),
                               ("distance", pa.int32()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int32())])
            for b in slices(batches, 4 << 20):
                found = items.matches(*_numbers(b.column(1).to_pylist(), items.vocab))
                if found:
                    n = [len(items.texts[k]) for _, k, *_ in found]
                    columns = [[items.ids[k] if item_type == "bigint" else str(items.ids[k]) for _, k, *_ in found], n,
                               [f[2] for f in found], [1 - f[2] / x for f, x in zip(found, n, strict=True)], [f[3] for f in found], [f[4] for f in found]]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([f[0] for f in found])),
                                                      *(pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True))], names=["doc_id", *kinds.names])
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that no item matches."""
    sc, at, out = docs.sparkSession.sparkContext, docs.columns.index(text_col), docs
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = sc.broadcast(Items.of(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4 << 20):
                hit = {f[0] for f in shared.value.matches(*_numbers(b.column(at).to_pylist(), shared.value.vocab))}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)]))
        out = out.mapInArrow(run, docs.schema)
    return out
