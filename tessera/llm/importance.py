"""Target-distribution importance resampling over hashed n-grams.

Features of a text are its words and pairs of neighbouring words, hashed by CRC-32 into a
fixed number of buckets. Bucket totals of the corpus and of the target texts give each bucket
a gain; a text's weight is its mean gain, and a Gumbel draw keyed by its id makes the sample.

Head and tail. One pass counts words and pairs slice by slice and hands on those that have a
share of at least ``1 / SHARE`` of their slice (a feature with this share of the corpus has it
in some slice). The most frequent ``HEAD_WORDS`` words are broadcast with their bucket and
their CRC state after "word ", the most frequent ``HEAD_PAIRS`` pairs of head words with their
bucket; both sizes are parameters. Every other word or pair has its CRC taken directly, a pair
from the state of its first word. Head and tail give the same buckets as hashing every feature
would, so the head changes the time and no result. Totals are added up task by task.

Defined cases: a null or empty text, or one without words, has no feature and weight 0; a null
id draws as an empty one and comes after all ids at a tie; rows that repeat an id draw the same
number and are ranked as rows of their own; an empty corpus gives an empty result, without
target texts all target totals are zero; other columns are not read. A very long text is a
slice of its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import col, slices, texts, written

BUCKETS = 10_000
HEAD_WORDS = 1 << 16
HEAD_PAIRS = 1 << 17
SHARE = 1 << 15

#: A-Z lower-cased; every ASCII character but letters and digits is a blank.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() and c < 0x80 or c >= 0x80 else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of letters a-z, digits and characters beyond ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class Head:
    """``words``: word -> (place, bucket, CRC state after the word and a blank); ``pairs``: sorted
    place1 * len(words) + place2, with ``pair_buckets``."""

    words: dict[bytes, tuple[int, int, int]]
    pairs: np.ndarray
    pair_buckets: np.ndarray
    buckets: int

    @classmethod
    def of(cls, words: list[bytes], pairs: list[bytes], buckets: int) -> Head:
        table = {w: (k, zlib.crc32(w) % buckets, zlib.crc32(w + b" ")) for k, w in enumerate(words)}
        keys = {}
        for p in pairs:
            a, b = (table.get(w) for w in p.split(b" "))
            if a and b:
                keys[a[0] * len(table) + b[0]] = zlib.crc32(p) % buckets
        order = sorted(keys)
        return cls(table, np.array(order, np.int64), np.array([keys[k] for k in order], np.int64), buckets)

    def features(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word buckets, pair buckets, words of each text)``; a text of n words has its first
        n - 1 entries of the pairs in use, the last one is -1."""
        vocabulary, ids, sizes = numbered(docs)
        head = [self.words.get(w) for w in vocabulary]
        place = np.array([h[0] if h else -1 for h in head], np.int64)
        bucket = np.array([h[1] if h else zlib.crc32(w) % self.buckets for w, h in zip(vocabulary, head, strict=True)], np.int64)
        state = [h[2] if h else zlib.crc32(w + b" ") for w, h in zip(vocabulary, head, strict=True)]
        pair = np.full(len(ids), -1, np.int64)
        at = pair_starts(sizes)
        a, b = ids[at], ids[at + 1]
        if len(self.pairs):
            both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
            key = place[a[both]] * len(self.words) + place[b[both]]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[k] == key
            pair[at[both[hit]]] = self.pair_buckets[k[hit]]
        tail = np.flatnonzero(pair[at] < 0)
        crc, n = zlib.crc32, self.buckets
        pair[at[tail]] = np.fromiter((crc(vocabulary[y], state[x]) % n for x, y in zip(a[tail].tolist(), b[tail].tolist(), strict=True)), np.int64, len(tail))
        return bucket[ids], pair, sizes


def numbered(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(vocabulary, word numbers of all texts, words of each text)``."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in docs]
    return list(number), np.concatenate([*parts, np.zeros(0, np.int64)]), np.array([len(w) for w in docs], np.int64)


def pair_starts(sizes: np.ndarray) -> np.ndarray:
    """Places of all words that have a next word in their text."""
    last = np.cumsum(sizes)[sizes > 0] - 1
    return np.delete(np.arange(int(sizes.sum())), last)


def frequent(docs: list[list[bytes]], share: int) -> Iterator[tuple[str, bytes, int]]:
    """``(kind, feature, n)`` of the words and pairs with at least one share-th of these texts."""
    vocabulary, ids, sizes = numbered(docs)
    least = max(1, -(-len(ids) // share))
    count = np.bincount(ids, minlength=len(vocabulary))
    for k in np.flatnonzero(count >= least).tolist():
        yield "word", vocabulary[k], int(count[k])
    at = pair_starts(sizes)
    a, b = ids[at], ids[at + 1]
    often = (count[a] >= least) & (count[b] >= least)
    keys, n = np.unique(a[often] * len(vocabulary) + b[often], return_counts=True)
    for k, c in zip(keys[n >= least].tolist(), n[n >= least].tolist(), strict=True):
        yield "pair", vocabulary[k // len(vocabulary)] + b" " + vocabulary[k % len(vocabulary)], c


def head_vocabulary(texts_: DataFrame, buckets: int = BUCKETS, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, share: int = SHARE) -> Head:
    """The head of the texts (one text column); its size is bounded by the parameters."""
    def run(batches):
        for b in slices(batches):
            rows = list(frequent([split_words(t) for t in texts(b.column(0))], share))
            if rows:
                kind, feature, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(feature, pa.binary()), pa.array(n, pa.int64())], names=["kind", "feature", "n"])
    counts = written(texts_.mapInArrow(run, "kind string, feature binary, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")), "frequent")
    top = lambda kind, k: [bytes(r[0]) for r in counts.filter(F.col("kind") == kind).orderBy(F.desc("n"), "feature").limit(k).select("feature").collect()]
    return Head.of(top("word", words), top("pair", pairs), buckets)


def bucket_totals(texts_: DataFrame, head: Head) -> DataFrame:
    """``(bucket, n)``: how often the features of all texts fall into each bucket."""
    shared = texts_.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        h = shared.value
        total = np.zeros(h.buckets, np.int64)
        for b in slices(batches):
            word, pair, _ = h.features([split_words(t) for t in texts(b.column(0))])
            total += np.bincount(word, minlength=h.buckets) + np.bincount(pair[pair >= 0], minlength=h.buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])
    return texts_.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, floored."""
    n = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def draw(doc_id, seed: int) -> int:
    """The floored Gumbel draw of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, head: Head, gain: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        h, g = shared.value
        g = np.append(g, 0)  # the -1 after a text's last pair
        for b in slices(batches):
            word, pair, size = h.features([split_words(t) for t in texts(b.column(1))])
            total = np.concatenate(([0], np.cumsum(g[word] + g[pair])))
            end = np.cumsum(size)
            n = np.maximum(2 * size - 1, 0)
            weight = (total[end] - total[end - size]) // np.maximum(n, 1)
            score = weight + np.fromiter((draw(i, seed) for i in b.column(0).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (size, n, weight, score)]],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])
    return (docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long"))


def _totals(table: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in table.collect():  # one row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", head: Head | None = None) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``: ``percent`` of the
    rows with at least ``min_words`` words are drawn towards the texts of ``target`` and have
    their rank by score (ties: smaller id); rank is null for all others."""
    own, goal = docs.select(col(text_col).alias("text")), target.select(col(text_col).alias("text"))
    head = head or head_vocabulary(own.unionByName(goal), buckets)
    gain = gains(_totals(bucket_totals(own, head), buckets), _totals(bucket_totals(goal, head), buckets))
    scored = written(weigh(docs, head, gain, seed, id_col, text_col), "scores")
    able = F.col("n_words") >= min_words
    take = percent * scored.filter(able).count() // 100
    # rows that agree in all of these are equal rows
    ranked = global_rank(scored.withColumn("out", (~able).cast("int")),
                         ["out", F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words"], "place")
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when((F.col("out") == 0) & (F.col("place") < take), F.col("place") + 1).alias("rank"))
