"""Hidden Markov language model, trained by Baum-Welch counts over all partitions.

Tokens are the words of the text with A-Z lower-cased, then one end. The most frequent tokens
(at most ``HEAD``, those that occur ``MIN_COUNT`` times or are among the first ``OWN``) are
symbols of their own; every other token emits one of ``BUCKETS`` symbols by its hash. Training
runs over these symbols alone, so its parameters are broadcast and no iteration joins
anything: every task runs forward and backward over its sequences in lockstep (documents cut
into segments of ``SEGMENT`` tokens, for training only) and returns one row of expected counts
per symbol, summed by symbol.

The last iteration also returns, per task, the expected state counts of every token that stands
behind a bucket symbol; summed by token they are a table that grows with the vocabulary. With
n(w, s) these counts, c the corpus counts in bucket b, share(w) = (c + 0.5) / (C + 0.5 (V + 1)) and
the bucket's emission B(b | s), a token w with c >= ``MIN_COUNT`` has an emission of its own,

    B(b | s) * (n(w, s) / n(b, s) + KEEP * share(w)) / (1 + KEEP),

what is left of the bucket belongs to its rare tokens together, and among these a token is drawn
by its exact corpus count: (c + 0.5) / (C' + 0.5 (V' + 1)) over the rare tokens, where the half left
over is for unseen tokens. So all tokens of a bucket and one unseen token sum to B(b | s). Scoring
joins the documents' own tokens to this table once and runs the scaled forward recursion over
whole documents.

Word counts: a partial count per task, summed by key. No token outside the broadcast ones can
hold more than one in ``HEAD`` of the training tokens, so the join has no hot key among known
tokens; a token that only held-out documents have may be split by Spark's skew join. There is
one path at every size.

Defined cases: null and empty text are the single end token; a null id is a training
document; rows that repeat count again; with no training document all counts are 0; an
empty table gives an empty result; columns other than the id and the text are not read; a very
long text is one row of a task, with memory in proportion to its tokens times the states.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, slices, texts, written

STATES = 8
OWN = 8192
MIN_COUNT = 10
BUCKETS = 4096
HEAD = 61_440  # with the buckets, symbols fit 16 bits
ITERATIONS = 4
SEGMENT = 512
SEED = 3
SMOOTH = 0.02
KEEP = 0.1
PARTS = 1024
END = b"\n"  # no word holds white space
_FLUSH = 200_000
_LN10 = np.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    w = text.lower().split()
    w.append(END)
    return w


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over the rows of ``docs(text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "c"])
        for b in slices(batches, 2 << 20):
            for t in texts(b.column(0)):
                counts.update(tokens(t))
            if len(counts) > _FLUSH:
                yield rows()
                counts.clear()
        if counts:
            yield rows()
    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The broadcast tokens with their counts, and the sums of each bucket."""
    words: list[bytes]        # symbols of their own, by (count desc, word)
    counts: np.ndarray
    own: int                  # their number
    tail_c: np.ndarray        # per bucket: tokens of all its words
    tail_v: np.ndarray        # and its words
    bucket_c: np.ndarray      # the same of its rare words
    bucket_v: np.ndarray
    total: int                # N
    distinct: int             # V

    def __post_init__(self):
        self.index = None

    @property
    def symbols(self) -> int:
        return self.own + BUCKETS

    @property
    def dtype(self) -> str:
        return "<u4" if self.symbols > 1 << 16 else "<u2"

    def ready(self) -> Vocabulary:
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
            self.log_c = np.log10(self.counts + 0.5)
            self.log_z = np.log10(self.bucket_c + 0.5 * (self.bucket_v + 1))
        return self

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "counts", "own", "tail_c", "tail_v", "bucket_c", "bucket_v", "total", "distinct")}

    def __setstate__(self, s):
        self.__dict__.update(s)
        self.index = None

    def share(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Shares of words with counts ``c`` in their buckets ``b``."""
        return (c + 0.5) / (self.tail_c[b] + 0.5 * (self.tail_v[b] + 1))


def hashes(words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)


def bucket(word: bytes) -> int:
    return int(hashes([word])[0] % BUCKETS)  # as pmod(xxhash64(word), BUCKETS)


BLOOM_SLOTS = 1 << 19  # of 64 bits: 4 MB at every size of the vocabulary


def _slot_and_bits(h):
    """A word's slot of the Bloom filter and its two bits there, from its hash (numpy or column)."""
    if isinstance(h, np.ndarray):
        one = np.int64(1)
        return h % BLOOM_SLOTS, (one << ((h >> 40) & 63)) | (one << ((h >> 50) & 63))
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(h, F.lit(BLOOM_SLOTS)), bit(40).bitwiseOR(bit(50))


def bloom(words: DataFrame) -> np.ndarray:
    """A Bloom filter of ``words (word)``. Its size is fixed; it keeps words from being sent in
    vain, and a word that passes by accident changes nothing."""
    slot, bits = _slot_and_bits(F.xxhash64("word"))
    got = words.select(slot.alias("slot"), bits.alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()  # <= BLOOM_SLOTS rows
    out = np.zeros(BLOOM_SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()
    return out


def passes(filter_: np.ndarray, words: list[bytes]) -> np.ndarray:
    slot, bits = _slot_and_bits(hashes(words))
    return (filter_[slot] & bits) == bits


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The broadcast part of the vocabulary and the counts ``(word, c)`` of all other tokens."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("s")).agg(  # a few hundred rows
        F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).orderBy(F.col("s").desc()).collect()
    total, distinct = sum(r["c"] for r in steps), sum(r["v"] for r in steps)
    cut, held = None, 0
    for r in steps:
        held += r["v"]
        if held > head:
            break
        cut = r["s"]
    top = [] if cut is None else counts.filter(F.floor(F.log2("c") * 8).cast("int") >= cut).toPandas().itertuples(index=False)
    top = sorted(((r.word.encode(), r.c) for r in top), key=lambda x: (-x[1], x[0]))  # at most ``head`` rows
    own = max(sum(x >= MIN_COUNT for _, x in top), min(OWN, len(top)))
    names = counts.sparkSession.createDataFrame(pd.DataFrame({"word": [w.decode() for w, _ in top[:own]]}), "word string")
    rest = counts.join(F.broadcast(names), "word", "left_anti")
    rare = F.col("c") < MIN_COUNT
    sums = rest.groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("b")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("rc"), F.count_if(rare).alias("rv")).collect()
    per = np.zeros((4, BUCKETS))
    for r in sums:
        per[:, r["b"]] = r["c"], r["v"], r["rc"], r["rv"]
    return Vocabulary([w for w, _ in top[:own]], np.array([x for _, x in top[:own]], float), own, *per, total, distinct), rest


_ENCODED = ("doc_id {}, held_out boolean, rid long, n_tokens long, n_head long, s_head double, sym binary, place binary, "
            "tail array<string>")


def encode(docs: DataFrame, vocab, id_type: str) -> DataFrame:
    """Symbols of every row, sums over its broadcast tokens, its other tokens (distinct) and, for
    every bucket symbol in order, which of them it stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value.ready()
        for b in slices(batches, 4 << 20):
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            rows = [tokens(t) for t in texts(b.column(3))]
            size = np.array([len(w) for w in rows])
            local = np.concatenate([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in rows])
            doc = np.repeat(np.arange(len(rows)), size)
            del rows
            words = list(number)
            head = np.fromiter(map(v.index.get, words, repeat(-1)), np.int64, len(words))
            other = np.flatnonzero(head < 0)
            own = np.zeros(len(words), np.int64)
            own[other] = v.own + hashes([words[k] for k in other.tolist()]) % BUCKETS
            sym = np.where(head >= 0, head, own)[local]
            log_c = np.where(head >= 0, v.log_c[head] if len(v.words) else 0.0, 0.0)
            tail = np.flatnonzero(head[local] < 0)
            # the distinct other tokens of each row, and which of them each bucket symbol stands for
            pairs, at = np.unique(doc[tail] * len(words) + local[tail], return_inverse=True)
            first = np.searchsorted(pairs, np.arange(b.num_rows + 1) * len(words))
            place = (at - first[doc[tail]]).astype("<u4")
            ends = np.cumsum(np.bincount(doc[tail], minlength=b.num_rows))[:-1]
            listed = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(pairs % max(1, len(words))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(size - np.bincount(doc[tail], minlength=b.num_rows), pa.int64()),
                 pa.array(np.bincount(doc, log_c[local], b.num_rows)),
                 pa.array([x.tobytes() for x in np.split(sym.astype(v.dtype), np.cumsum(size)[:-1])], pa.binary()),
                 pa.array([x.tobytes() for x in np.split(place, ends)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), listed)],
                names=["doc_id", "held_out", "rid", "n_tokens", "n_head", "s_head", "sym", "place", "tail"])
    return docs.select("doc_id", "held_out", "rid", "text").mapInArrow(run, _ENCODED.format(id_type))


@dataclass
class Model:
    start: np.ndarray   # (K,)
    move: np.ndarray    # (K, K)
    emit: np.ndarray    # (symbols, K)

    @classmethod
    def first(cls, vocab: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
        """Corpus frequencies with seeded noise per state, and states that tend to stay."""
        freq = np.concatenate([vocab.counts, vocab.tail_c])
        emit = (freq + 0.5)[:, None] * noise(vocab.words + [b"\n%d" % b for b in range(BUCKETS)], states, seed)
        move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def counted(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From expected counts, with a small share for what was not seen."""
        move, start = move + 0.1, start + 0.1
        emit = emit + SMOOTH * (emit.sum(0) + 1) / len(emit)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def noise(words: list[bytes], states: int, seed: int) -> np.ndarray:
    """Log-normal factors by the word alone, so they don't depend on where its row is kept."""
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        z = h[:, None] + np.arange(1, 2 * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.exp(np.sqrt(-2 * np.log(1 - u[:, :states])) * np.cos(2 * np.pi * u[:, states:]))


def _names(states: int) -> list[str]:
    return [f"s{i}" for i in range(states)]


def _lockstep(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out step by step: (order, symbols, bounds of steps)."""
    lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    steps = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(1, steps + 1), side="right")
    bounds = np.concatenate(([0], np.cumsum(active)))
    flat = np.concatenate([seqs[i] for i in order]) if len(seqs) else np.zeros(0, np.uint16)
    rank = np.repeat(np.arange(len(lens)), lens)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.empty(len(flat), np.int64)
    out[bounds[step] + rank] = flat
    return order, out, bounds


def log_likelihood(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """Natural log likelihood of every whole sequence by the scaled forward recursion."""
    order, sym, bounds = _lockstep(seqs)
    ll, a = np.zeros(len(seqs)), None
    for t in range(len(bounds) - 1):
        e = m.emit[sym[bounds[t]:bounds[t + 1]]]
        a = e * m.start if t == 0 else (a[:len(e)] @ m.move) * e
        c = a.sum(1)
        a /= c[:, None]
        ll[:len(e)] += np.log(c)
    out = np.empty(len(seqs))
    out[order] = ll
    return out


def _posteriors(seqs: list[np.ndarray], m: Model):
    """``(order, symbols, bounds, state posteriors, pair sums, log likelihood)`` in lockstep."""
    order, sym, bounds = _lockstep(seqs)
    k, steps = len(m.start), len(bounds) - 1
    emit, move, start_p = m.emit.astype(np.float32), m.move.astype(np.float32), m.start.astype(np.float32)
    e = emit[sym]
    alpha, scale = np.empty_like(e), np.empty(len(sym), np.float32)
    for t in range(steps):
        i, j = bounds[t], bounds[t + 1]
        a = e[i:j] * start_p if t == 0 else (alpha[bounds[t - 1]:bounds[t - 1] + j - i] @ move) * e[i:j]
        c = a.sum(1)
        scale[i:j] = c
        alpha[i:j] = a / c[:, None]
    ll, xi, beta = float(np.log(scale, dtype=np.float64).sum()), np.zeros((k, k)), None
    for t in range(steps - 1, -1, -1):
        i, j = bounds[t], bounds[t + 1]
        now = np.ones((j - i, k), np.float32)
        if beta is not None:
            v = e[j:bounds[t + 2]] * beta / scale[j:bounds[t + 2], None]
            xi += alpha[i:i + len(v)].T @ v
            now[:len(v)] = v @ move.T
        beta = now
        alpha[i:j] *= beta  # the step's state posteriors
    return order, sym, bounds, alpha, xi * m.move, ll


def _counts(sym: np.ndarray, posterior: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(sym, weights=posterior[:, s], minlength=n) for s in range(posterior.shape[1])], 1)


def expected_counts(seqs: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, move, emit) of some sequences and their log likelihood."""
    _, sym, bounds, posterior, xi, ll = _posteriors(seqs, m)
    start = posterior[:bounds[1]].sum(0, dtype=np.float64) if len(bounds) > 1 else np.zeros(len(m.start))
    return start, xi, _counts(sym, posterior, len(m.emit)), ll


def in_order(seqs: list[np.ndarray], order: np.ndarray, bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows laid out in lockstep, back in the order of the sequences, one after the other."""
    lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
    rank = np.empty(len(seqs), np.int64)
    rank[order] = np.arange(len(seqs))
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return x[bounds[step] + np.repeat(rank, lens)]


def _symbols(column: pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def baum_welch(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS,
               seed: int = SEED, wanted: np.ndarray | None = None) -> tuple[Model, list[float], DataFrame, np.ndarray]:
    """Train on the rows of ``encoded`` that are not held out: the model, the log likelihood of
    the training symbols before each step, the expected state counts ``(word, s0, s1, ...)`` of
    the tokens behind bucket symbols in the last step (of those that pass the Bloom filter
    ``wanted``, if there is one), and those of the buckets."""
    m, trace = Model.first(vocab, states, seed), []
    sc = encoded.sparkSession.sparkContext
    train = encoded.filter(~F.col("held_out")).select("sym", "place", "tail")
    names, n, own, dtype = _names(states), vocab.symbols, vocab.own, vocab.dtype
    # expected counts travel in whole parts of 1 / PARTS: short on the wire, and their sums do not
    # depend on the order of the tasks
    schema = "sym int, word string, " + ", ".join(f"{x} long" for x in names)
    held = None if wanted is None else sc.broadcast(wanted)
    for it in range(iterations):
        shared, last = sc.broadcast(m), it == iterations - 1  # (HEAD + BUCKETS + states + 1) * states numbers at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            got = None

            def out(at, words, x):
                x = np.rint(x * PARTS).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), words, *(pa.array(x[:, i]) for i in range(states))], names=["sym", "word", *names])
            for b in slices(batches, (2 if last else 1) << 20):
                seqs = [x[i:i + SEGMENT] for x in _symbols(b.column("sym"), dtype) for i in range(0, len(x), SEGMENT)]
                order, sym, bounds, posterior, move, ll = _posteriors(seqs, shared.value)
                start = posterior[:bounds[1]].sum(0, dtype=np.float64) if len(bounds) > 1 else np.zeros(states)
                part = np.vstack([_counts(sym, posterior, n), move, start, np.full(states, ll / states)])
                got = part if got is None else got + part
                if last:
                    behind = in_order(seqs, order, bounds, posterior)[np.concatenate(seqs) >= own]
                    at, words = _tail_words(b)
                    x = _counts(at, behind, len(words))
                    if held is not None and len(words):
                        on = passes(held.value, words.cast(pa.binary()).to_pylist())
                        words, x = words.filter(pa.array(on)), x[on]
                    if len(words):
                        yield out(np.full(len(words), -1), words, x)
            if got is not None:
                at = np.flatnonzero(got.any(1))
                yield out(at, pa.nulls(len(at), pa.string()), got[at])

        given = train if last else train.select("sym")
        sums = given.mapInArrow(run, schema).groupBy("sym", "word").agg(*[F.sum(x).alias(x) for x in names])
        if last:
            sums = written(sums, "expected")
        few = sums.filter(F.col("sym") >= 0).toPandas()  # a row per broadcast symbol
        total = np.zeros((n + states + 2, states))
        total[few["sym"].to_numpy()] = few[names].to_numpy() / PARTS
        trace.append(float(total[n + states + 1].sum()))
        m = Model.counted(total[n + states], total[n:n + states], total[:n])
    return m, trace, sums.filter(F.col("sym") < 0).select("word", *[(F.col(x) / PARTS).alias(x) for x in names]), total[own:n]


def _tail_words(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """For every bucket symbol of a batch, in order, its token's place in the list of the
    batch's tokens, and this list."""
    words = b.column("tail").flatten().dictionary_encode()
    size = b.column("tail").value_lengths().to_numpy()
    start = np.cumsum(size) - size
    place = [np.frombuffer(x, "<u4") for x in b.column("place").to_pylist()]
    at = np.concatenate([*(x + s for x, s in zip(place, start.tolist(), strict=True)), np.zeros(0, np.int64)]).astype(np.int64)
    return words.indices.to_numpy().astype(np.int64)[at], words.dictionary


def packed(e: np.ndarray) -> np.ndarray:
    """Emissions as 16-bit logarithms, good to 0.04 %."""
    return np.minimum(np.rint(-1024 * np.log2(np.maximum(e, 1e-19))), 65535).astype("<u2")


def unpacked(x: np.ndarray) -> np.ndarray:
    return np.exp2(x / -1024.0)


def tail_table(rest: DataFrame, expected: DataFrame, m: Model, of_bucket: np.ndarray, vocab: Vocabulary) -> tuple[DataFrame, Model]:
    """``(word, c, e)`` of all tokens that are not broadcast, e being the :func:`packed` emissions of
    those with ``MIN_COUNT`` occurrences, and the model whose bucket symbols stand for the rare
    tokens only."""
    states = len(m.start)
    names = _names(states)
    both = written(rest.join(expected, "word", "left").fillna(0.0, names), "tail-words")
    often = both.filter(F.col("c") >= MIN_COUNT).withColumn("b", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    have = np.zeros((BUCKETS, states))
    for r in often.groupBy("b").agg(*[F.sum(x).alias(x) for x in names]).collect():  # a row per bucket
        have[r["b"]] = [r[x] for x in names]
    seen = of_bucket > 0
    safe = np.where(seen, of_bucket, 1.0)
    left = (vocab.bucket_c + 0.5 * (vocab.bucket_v + 1)) / (vocab.tail_c + 0.5 * (vocab.tail_v + 1))
    rare = np.where(seen, (np.maximum(of_bucket - have, 0) / safe + KEEP * left[:, None]) / (1 + KEEP), left[:, None])
    emit = m.emit.copy()
    base = emit[vocab.own:].copy()
    emit[vocab.own:] *= rare
    facts = rest.sparkSession.sparkContext.broadcast((replace(vocab, words=[], counts=np.zeros(0)), base, seen, safe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, base, seen, safe = facts.value
        for x in batches:
            c = x.column("c").to_numpy()
            b = hashes(x.column("word").cast(pa.binary()).to_pylist()) % BUCKETS
            n = np.stack([x.column(s).to_numpy() for s in names], 1)
            share = v.share(b, c)[:, None]
            e = packed(base[b] * np.where(seen[b], (n / safe[b] + KEEP * share) / (1 + KEEP), share))
            yield pa.RecordBatch.from_arrays([x.column("word"), x.column("c"), pa.array([r.tobytes() if k >= MIN_COUNT else None for r, k in zip(e, c.tolist(), strict=True)], pa.binary())],
                                             names=["word", "c", "e"])
    return both.mapInArrow(run, "word string, c long, e binary"), Model(m.start, m.move, emit)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS,
          head: int = HEAD, seed: int = SEED) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), F.monotonically_increasing_id().alias("rid"),
                       col(text_col).alias("text"))
    counts = written(word_counts(rows.filter(~F.col("held_out"))), "word-counts")
    vocab, rest = vocabulary(counts, head)
    encoded = written(encode(rows, sc.broadcast(vocab), id_type), "symbols", **{"parquet.block.size": 16 << 20})
    wanted = bloom(rest.filter(F.col("c") >= MIN_COUNT).select("word"))
    model, _, expected, of_bucket = baum_welch(encoded, vocab, states, iterations, seed, wanted)
    table, model = tail_table(rest, expected, model, of_bucket, vocab)
    asked = encoded.select("rid", F.posexplode("tail").alias("j", "word"))
    # place and count in one number: c is below 2 ** 31, as no such word is among the HEAD most frequent
    spot = F.call_function("shiftleft", F.coalesce("c", F.lit(0)).cast("long"), F.lit(32)).bitwiseOR(F.col("j").cast("long"))
    found = asked.join(table, "word", "left").select("rid", F.struct(spot.alias("jc"), "e").alias("x"))
    found = found.groupBy("rid").agg(F.collect_list("x").alias("found"))
    both = encoded.select("doc_id", "held_out", "rid", "n_tokens", "n_head", "s_head", "sym", "place").join(found, "rid", "left")
    shared, facts = sc.broadcast(model), sc.broadcast(replace(vocab, words=[], counts=np.zeros(0)))
    z = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = facts.value.ready(), shared.value
        for b in slices(batches):
            found = b.column("found")
            entries = found.flatten()
            size = found.fill_null([]).value_lengths().to_numpy()
            start = np.cumsum(size) - size
            jc, e = entries.field("jc").to_numpy(), entries.field("e")
            doc = np.repeat(np.arange(b.num_rows), size)
            at, c = start[doc] + (jc & 0xFFFFFFFF), jc >> 32  # by document and place
            own = np.flatnonzero(e.is_valid().to_numpy(zero_copy_only=False))
            look = np.full(len(jc), -1)
            look[at[own]] = v.symbols + np.arange(len(own))
            rows = unpacked(np.frombuffer(b"".join(e.drop_null().to_pylist()), "<u2")).reshape(len(own), -1) if len(own) else np.zeros((0, m.emit.shape[1]))
            count = np.zeros(len(jc), np.int64)
            count[at] = c
            sym = np.frombuffer(b"".join(b.column("sym").to_pylist()), v.dtype).astype(np.int64)
            n = b.column("n_tokens").to_numpy()
            behind = np.flatnonzero(sym >= v.own)
            of = np.repeat(np.arange(b.num_rows), n)[behind]
            spot = start[of] + np.frombuffer(b"".join(b.column("place").to_pylist()), "<u4")
            lg, symbol = np.log10(count[spot] + 0.5), look[spot]
            rare = symbol < 0
            add = lambda x, of=of: np.bincount(of, x, b.num_rows)
            inside = add(np.where(rare, lg - v.log_z[sym[behind] - v.own], 0.0))
            known = b.column("n_head").to_numpy() + add((count[spot] > 0).astype(float)).astype(np.int64)
            base = b.column("s_head").to_numpy() + add(lg) - n * z
            sym[behind[~rare]] = symbol[~rare]
            ll = log_likelihood(np.split(sym, np.cumsum(n)[:-1]), Model(m.start, m.move, np.concatenate([m.emit, rows]))) / _LN10
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(known, pa.int64()),
                                              pa.array(base, pa.float64()), pa.array(ll + inside)],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    scored = both.mapInArrow(forward, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
