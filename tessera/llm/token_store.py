"""Token-ID output: one wavelet matrix per shard.

Documents are dealt by ranges of ``doc_id``, sorted, encoded with the ``tokenizers``
library, ended by ``end_id`` and cut into shards of about ``SHARD_TOKENS`` ids at
document ends. A shard is one row of a compressed Parquet file written by Spark's own
committer (so retries and lost executors leave no half file, on any file system):

    part, seq        place of the shard; ascending (part, seq) is ascending doc_id
    before           ids of the part before this shard
    n, doc_ids, lens ids in the shard, its documents and their lengths
    zeros[p]         number of zero bits in plane p
    planes[p]        bits of plane p, least significant bit of each byte first
    ranks[p]         one bits before each block of 512 bits (uint32)

Plane p holds bit (top - p) of every id after the stable partition by the planes
above. :class:`WaveletMatrix` gives access, rank, select and count on these columns, and
:func:`count_token` and :func:`find_token` run them over all shards.

The encoder cuts texts at the borders of the tokenizer's own pre-tokens and encodes each
distinct one once with the library, as long as all characters belong to a fixed set whose
classes are written out below; any other text, any text with the string of an added token,
and any tokenizer that is not byte-level goes to the library whole. The ids are the same
either way. Borders are found in numpy over the characters of a whole batch; pre-tokens are
known by 128 bits of two polynomial hashes, and only those not met before become strings.

Defined cases: null text is empty (its document is the end id alone); rows that repeat
an id stay apart, in the order of their texts' hashes; null ids come first; an empty
table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, scratch_path, slices

SHARD_TOKENS = 1 << 19
BLOCK = 512
END_ID = 2
MEMO = 1_500_000  # pre-tokens an encoder keeps before it starts anew
CHUNK = 1 << 20  # characters cut at once

# Classes of characters in the pre-token pattern of byte-level BPE tokenizers
#   's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|spaces not before a word|spaces
_LETTERS, _DIGITS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9", "\x21-\x7e¡«»¿–—‘-”…€"
BAD, LETTER, DIGIT, OTHER, BLANK, LINE, STOP = range(7)  # unknown, ..., a blank, other white space, end of text
_ONE, _TWO = "stmd", ("re", "ve", "ll")


def _classes() -> np.ndarray:
    out = np.zeros(0x2100, np.uint8)
    for kind, some in ((OTHER, _OTHERS), (DIGIT, _DIGITS), (LETTER, _LETTERS)):
        match = re.compile(f"[{some}]").match
        out[[c for c in range(len(out)) if match(chr(c))]] = kind
    out[ord(" ")], out[0] = BLANK, STOP
    out[[ord(c) for c in "\t\n\r"]] = LINE
    return out


_CLASS = _classes()


def borders(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin, ends of texts (STOP) counting as pre-tokens."""
    group = np.where(kind == LINE, np.uint8(BLANK), kind)
    first = np.ones(len(kind), bool)
    first[1:] = (group[1:] != group[:-1]) | (group[1:] == STOP)
    # white space before a word: its last character stands alone, a blank goes with the word
    last = np.flatnonzero((group[:-1] == BLANK) & (group[1:] != BLANK) & (group[1:] != STOP))
    first[last] = True
    first[last[kind[last] == BLANK] + 1] = False
    at = np.flatnonzero(codes == ord("'"))
    at = at[first[at]]
    if len(at):
        one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in _ONE])
        long = np.zeros(len(at), bool)
        for a, b in _TWO:
            long |= (one == ord(a)) & (two == ord(b))
        first[at[short | long] + 1] = False
        first[at[short] + 2] = True
        first[at[long] + 3] = True
    return np.flatnonzero(first)


class _Powers:
    """Powers of two odd numbers and of their inverses, modulo 2 ** 64."""
    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def upto(self, n: int) -> _Powers:
        if n > self.n:
            self.n = n + n // 4
            table = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]), dtype=np.uint64)
            self.up = [table(b) for b in self.BASES]
            self.down = [table(pow(b, -1, 1 << 64)) for b in self.BASES]
        return self


_POWERS = _Powers()


def piece_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the characters in each [start, end)."""
    p, c, out = _POWERS.upto(len(codes)), codes.astype(np.uint64) + np.uint64(1), []
    for up, down in zip(p.up, p.down, strict=True):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(c * up[:len(codes)], out=total[1:])
        out.append((total[end] - total[start]) * down[start])
    return out


class _Memo:
    """Ids of pre-tokens in one growing array. ``key`` holds their first hashes in order, with
    the second hash and the place of each."""

    def __init__(self):
        self.key, self.check, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of pre-tokens, -1 for those not known."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), self.place[at], -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """New pre-tokens, with their ids end to end."""
        had, used = self.n, int(self.ends[self.n])
        for name, need in (("ids", used + len(ids)), ("ends", had + len(key) + 1)):
            x = getattr(self, name)
            if need > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)]))
        self.ids[used:used + len(ids)] = ids
        self.n = had + len(key)
        self.ends[had + 1:self.n + 1] = used + np.cumsum(lens)
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        self.key, self.check = np.insert(self.key, at, key[order]), np.insert(self.check, at, check[order])
        self.place = np.insert(self.place, at, had + order)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens end to end, and the number of ids of each."""
        start = self.ends[places]
        lens = self.ends[places + 1] - start
        total = int(lens.sum())
        at = np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(total)
        return self.ids[at], lens


class Encoder:
    """Ids of whole texts. Texts of safe characters are cut into pre-tokens, each distinct one
    is encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                      and spec.get("normalizer") is None)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        #: bytes of each id: a byte-level token has one character per byte
        self.id_bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)])
        self.bits = max(1, (size - 1).bit_length())
        self.memo = _Memo()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, end to end: (order of the parts, ids, ids of each). Those of
        a blank and a word are encoded some hundred at a time as one text: its pre-tokens are
        these very parts, and the byte lengths of the ids tell them apart."""
        words = [k for k, p in enumerate(parts) if p[0] == " " and p[1:].isalpha()]
        other = sorted(set(range(len(parts))).difference(words))
        ids, lens = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        if words:
            got = np.concatenate(self._whole(["".join([parts[k] for k in words[i:i + 256]]) for i in range(0, len(words), 256)]))
            ends = np.cumsum([len(parts[k].encode()) for k in words])
            ids.append(got)
            lens.append(np.diff(np.searchsorted(np.cumsum(self.id_bytes[got]), ends) + 1, prepend=0))
        if other:
            got = self._whole([parts[k] for k in other])
            ids.append(np.concatenate(got))
            lens.append(np.array([len(x) for x in got]))
        return np.array(words + other), np.concatenate(ids), np.concatenate(lens)

    def _cut(self, texts: list[str]) -> list[np.ndarray] | None:
        """Ids of texts without characters of class BAD or STOP; None if two pre-tokens share
        a hash."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = _CLASS[codes]
        start = borders(codes, kind)
        stop = kind[start] == STOP
        end = np.append(start[1:], len(codes))
        key, check = piece_hashes(codes, start[~stop], end[~stop])
        each, first, at = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][at] != check).any():
            return None
        if self.memo.n > MEMO:
            self.memo = _Memo()
        place = self.memo.find(each, check[first])
        new = np.flatnonzero(place < 0)
        if len(new):
            a, b = start[~stop][first[new]], end[~stop][first[new]]
            order, ids, lens = self._learn([joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            self.memo.add(each[new][order], check[first][new][order], ids, lens)
            place = self.memo.find(each, check[first])
            if (place < 0).any():
                return None
        ids, lens = self.memo.gather(place[at])
        upto = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(~stop)[stop]]
        return np.split(ids, upto[:-1])

    def _known(self, texts: list[str]) -> list[bool]:
        """Which texts can be cut: all characters are known and none is an added token's string."""
        out = [self.split and "\0" not in t and not any(a in t for a in self.added) for t in texts]
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), "<u4")
        bad = np.flatnonzero(_CLASS[np.minimum(codes, len(_CLASS) - 1)] == BAD)
        if len(bad):
            ends = np.cumsum([len(t) + 1 for t in texts])
            for i in np.unique(np.searchsorted(ends, bad, "right")).tolist():
                out[i] = False
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        cut, size = [], 0

        def flush():
            nonlocal cut, size
            got = self._cut([x for _, x in cut]) if cut else []
            if got is None:
                got = self._whole([x for _, x in cut])
            for (i, _), x in zip(cut, got, strict=True):
                out[i] = x if out[i] is None else np.concatenate([out[i], x])
            cut, size = [], 0
        whole = []
        for i, (t, known) in enumerate(zip(texts, self._known(texts), strict=True)):
            if not known:
                whole.append(i)
                continue
            for part in _chunks(t):
                cut.append((i, part))
                size += len(part)
                if size >= CHUNK:
                    flush()
        flush()
        for i, got in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = got
        return out


_BETWEEN = re.compile("(?<=[^ \t\n\r])(?= [^ \t\n\r])")


def _chunks(text: str) -> Iterator[str]:
    """A long text in pieces, cut before blanks between words (always borders)."""
    while len(text) > 2 * CHUNK and (m := _BETWEEN.search(text, CHUNK)):
        yield text[:m.start()]
        text = text[m.start():]
    yield text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class WaveletMatrix:
    """Succinct sequence of ids: bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.bits = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for p in range(bits):
            one = (x & x.dtype.type(1 << (bits - 1 - p))) != 0
            packed = np.packbits(one, bitorder="little")
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes())
            left = np.compress(~one, x)
            zeros.append(len(left))
            x = np.concatenate((left, np.compress(one, x)))
        return cls(len(ids), zeros, planes, ranks)

    def _plane(self, p: int) -> np.ndarray:
        return np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)

    def tokens(self) -> np.ndarray:
        """All ids, undoing the stable partitions from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            one, z = self._plane(p), self.zeros[p]
            y = np.empty(self.n, kind)
            y[np.flatnonzero(~one)] = x[:z]
            y[np.flatnonzero(one)] = x[z:] | kind(1 << (self.bits - 1 - p))
            x = y
        return x.astype("<u4")

    def _ones(self, p: int, i: int) -> int:
        """One bits of plane p before position i."""
        b = i // BLOCK
        part = self.planes[p][b * (BLOCK // 8):i // 8]
        rest = int(self.planes[p][i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(self.ranks[p][b]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit = int(self.planes[p][i // 8]) >> (i % 8) & 1
            ones = self._ones(p, i)
            out = out << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Bounds of ``token``'s occurrences before position i in the lowest order."""
        lo, hi = 0, i
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position i."""
        lo, hi = self._range(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - p) & 1)
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def _select_bit(self, p: int, one: bool, k: int) -> int:
        before = self.ranks[p].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        block = np.unpackbits(self.planes[p][b * (BLOCK // 8):(b + 1) * (BLOCK // 8)], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(block == one)[k - int(before[b])])


def _schema(id_type: str) -> str:
    return (f"part int, seq int, before long, n long, doc_ids array<{id_type}>, lens array<long>, zeros array<long>, "
            "planes array<binary>, ranks array<binary>")


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode all rows of ``docs`` and write their shards below ``path``."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4")
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        bits = max(enc.bits, end_id.bit_length())
        ids, held, lens, size = [], [], [], 0  # of the shard that is being filled

        def shard() -> pa.RecordBatch:
            nonlocal ids, held, lens, size, seq, before
            x = np.concatenate(ids)
            w = WaveletMatrix.build(x, bits)
            keys = pa.concat_arrays(held)
            one = lambda v, t: pa.array([v], t)
            out = pa.RecordBatch.from_arrays([
                one(part, pa.int32()), one(seq, pa.int32()), one(before, pa.int64()), one(len(x), pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), one(lens, pa.list_(pa.int64())),
                one(w.zeros, pa.list_(pa.int64())), one([p.tobytes() for p in w.planes], pa.list_(pa.binary())),
                one([r.tobytes() for r in w.ranks], pa.list_(pa.binary()))],
                names=["part", "seq", "before", "n", "doc_ids", "lens", "zeros", "planes", "ranks"])
            seq, before, ids, held, lens, size = seq + 1, before + len(x), [], [], [], 0
            return out

        for b in slices(batches, 1 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            gc.disable()  # millions of strings and no cycles: nothing to find
            encoded = enc(texts)
            gc.enable()
            first = 0
            for i, got in enumerate(encoded, 1):
                ids += (got, end)
                lens.append(len(got) + 1)
                size += len(got) + 1
                if size >= shard_tokens:
                    held.append(b.column(0).slice(first, i - first))
                    first = i
                    yield shard()
            if first < len(encoded):
                held.append(b.column(0).slice(first))
        if ids:
            yield shard()

    rows.mapInArrow(run, _schema(id_type)).write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20}).parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store, each with ``base``: ids of all earlier parts."""
    s = spark.read.parquet(path)
    parts = s.groupBy("part").agg(F.sum("n").alias("n"))  # one row per writing task
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return s.join(F.broadcast(base), "part")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Read every document back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    s = shards(spark, path)
    id_type = s.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                x = _matrix(row).tokens()
                lens = row.column("lens")[0].values.to_numpy()
                ends = np.cumsum(lens)
                crc = [zlib.crc32(x[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                start = row.column("base")[0].as_py() + row.column("before")[0].as_py() + ends - lens
                yield pa.RecordBatch.from_arrays([row.column("doc_ids")[0].values, pa.array(start), pa.array(lens),
                                                  pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return (s.select("doc_ids", "lens", "before", "base", "n", "zeros", "planes", "ranks")
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def _matrix(row: pa.RecordBatch) -> WaveletMatrix:
    return WaveletMatrix(row.column("n")[0].as_py(), row.column("zeros")[0].as_py(), row.column("planes")[0].as_py(),
                         row.column("ranks")[0].as_py())


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``(part, seq, n)``: occurrences of ``token`` in each shard, from ranks alone."""
    def run(batches):
        for b in batches:
            n = [_matrix(b.slice(i, 1)).count(token) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), pa.array(n, pa.int64())], names=["part", "seq", "n"])
    return spark.read.parquet(path).select("part", "seq", "n", "zeros", "planes", "ranks").mapInArrow(run, "part int, seq int, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``(position)``: places of ``token`` in the whole id stream, by select."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                m = _matrix(row)
                at = row.column("base")[0].as_py() + row.column("before")[0].as_py()
                found = [at + m.select(token, k) for k in range(m.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["position"])
    return shards(spark, path).select("before", "base", "n", "zeros", "planes", "ranks").mapInArrow(run, "position long")


def store(docs: DataFrame, tokenizer: str, **options) -> str:
    """Write ``docs`` to a new store in the shared folder and return its path."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, **options)
    return path
