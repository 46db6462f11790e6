"""Line dedup with reversible state.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. State is two tables:

* ``counts`` (hi, lo, n): the exact number of documents that hold each key (a 128-bit
  BLAKE2b digest), the reference counts;
* ``filters`` (shard, n_keys, payload): one cuckoo filter per digest shard over the
  keys found in ``min_docs`` documents or more.

Inserting documents adds to the counts, deleting documents subtracts; a key that
crosses the threshold is inserted into, or deleted from, its shard's filter. So adding
documents and deleting them again gives the earlier decisions back.

Applying the state probes the filters first. Every key that passes by accident is
known, because the reference counts list all keys: probing the keys below the threshold
gives an exact list of exceptions, and filter minus exceptions is the exact drop set.
While filters and exceptions are below ``broadcast_bytes`` they are broadcast at once. Beyond
that the digests of the documents' lines are written once, cut by groups of filter shards, and
each group is probed in a pass of its own with its filters broadcast: filters decide at every
size, a pass holds ``broadcast_bytes`` of them, and a line that most documents hold is never
gathered in one task.

Defined cases: null and empty text are one empty line; an empty key is never dropped;
a document whose lines are all dropped keeps the empty text; every row is a document of
its own (repeated rows count again); an empty table gives an empty result; columns other
than the id and the text are not read; a very long text is split into its lines in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, join_side, scratch_path, slices, texts, written

BROADCAST_BYTES = 64 << 20
SHARD_KEYS = 50_000
SLOTS = 4
_KICKS = 500


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: ASCII white space and ASCII letters only


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; supports insert and delete. Keys are
    (hi, lo) halves of a digest: ``lo`` gives the bucket, ``hi`` the fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        f = cls.sized(len(hi))
        while not all(f.insert(h, l) for h, l in zip(hi.tolist(), lo.tolist(), strict=True)):
            f = cls(np.zeros((f.table.shape[0] * 2, SLOTS), np.uint32))
        return f

    def _places(self, hi, lo):
        hi, lo = np.atleast_1d(np.asarray(hi)).astype(np.uint64), np.atleast_1d(np.asarray(lo)).astype(np.uint64)
        mask = np.uint64(self.table.shape[0] - 1)
        fp = (hi >> np.uint64(32)).astype(np.uint32)
        fp[fp == 0] = 1
        a = _mix(lo) & mask
        return fp, a.astype(np.int64), ((a ^ _mix(fp.astype(np.uint64))) & mask).astype(np.int64)

    def insert(self, hi, lo) -> bool:
        """False if no place was found; the caller then rebuilds from the exact counts."""
        fp, a, b = (x[0] for x in self._places(hi, lo))
        for i in (a, b):
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = fp
                return True
        mask, i = self.table.shape[0] - 1, int(b)
        for k in range(_KICKS):
            slot = (int(fp) + k) % SLOTS
            fp, self.table[i, slot] = self.table[i, slot], fp
            i = (i ^ int(_mix(np.uint64([fp]))[0])) & mask
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = fp
                return True
        return False

    def delete(self, hi, lo) -> bool:
        fp, a, b = (x[0] for x in self._places(hi, lo))
        for i in (a, b):
            at = np.flatnonzero(self.table[i] == fp)
            if len(at):
                self.table[i, at[0]] = 0
                return True
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hi, lo)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, payload: bytes) -> CuckooFilter:
        return cls(np.frombuffer(payload, np.uint32).reshape(-1, SLOTS).copy())


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _count_batches(sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for t in texts(b.column(0)):
                keys = {line_key(x) for x in t.split(b"\n")}
                keys.discard(b"")
                found += map(digest, keys)
            if found:
                u, n = np.unique(np.frombuffer(b"".join(found), "V16"), return_counts=True)
                h = u.view("<u8").reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(sign * n)],
                                                 names=["hi", "lo", "n"])
    return run


def _counts(docs: DataFrame, text_col: str, sign: int = 1) -> DataFrame:
    return docs.select(col(text_col)).mapInArrow(_count_batches(sign), "hi long, lo long, n long")


def _shard(n_shards: int):
    return F.pmod(F.shiftright("lo", 32), F.lit(n_shards)).cast("int").alias("shard")


class LineIndex:
    """Reference counts and their cuckoo filters; see the module text."""

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, n_shards: int):
        self.counts, self.filters, self.min_docs, self.n_shards = counts, filters, min_docs, n_shards

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", min_docs: int = 10) -> LineIndex:
        counts = written(_counts(docs, text_col).groupBy("hi", "lo").agg(F.sum("n").alias("n")), "line-counts")
        return cls._filtered(counts, min_docs)

    @classmethod
    def _filtered(cls, counts: DataFrame, min_docs: int) -> LineIndex:
        heavy = counts.filter(F.col("n") >= min_docs)
        n_shards = max(1, -(-heavy.count() // SHARD_KEYS))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.of(pdf.hi.to_numpy().view(np.uint64), pdf.lo.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_keys": [len(pdf)], "payload": [f.to_bytes()]})

        filters = (heavy.select("hi", "lo", _shard(n_shards)).groupBy("shard")
                   .applyInPandas(build, "shard int, n_keys long, payload binary"))
        return cls(counts, written(filters, "line-filters"), min_docs, n_shards)

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None,
               text_col: str = "text") -> LineIndex:
        """Insert and delete documents: counts are summed, and each filter takes the
        keys that crossed the threshold upwards and gives back those that fell below."""
        delta = None
        for docs, sign in ((added, 1), (removed, -1)):
            if docs is not None:
                part = _counts(docs, text_col, sign)
                delta = part if delta is None else delta.unionByName(part)
        if delta is None:
            return self
        both = (self.counts.select("hi", "lo", "n", F.lit(0).cast("long").alias("d"))
                .unionByName(delta.select("hi", "lo", F.lit(0).cast("long").alias("n"), F.col("n").alias("d")))
                .groupBy("hi", "lo").agg(F.sum("n").alias("n0"), F.sum("d").alias("d")))
        both = written(both.select("hi", "lo", "n0", (F.col("n0") + F.col("d")).alias("n")), "line-update")
        k = self.min_docs
        moved = both.filter((F.col("n0") < k) != (F.col("n") < k)).select("hi", "lo", "n", _shard(self.n_shards))

        def change(key, old: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old.payload.iloc[0]) if len(old) else CuckooFilter.sized(SLOTS)
            n, fits = int(old.n_keys.iloc[0]) if len(old) else 0, True
            for h, l, c in zip(delta.hi.to_numpy().view(np.uint64).tolist(), delta.lo.to_numpy().view(np.uint64).tolist(),
                               delta.n.tolist(), strict=True):
                if c >= k:
                    fits, n = fits and f.insert(h, l), n + 1
                else:
                    f.delete(h, l)
                    n -= 1
            return pd.DataFrame({"shard": [int(key[0])], "n_keys": [n], "payload": [f.to_bytes() if fits else b""]})

        filters = written(self.filters.groupBy("shard").cogroup(moved.groupBy("shard"))
                          .applyInPandas(change, "shard int, n_keys long, payload binary"), "line-filters")
        counts = both.filter(F.col("n") != 0).select("hi", "lo", "n")
        if filters.filter((F.length("payload") == 0) | (F.col("n_keys") > 4 * SHARD_KEYS)).limit(1).count():
            return LineIndex._filtered(counts, k)  # a full filter: build all anew from the exact counts
        return LineIndex(counts, filters, k, self.n_shards)

    def _drop_set(self, bound: int):
        """(filters by shard, exceptions) as broadcasts, or None if they exceed the bound."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
        if size > bound:
            return None
        sc = self.counts.sparkSession.sparkContext
        tables = sc.broadcast({r["shard"]: bytes(r["payload"]) for r in self.filters.collect()})  # <= bound bytes
        wrong = self._accidental(tables).limit(bound // 16 + 1).collect()
        if len(wrong) > bound // 16:
            return None
        exceptions = sc.broadcast({(r["hi"] & (2**64 - 1), r["lo"] & (2**64 - 1)) for r in wrong})
        return tables, exceptions

    def _accidental(self, tables, group=None) -> DataFrame:
        """Keys below the threshold that pass the broadcast filters (of one group of shards)."""
        light = self.counts.filter(F.col("n") < self.min_docs)
        if group is not None:
            light = light.filter(group)
        return light.select("hi", "lo").mapInArrow(_passing(_prober(tables, self.n_shards)), "hi long, lo long")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``(doc_id, n_lines, n_dropped, kept_text)`` of every row of ``docs``."""
        out = "doc_id {}, n_lines long, n_dropped long, kept_text string".format(docs.schema[id_col].dataType.simpleString())
        rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
        found = self._drop_set(broadcast_bytes)
        if found is not None:
            tables, exceptions = found
            probe = _prober(tables, self.n_shards)

            def run(batches):
                for b in slices(batches):
                    yield _kept(b, lambda h: probe(h[:, 0], h[:, 1]), exceptions.value)
            return rows.mapInArrow(run, out)
        return self._in_passes(rows, broadcast_bytes).mapInArrow(_kept_exactly, out)

    def _in_passes(self, rows: DataFrame, bound: int) -> DataFrame:
        """``(doc_id, text, drops)``: the keys of each row that its filters keep out, found group
        of shards by group of shards."""
        spark = rows.sparkSession
        rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "line-rows")  # fixes the row numbers
        sizes = self.filters.agg(F.max(F.length("payload")).alias("most")).first()
        per_pass = max(1, bound // max(1, sizes["most"] or 1))
        of = F.floor(F.pmod(F.shiftright("lo", 32), F.lit(self.n_shards)) / per_pass).cast("int")
        path = scratch_path(spark, "line-digests")
        (rows.select("rid", "text").mapInArrow(_digest_batches, "rid long, hi long, lo long").withColumn("pass", of)
         .write.partitionBy("pass").parquet(path))
        found = None
        for k in range(-(-self.n_shards // per_pass)):
            own = self.filters.filter(F.floor(F.col("shard") / per_pass) == k)
            tables = spark.sparkContext.broadcast({r["shard"]: bytes(r["payload"]) for r in own.collect()})  # <= bound bytes, or one filter
            lines = spark.read.schema("rid long, hi long, lo long, pass int").parquet(path).filter(F.col("pass") == k).drop("pass")
            passed = lines.mapInArrow(_passing(_prober(tables, self.n_shards)), "rid long, hi long, lo long")
            wrong = written(self._accidental(tables, of == k), "line-exceptions")
            passed = written(passed.join(join_side(wrong, 32), ["hi", "lo"], "left_anti"), "line-drops")
            found = passed if found is None else found.unionByName(passed)
        drops = found.groupBy("rid").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))  # at most the lines of a text
        return rows.join(drops, "rid", "left").select("doc_id", "text", "drops")


def _passing(probe):
    """Rows whose digest (hi, lo) passes the filters."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(probe(*(b.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("hi", "lo")))))
    return run


def _kept_exactly(batches):
    for b in slices(batches):
        sets = [{(x["hi"] & (2**64 - 1), x["lo"] & (2**64 - 1)) for x in (r or [])} for r in b.column(2).to_pylist()]
        yield _kept(b, None, None, sets)


def _prober(tables, n_shards: int):
    filters: dict[int, CuckooFilter] = {}

    def probe(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        if not tables.value:
            return out
        if not filters:
            filters.update({s: CuckooFilter.from_bytes(p) for s, p in tables.value.items()})
        shard = (lo.view(np.int64) >> 32) % n_shards
        for s in np.unique(shard):
            if int(s) in filters:
                at = np.flatnonzero(shard == s)
                out[at] = filters[int(s)].contains(hi[at], lo[at])
        return out
    return probe


def _digest_batches(batches):
    """``(rid, hi, lo)`` of the distinct lines of every text."""
    for b in slices(batches):
        rows, found = [], []
        for i, t in enumerate(texts(b.column(1))):
            keys = {line_key(x) for x in t.split(b"\n")}
            keys.discard(b"")
            rows += [i] * len(keys)
            found += map(digest, keys)
        h = _halves(found).view(np.int64) if found else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["rid", "hi", "lo"])


def _kept(b: pa.RecordBatch, probe, exceptions, sets=None) -> pa.RecordBatch:
    lines = [t.split(b"\n") for t in texts(b.column(1))]
    keys = [line_key(x) for ls in lines for x in ls]
    h = _halves([digest(k) for k in keys])
    pairs = list(zip(h[:, 0].tolist(), h[:, 1].tolist(), strict=True))
    if sets is None:
        drop = probe(h)
        drop &= np.fromiter((p not in exceptions for p in pairs), bool, len(pairs)) if exceptions else True
    else:
        owner = (s for s, ls in zip(sets, lines, strict=True) for _ in ls)
        drop = np.fromiter((p in s for p, s in zip(pairs, owner, strict=True)), bool, len(pairs))
    drop &= np.fromiter((len(k) > 0 for k in keys), bool, len(keys))
    kept, n_drop, at = [], [], 0
    for ls in lines:
        d = drop[at:at + len(ls)]
        at += len(ls)
        n_drop.append(int(d.sum()))
        kept.append(b"\n".join([x for x, gone in zip(ls, d, strict=True) if not gone] if n_drop[-1] else ls))
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.array([len(ls) for ls in lines], pa.int64()), pa.array(n_drop, pa.int64()),
         pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])
