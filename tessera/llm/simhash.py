"""SimHash near-dedup by tiled exact comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit is 1 if it
is set in over half of them. Distinct fingerprints are put into tiles by the population
counts of their four 16-bit parts. Two fingerprints within ``radius`` bits differ by at
most ``radius`` in the sum of these four counts' distances, so only tile pairs within
that distance are compared, all others are skipped; a tile pair is compared whole with
numpy exclusive-or and bit counts. Tiles are cut into pieces of ``TILE`` fingerprints,
so a crowded tile becomes many rows. Each compared pair of pieces returns a spanning
forest of its links (never all pairs), and components come from min-label rounds of
large-star and small-star steps, whose lineage is cut by written tables.

Defined cases: null and empty text have fingerprint 0 and link like any other; fewer
words than the shingle length are one shingle; documents with equal fingerprints are
one component; a null id never names a component that has other ids; repeated rows are
returned again; an empty table gives an empty result; other columns are not read; a very long
text is hashed whole, one row at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices, texts, written

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 2048
BROADCAST_BYTES = 64 << 20
PARTS = 4
_BITS = 64 // PARTS


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text, A-Z lower-cased."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    k = min(shingle, len(w))
    starts = np.concatenate(([0], ends[:len(w) - k])).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist(), strict=True)),
                         np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **more) -> DataFrame:
    """``(doc_id, fp long)`` of every row, and the columns ``more``."""
    names = ["doc_id", "fp", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=names)
    given = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), *[c.alias(n) for n, c in more.items()])
    kinds = [f"doc_id {docs.schema[id_col].dataType.simpleString()}", "fp long", *[f"{n} {given.schema[n].dataType.simpleString()}" for n in more]]
    return given.mapInArrow(run, ", ".join(kinds))


def _near_keys(radius: int):
    """Offsets between tile keys to compare: the zero offset, and of each opposite pair
    the one that is greater (each pair of tiles is met once)."""
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * PARTS]


def _key(counts) -> F.Column:
    k = F.lit(0)
    for c in counts:
        k = k * 64 + c
    return k.cast("int")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` bits between two pieces, thinned to a spanning forest."""
    nodes = np.unique(np.concatenate([a, b]))
    label = np.arange(len(nodes))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    for i in range(0, len(a), 256):
        r, c = np.nonzero(np.bitwise_count(a[i:i + 256, None] ^ b[None, :]) <= radius)
        u, v = ia[i + r], ib[c]
        while len(u):  # min-label until this block's links join equal labels
            lu, lv = label[u], label[v]
            open_ = lu != lv
            if not open_.any():
                break
            u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints whose closure is the closure of
    all links within ``radius`` bits."""
    parts = [F.bit_count(F.shiftrightunsigned("fp", _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1))) for i in range(PARTS)]
    own = (fps.select("fp").distinct().withColumn("p", F.array(*parts))
           .withColumn("piece", F.pmod(F.xxhash64("fp"), F.lit(1 << 20))))
    sizes = own.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    pieces = (own.join(sizes, "p").withColumn("piece", F.pmod("piece", F.ceil(F.col("n") / TILE)))
              .groupBy("p", "piece").agg(F.sort_array(F.collect_list("fp")).alias("fps")))  # about TILE longs
    pieces = written(pieces.withColumn("key", _key([F.col("p")[i] for i in range(PARTS)])), "tiles")
    near = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _near_keys(radius)])
    to = pieces.select("fps", "key", "piece", F.explode(F.transform(near, lambda d: F.zip_with("p", d, lambda x, y: x + y))).alias("q"))
    to = to.filter(F.forall("q", lambda x: (x >= 0) & (x <= _BITS)))
    to = to.select(F.col("fps").alias("a"), F.col("key").alias("ka"), F.col("piece").alias("pa"),
                   _key([F.col("q")[i] for i in range(PARTS)]).alias("key"))
    # a crowded tile's pieces are met in about as many groups as its pieces have square roots, so
    # no task holds all pairs of a tile; there are at most (_BITS + 1) ** PARTS tiles
    crowd = F.broadcast(pieces.groupBy("key").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("groups")))
    to = to.join(crowd, "key").withColumn("group", F.pmod("pa", "groups"))
    own_side = pieces.join(crowd, "key").select("key", F.col("piece").alias("pb"), F.col("fps").alias("b"),
                                                F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    pairs = (to.join(own_side, ["key", "group"])
             .filter((F.col("ka") != F.col("key")) | (F.col("pa") <= F.col("pb"))))

    def compare(batches):
        for batch in slices(batches):
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                u, v = _forest(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])
    return pairs.select("a", "b").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: alternating large-star
    and small-star rounds until nothing changes; root is the smallest node."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if not e.limit(1).count():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(max_rounds):
        near = both(e)  # large-star: larger neighbours go to the smallest of the neighbourhood
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = near.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))  # small-star: smaller neighbours too
        e = (e.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                     F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        e = written(e, "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def roots(by_fp: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, ..., root)`` of distinct fingerprints: the smallest that links lead to."""
    comp = components(links(by_fp, radius))
    return by_fp.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; component_id is the smallest doc_id
    that links lead to."""
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    joined = roots(written(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints"), radius)
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    label = written(joined.select("fp", "root").join(lows, "root").select("fp", "component_id"), "labels")
    return own.join(label, "fp").select("doc_id", "fp", "component_id")


def row_key(id_col: str, text_col: str) -> dict[str, F.Column]:
    """128 bits ``(h1, h2)`` of a row's id and text: rows that agree in both are one document."""
    i, t = col(id_col), col(text_col)
    null = F.concat(i.isNull().cast("string"), t.isNull().cast("string"))
    return {"h1": F.xxhash64(null, i, t), "h2": F.xxhash64(t, F.lit("\n"), i, null)}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each component: that with the smallest id
    (a null id comes last; ties go by a hash of id and text). Rows that agree in id and text
    are one document, and one of them stays; rows that share an id but not the text are
    documents of their own.

    Documents that go (and those that come again) are broadcast while they are below
    ``broadcast_bytes``, so texts stay where they are; beyond that documents and decisions
    are joined by a shuffle."""
    key = row_key(id_col, text_col)
    own = fingerprints(docs, id_col, text_col, shingle, **key)
    own = written(own.groupBy("doc_id", "fp", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    label = roots(written(own.groupBy("fp").agg(F.min(rank).alias("low")), "distinct-fingerprints"), radius)
    first = written(label.groupBy("root").agg(F.min("low").alias("low")).select("low.h1", "low.h2").withColumn("stays", F.lit(True)), "first-rows")
    per = written(own.join(first, ["h1", "h2"], "left").select("h1", "h2", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "decisions")
    gone = per.filter(~F.col("stays") | (F.col("n") > 1)).select("h1", "h2")
    often = per.filter(F.col("stays") & (F.col("n") > 1)).select("h1", "h2")
    small = lambda keys: F.broadcast(keys) if 32 * keys.count() <= broadcast_bytes else keys
    packed = docs.select(*[c.alias(n) for n, c in key.items()], F.struct(*[col(c) for c in docs.columns]).alias("row"))
    out = packed.join(small(gone), ["h1", "h2"], "left_anti").select("row.*")
    if not often.limit(1).count():
        return out
    again = packed.join(small(often), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return out.unionByName(again.select("row.*"))
