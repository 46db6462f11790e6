"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are put in a fixed random order by a hash of their ids and cut
into ``BINS`` hash bins, its blocks. A source's stream is its blocks once, twice and a
third time; it takes the stream up to its target (a document is taken if its middle lies
below the target), so its exact quota is a number of stream blocks, the last one cut.
The tree starts with all quotas at its root; every node splits its quotas between its two
halves of the output shards by one multivariate hypergeometric draw, so each leaf (shard)
holds an exact number of blocks of every source, as if all blocks had been dealt at
random. A shard takes a run of stream blocks of each source (runs are disjoint and blocks
are already permuted) and shuffles its rows by hash.

Targets: source i in code-point order (null last) weighs 1, 2, 3, 1, ...; all sources
share ``share`` of all sizes; a target stops at ``MAX_REPEAT`` times its source's size and
the excess is shared again by weight until none is above.

Shuffles move ids and sizes only. Rows meet the block table on (source, bin), which cuts
a source with a third of all rows into ``BINS`` keys. A tree node is one group of one row
per source.

Defined cases: null text has size 0; the null source is a source of its own, last in
order; rows that repeat an id are documents of their own; sources of size 0 get target
0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import col, join_side, words, written

BINS = 4096
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
SHARD_WORDS = 4_000_000
SEED = 8
_HASH_BITS = 52


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = SEED, keep=()) -> DataFrame:
    """``(doc_id, key, size, h, bin)``: words, order hash and block of every row."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(key), 1, _HASH_BITS // 4), 16, 10).cast("long")
    src = col(source_col).cast("string")
    df = docs.select(col(id_col).alias("doc_id"), F.when(src.isNull(), "1").otherwise(F.concat(F.lit("0"), src)).alias("key"),
                     F.size(words(col(text_col))).cast("long").alias("size"), h.alias("h"), *keep)
    return df.withColumn("bin", F.shiftright("h", _HASH_BITS - (BINS - 1).bit_length()).cast("int"))


def targets(blocks: DataFrame, share: float = 1.0) -> DataFrame:
    """``(key, source_size, target)``; keys sort as the sources' code points, null last."""
    src = blocks.groupBy("key").agg(F.sum("words").alias("source_size"))
    ranked = written(global_rank(src, ["key"], out="rank").withColumn(
        "w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))), "sources")
    cap = MAX_REPEAT * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:  # each round adds sources to the capped ones; ends when none is added
        over = F.lit(False) if capped is None else F.lit(level) * F.col("w") > cap
        r = ranked.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap)).alias("c"),
                       F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - (r["c"] or 0)) / r["w"]
    over = F.lit(level) * F.col("w") > cap
    return ranked.select("key", "source_size", F.when(over, cap.cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def split_quotas(quotas: DataFrame, total: int, n_shards: int, seed: int = SEED) -> DataFrame:
    """``(key, shard, lo, hi)``: the run of stream blocks each shard takes of each source,
    from ``(key, quota)``. One level of the tree per round; all nodes of a level in parallel."""
    level = quotas.select(F.lit(0).alias("first"), F.lit(n_shards).alias("n"), "key", F.lit(0).cast("long").alias("lo"),
                          F.col("quota").alias("hi"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        first, n = int(pdf["first"].iloc[0]), int(pdf["n"].iloc[0])
        if n == 1:
            return pdf
        pdf = pdf.sort_values("key", ignore_index=True)
        left = n // 2
        size = total * (first + left) // n_shards - total * first // n_shards
        have = (pdf.hi - pdf.lo).to_numpy()
        rng = np.random.default_rng([seed, first, n])
        mid = pdf.lo.to_numpy() + rng.multivariate_hypergeometric(have, size, method="marginals")
        halves = [pdf.assign(n=left, hi=mid), pdf.assign(first=first + left, n=n - left, lo=mid)]
        out = pd.concat(halves, ignore_index=True)
        return out[out.hi > out.lo]

    kind = "first int, n int, key string, lo long, hi long"
    for _ in range(max(0, n_shards - 1).bit_length()):
        level = level.groupBy("first", "n").applyInPandas(split, kind)
    return level.select("key", F.col("first").alias("shard"), "lo", "hi")


def plan(rows: DataFrame, share: float = 1.0, n_shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``draws`` (epoch and shard of every time the
    row is taken) to the rows of :func:`sized`."""
    blocks = written(rows.groupBy("key", "bin").agg(F.sum("size").alias("words")), "blocks")
    goal = written(targets(blocks, share), "targets")
    w = Window.partitionBy("key").orderBy("bin")
    at = (blocks.join(join_side(goal, 100), "key")
          .withColumn("rank", F.row_number().over(w) - 1)
          .withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("key"))))
    stream = (at.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_REPEAT)])))
              .filter(F.col("epoch") * F.col("source_size") + F.col("before") < F.col("target"))
              .withColumn("v", F.col("epoch") * F.col("n_blocks") + F.col("rank")))
    stream = written(stream.select("key", "bin", "epoch", "v"), "stream")
    total = stream.count()
    if n_shards is None:
        n_shards = max(1, -(-(goal.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS))
    quotas = stream.groupBy("key").agg(F.count(F.lit(1)).alias("quota"))
    runs = split_quotas(quotas, total, n_shards, seed)
    dealt = runs.select("key", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("v"))
    per = (dealt.join(join_side(stream, 120), ["key", "v"]).groupBy("key", "bin")
           .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("taken")))  # MAX_REPEAT entries at most
    table = written(at.select("key", "bin", "before", "source_size", "target").join(per, ["key", "bin"], "left"), "block-draws")
    inside = Window.partitionBy("key", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(join_side(table, 250), ["key", "bin"]))
    middle = F.col("before") + F.col("inside") + F.col("size") / 2
    return both.withColumn("draws", F.filter(F.coalesce("taken", F.array().cast("array<struct<epoch:int,shard:int>>")),
                                             lambda d: d["epoch"] * F.col("source_size") + middle <= F.col("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0,
        n_shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, draws, taken)`` of every row."""
    rows = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    out = plan(rows, share, n_shards, seed)
    return out.select("doc_id", "size", "source_size", "target", "draws", (F.size("draws") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    share: float = 1.0, n_shards: int | None = None, seed: int = SEED, ordered: bool = True) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it. ``ordered``:
    one partition per output shard, shuffled locally; else in no set order."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows, "rows")  # fixes the row numbers
    names = {"id_col": "i", "text_col": "t", "source_col": "s"}
    flat = rows.select("rid", F.col("row")[id_col].alias("i"), F.col("row")[text_col].alias("t"), F.col("row")[source_col].alias("s"))
    small = written(sized(flat, **names, seed=seed, keep=["rid"]), "sizes")
    drawn = (plan(small, share, n_shards, seed).filter(F.size("draws") > 0)
             .select(F.col("rid").alias("r"), F.explode("draws").alias("d")))
    out = rows.join(drawn, F.col("rid") == F.col("r"))
    if not ordered:
        return out.select("row.*")
    shards = out.withColumn("shard", F.col("d.shard")).withColumn("o", F.xxhash64(F.lit(seed), "rid", F.col("d.epoch")))
    return shards.repartition("shard").sortWithinPartitions("shard", "o").select("row.*")
