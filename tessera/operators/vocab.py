"""Vocabularies, bag-of-words, document frequencies and id encoding.

Token input is always the long table ``(doc_id, [sent,] pos, word)``. A vocabulary
capped by ``max_features`` is a top-k report (TakeOrderedAndProject); an uncapped one is
ranked with the distributed rank. Joins of tokens with a vocabulary are salted, since few
words hold most tokens, and carry no hint.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import stored
from .ranking import global_rank
from .tokens import held_one_by_one, in_one, item_counts, lookup, looked_up, parted_by_repeats, rounds, salted_join, shared_groups, word_freq


def build_vocab(tokens: DataFrame, max_features: int | None = None, word: str = "word",
                first_id: int = 0) -> DataFrame:
    """``(word, n, word_id)``: the ``max_features`` most frequent words (count desc,
    word asc); ids follow alphabetical word order, starting at ``first_id``."""
    freq = word_freq(tokens, word)
    if max_features is not None:
        top = freq.orderBy(F.col("n").desc(), F.col(word)).limit(max_features)
        w = Window.orderBy(word)  # at most max_features rows
        return top.withColumn("word_id", (F.row_number().over(w) - 1 + first_id).cast("int"))
    ranked = global_rank(freq, [F.col(word)], out="word_id")
    return ranked.withColumn("word_id", (F.col("word_id") + first_id).cast("int"))


def bow(tokens: DataFrame, vocab: DataFrame, max_features: int | None = None,
        key: str = "doc_id", word: str = "word") -> DataFrame:
    """Sparse document x term counts ``(key, word_id, n)`` over a vocabulary. Tokens are
    counted by (document, word) first; the join with the vocabulary is salted and unhinted
    (a small vocabulary is broadcast by the planner's own size check)."""
    counts = tokens.groupBy(key, word).agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(counts, vocab.select(word, "word_id"), word, "inner", key)
    return out.select(key, "word_id", "n")


def list_bow(lists: DataFrame, vocab: DataFrame, key: str = "doc_id", column: str = "t", word: str = "word") -> DataFrame:
    """``(key, word_id, n, total)``: :func:`bow` of word lists, counted in their row, with the row
    sum ``total``. Only counts of rows that share a key are shuffled."""
    def counts(rows):
        ids = looked_up(rows.select(key, column), column, vocab, word, "word_id", "ids").select(key, F.array_compact("ids").alias("ids"))
        return item_counts(ids.select(key, F.size("ids").cast("long").alias("total"), "ids"), "ids", "word_id", "n").select(key, "word_id", "n", "total")
    vocab = stored(vocab.select(word, "word_id"), "vocabulary")  # read in every pass
    once, again = parted_by_repeats(lists.select(key, column), key)
    if again is None:
        return counts(once)
    added = counts(again).groupBy(key, "word_id").agg(F.sum("n").alias("n"))
    return counts(once).unionByName(added.withColumn("total", F.sum("n").over(Window.partitionBy(key))))


def doc_freq(tokens: DataFrame, key: str = "doc_id", word: str = "word") -> DataFrame:
    """``(word, df)``: number of documents containing the word (binary counting).
    Deduplicate (doc, word) first so the shuffle carries one row per pair."""
    return (tokens.select(key, word).distinct().groupBy(word)
            .agg(F.count(F.lit(1)).alias("df")))


def idf(tokens: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
        key: str = "doc_id", word: str = "word") -> DataFrame:
    """Smoothed inverse document frequency ln((1+n)/(1+df)) + 1 over the terms with
    min_df <= df <= max_df * n (max_df as a share of documents when < 1)."""
    return smoothed_idf(doc_freq(tokens, key, word), n_docs, min_df, max_df)


def smoothed_idf(df: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """:func:`idf` of the document frequencies ``df (word, df)``."""
    max_count = max_df * n_docs if isinstance(max_df, float) and max_df <= 1.0 else max_df
    d = df.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_count)))
    return d.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0)


def list_doc_freq(lists: DataFrame, key: str = "doc_id", column: str = "t", word: str = "word") -> DataFrame:
    """:func:`doc_freq` of word lists, a row's words made distinct in the row; only the words of
    rows that share a key are shuffled with their key."""
    each = lambda df, *more: df.select(*more, F.explode(F.array_distinct(column)).alias(word))
    once, again = parted_by_repeats(lists.select(key, column), key)
    words = each(once)
    if again is not None:
        words = words.unionByName(each(again, key).distinct().select(word))
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("df"))


def max_idf(idf_table: DataFrame) -> float:
    row = idf_table.agg(F.max("idf").alias("m")).first()
    return float(row["m"]) if row and row["m"] is not None else 1.0 + math.log(1.0)


def encode_ids(tokens: DataFrame, vocab: DataFrame, word: str = "word", oov: int = 0, key: str = "doc_id") -> DataFrame:
    """Word -> id (unknown words -> ``oov``), all token columns kept."""
    return (salted_join(tokens, vocab.select(word, "word_id"), word, "left", key)
            .withColumn("word_id", F.coalesce(F.col("word_id"), F.lit(oov)).cast("int")))


def encoded_lists(lists: DataFrame, vocab: DataFrame, word: str = "word", oov: int = 0, key: str = "doc_id",
                  column: str = "t") -> DataFrame:
    """``(key, ids)``, one row per key: :func:`encode_ids` of the word lists ``column`` in their row.
    The tokens of rows that share a key are put in order of (position, id); only these are shuffled."""
    def encoded(rows):
        ids = looked_up(rows.select(key, column), column, vocab, word, "word_id", "ids")
        return ids.select(key, F.transform("ids", lambda x: F.coalesce(x, F.lit(oov)).cast("int")).alias("ids"))
    once, again = parted_by_repeats(lists, key)
    if again is None:
        return encoded(once)
    placed = encoded(again).select(key, F.transform("ids", lambda x, i: F.struct(i.alias("pos"), x.alias("id"))).alias("s"))
    gathered = placed.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return encoded(once).unionByName(gathered.select(key, F.transform("s", lambda x: x["id"]).alias("ids")))


def nested_ids(encoded: DataFrame, key: str = "doc_id", sent: str = "sent", pos: str = "pos") -> DataFrame:
    """``(key, ids array<array<int>>)``: each document's sentences as id lists, in order
    (sentences without a kept word are left out)."""
    by_sent = (encoded.groupBy(key, sent).agg(F.array_sort(F.collect_list(F.struct(pos, "word_id"))).alias("s"))
               .select(key, sent, F.transform("s", lambda x: x["word_id"]).alias("s")))
    return (by_sent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(sent, "s"))).alias("d"))
            .select(key, F.transform("d", lambda x: x["s"]).alias("ids")))


def printed(ids) -> F.Column:
    """``[[1, 2], [3]]``: the stored text form of nested ids."""
    one = F.transform(ids, lambda s: F.concat(F.lit("["), F.array_join(s.cast("array<string>"), ", "), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))


def padded(ids, length: int, pad: int = 0) -> F.Column:
    """An id list cut or filled up to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def padded_text(ids, length: int, pad: int = 0) -> F.Column:
    """:func:`padded` as text, the ids separated by spaces. The padding is one repeated string, not an
    array as long as the longest document."""
    ids = F.slice(F.col(ids) if isinstance(ids, str) else ids, 1, length)
    tail = F.repeat(F.lit(f" {pad}"), F.lit(length) - F.size(ids))
    text = F.concat(F.array_join(ids.cast("array<string>"), " "), tail)
    return F.when(F.size(ids) > 0, text).otherwise(F.ltrim(tail))


def row_normalize(counts: DataFrame, key: str = "doc_id", value: str = "n", total: str | None = None) -> DataFrame:
    """Divide each entry by its row sum (zero-sum rows give 0): the column ``total``, if there is
    one, else summed and joined. Entries without a key have no row."""
    if total:
        rows = counts.filter(F.col(key).isNotNull()).withColumnRenamed(total, "_s")
    else:
        rows = counts.join(counts.groupBy(key).agg(F.sum(value).alias("_s")), key)
    return (rows.withColumn("v", F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_s")), F.lit(0.0)))
            .drop("_s"))


def first_seen_vocab(tokens: DataFrame, order=("doc_id", "pos"), word: str = "word") -> DataFrame:
    """Ids by first appearance (1-based; 0 is reserved for unknown words)."""
    first = tokens.groupBy(word).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = global_rank(first, [F.col("_first")] + [F.col(word)], out="word_id")
    return ranked.select(word, (F.col("word_id") + 1).cast("int").alias("word_id"))


# ---------------------------------------------------------------------------
# Sums of word vectors in the document's row.
# ---------------------------------------------------------------------------

VECTOR_ROWS = 1 << 16
VECTOR_TOKENS = 1 << 15


def mean_vectors(lists: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id", column: str = "t") -> DataFrame:
    """``(key, vec)`` for every row of ``lists (key, column)``: the mean of the vectors of its words
    ``vectors (word, vec_id, vec)``, repeats counted; zeros if it has none. A word with several
    vectors counts once for each; rows that share a key share the mean over all of them; a row
    without a key has zeros.

    No token is shuffled: words become ids in their row, and the vectors are broadcast in groups of
    ``VECTOR_ROWS``; a task takes these one after another and adds their part to the rows' sums."""
    known = vectors.filter(F.col("vec").isNotNull()).select("word", "vec_id", F.col("vec").cast("array<double>").alias("vec"))
    table = stored(known.groupBy("word", "vec_id").agg(Summarizer.sum(array_to_vector("vec")).alias("s"), F.count(F.lit(1)).alias("n"))
                   .select("word", "vec_id", F.concat(vector_to_array("s"), F.array(F.col("n").cast("double"))).alias("vec")), "vector-sums")
    groups, d = list(shared_groups(table, "vec_id", "vec", VECTOR_ROWS)), dim + 1  # the last number is the count
    ids = lookup(column, table, "word", "vec_id", "ids")

    def added(batches):
        for b in rounds((x.select([key, "ids"]) for x in batches), groups):
            acc = np.zeros((b.num_rows, d))
            of_token = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            for keys, vecs in held_one_by_one(groups):
                matrix = vecs.flatten().to_numpy().reshape(-1, d)
                at = pc.index_in(b.column(1).flatten(), value_set=keys)
                every = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                at = at.take(pa.array(every)).to_numpy()
                for i in range(0, len(every), VECTOR_TOKENS):
                    row = of_token[every[i:i + VECTOR_TOKENS]]
                    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    acc[row[start]] += np.add.reduceat(matrix[at[i:i + VECTOR_TOKENS]], start)
            ends = pa.array(np.arange(0, b.num_rows * d + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(acc.ravel()))], names=[key, "acc"])

    def sums(rows):
        return in_one(rows.select(key, column), ids, lambda schema: (added, ST.StructType([schema[key], ST.StructField("acc", ST.ArrayType(ST.DoubleType()))])))

    def mean(rows):
        count = F.element_at("acc", d)
        some = F.col(key).isNotNull() & (F.coalesce(count, F.lit(0.0)) > 0)
        return rows.select(key, F.when(some, F.transform(F.slice("acc", 1, dim), lambda x: x / count))
                           .otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vec"))
    once, again = parted_by_repeats(lists, key)
    if again is None:
        return mean(sums(once))
    total = sums(again).groupBy(key).agg(Summarizer.sum(array_to_vector("acc")).alias("s")).select(key, vector_to_array("s").alias("acc"))
    return mean(sums(once)).unionByName(mean(again.select(key).join(total, key, "left")))
