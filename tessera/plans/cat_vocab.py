"""Catalogue: corpus statistics, vocabularies, bag-of-words, IDF, id encoding and
word-vector features over ``documents`` (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.hashing import uniform, uniform_sql
from ..functions import text as T
from ..operators import tokens as TK
from ..operators import vocab as V
from ..session import stored
from ..tables import spread, table
from .documents import clean_document, clean_document_sql, clean_vocab, encoded_documents
from .registry import register
from .tasks import (CORPUS_TOKENS_SQL, LANG_TASK_SQL, WORD_VECTORS_SQL, corpus_tokens, lang_task,
                    word_vectors)

VOCAB_SIZE = 800
VECTOR_DIM = 64
CD = clean_document_sql()


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _raw_tokens(spark, sf_dir):
    return TK.sentence_tokens(TK.sentence_table(_docs(spark, sf_dir)))


@register("word_freq", sql=f"WITH {CD} SELECT word, n FROM cd_freq")
def word_freq_q(spark, sf_dir):
    return TK.word_freq(_raw_tokens(spark, sf_dir))


@register("high_bar", sql=f"""WITH {CD}
SELECT (SELECT bar FROM cd_bar) AS bar,
       (SELECT count(DISTINCT word) FROM cd_kept) AS n_kept_words""")
def high_bar_q(spark, sf_dir):
    """The bar and the number of words that pass it, from the word counts alone."""
    freq = TK.word_freq(_raw_tokens(spark, sf_dir))
    from ..session import cut_lineage
    freq = cut_lineage(freq)  # read twice
    bar = TK.frequency_bar(freq, 10)
    stop = set(R.ENGLISH_STOP_WORDS) | set(R.NEWSGROUP_EXTRA_STOP_WORDS)
    return (TK.kept_words(freq, stop, 5, bar).agg(F.count(F.lit(1)).alias("n_kept_words"))
            .select(F.lit(bar).cast("bigint").alias("bar"), "n_kept_words"))


@register("truncate_doc", sql=f"""WITH {CD}
SELECT a.doc_id, CAST(a.n_sent_total AS BIGINT) AS n_sent_total, CAST(b.n_sent_kept AS BIGINT) AS n_sent_kept,
       CAST(b.n_words_kept AS BIGINT) AS n_words_kept
FROM (SELECT doc_id, count(*) AS n_sent_total FROM cd_scount GROUP BY doc_id) a
JOIN (SELECT doc_id, count(*) AS n_sent_kept, sum(n_kept) AS n_words_kept FROM cd_sent GROUP BY doc_id) b
  ON a.doc_id = b.doc_id""")
def truncate_doc_q(spark, sf_dir):
    cc = clean_document(_docs(spark, sf_dir))
    total = (cc.lists.filter(F.size("t") > 0).groupBy("doc_id")
             .agg(F.sum(F.size("t")).alias("n_sent_total")))
    kept = cc.documents.filter(F.size("sents") > 0).select(
        "doc_id", F.size("sents").cast("bigint").alias("n_sent_kept"),
        F.aggregate("n_kept", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_words_kept"))
    return total.join(kept, "doc_id")


@register("doc_stats", sql=f"""WITH {CD},
per_doc AS (SELECT doc_id, count(*) AS ns FROM cd_sent GROUP BY doc_id)
SELECT CAST(min(n_kept) AS BIGINT) AS min_sent_len, CAST(max(n_kept) AS BIGINT) AS max_sent_len,
       round(avg(n_kept), 6) AS avg_sent_len,
       (SELECT CAST(min(ns) AS BIGINT) FROM per_doc) AS min_sents, (SELECT CAST(max(ns) AS BIGINT) FROM per_doc) AS max_sents,
       (SELECT round(avg(ns), 6) FROM per_doc) AS avg_sents, CAST(count(*) AS BIGINT) AS total_sents
FROM cd_sent""")
def doc_stats_q(spark, sf_dir):
    cc = clean_document(_docs(spark, sf_dir))
    s = cc.sent_counts
    per_doc = cc.documents.select(F.size("sents").cast("bigint").alias("ns")).filter("ns > 0")
    a = s.agg(F.min("n_kept").alias("min_sent_len"), F.max("n_kept").alias("max_sent_len"),
              F.round(F.avg("n_kept"), 6).alias("avg_sent_len"), F.count(F.lit(1)).alias("total_sents"))
    b = per_doc.agg(F.min("ns").alias("min_sents"), F.max("ns").alias("max_sents"),
                    F.round(F.avg("ns"), 6).alias("avg_sents"))
    # two single-row aggregates merged into one row (no join)
    cols_a = ["min_sent_len", "max_sent_len", "avg_sent_len", "total_sents"]
    cols_b = ["min_sents", "max_sents", "avg_sents"]
    ua = a.select(*cols_a, *[F.lit(None).cast(t).alias(c) for c, t in
                             (("min_sents", "bigint"), ("max_sents", "bigint"), ("avg_sents", "double"))])
    ub = b.select(*[F.lit(None).cast(t).alias(c) for c, t in
                    (("min_sent_len", "bigint"), ("max_sent_len", "bigint"), ("avg_sent_len", "double"),
                     ("total_sents", "bigint"))], *cols_b)
    return ua.unionByName(ub).agg(*[F.max(c).alias(c) for c in cols_a + cols_b])


@register("max_doc_len", sql=f"""WITH {LANG_TASK_SQL}
SELECT CAST(max(len(string_split({T.clean_str_sql('text')}, ' '))) AS INTEGER) AS max_len
FROM lang_task WHERE split = 'train'""")
def max_doc_len_q(spark, sf_dir):
    lt = lang_task(spark, sf_dir).filter(F.col("split") == "train")
    return lt.agg(F.max(F.size(F.split(T.clean_str("text"), " "))).cast("int").alias("max_len"))


_EN_TOKENS_SQL = (f"ent AS (SELECT doc_id, generate_subscripts(tt, 1) - 1 AS pos, unnest(tt) AS word "
                  f"FROM (SELECT doc_id, {T.tokenize_en_sql('text')} AS tt FROM documents))")
_VOCAB_SQL = (f"voc AS (SELECT word, n, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS word_id FROM "
              f"(SELECT word, count(*) AS n FROM ent GROUP BY word ORDER BY n DESC, word LIMIT {VOCAB_SIZE}))")


def _en_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return TK.explode_tokens(d.select("doc_id", T.tokenize_en("text").alias("t")), "doc_id", "t")


def _en_lists(spark, sf_dir, vocab_size: int = VOCAB_SIZE):
    """Word lists by document, and the vocabulary of their ``vocab_size`` most frequent words."""
    lists = _docs(spark, sf_dir).select("doc_id", T.tokenize_en("text").alias("t"))
    return lists, V.build_vocab(lists.select(F.explode("t").alias("word")), vocab_size)


@register("build_vocab", sql=f"WITH {_EN_TOKENS_SQL}, {_VOCAB_SQL} SELECT word, n, word_id FROM voc")
def build_vocab_q(spark, sf_dir):
    return V.build_vocab(_en_tokens(spark, sf_dir), VOCAB_SIZE)


_BOW_SQL = "bw AS (SELECT e.doc_id, v.word_id, count(*) AS n FROM ent e JOIN voc v ON e.word = v.word GROUP BY 1, 2)"


@register("bow", sql=f"WITH {_EN_TOKENS_SQL}, {_VOCAB_SQL}, {_BOW_SQL} SELECT doc_id, word_id, n FROM bw")
def bow_q(spark, sf_dir):
    lists, vocab = _en_lists(spark, sf_dir)
    return V.list_bow(lists, vocab).drop("total")


@register("row_normalize", sql=f"""WITH {_EN_TOKENS_SQL}, {_VOCAB_SQL}, {_BOW_SQL}
SELECT doc_id, word_id, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY doc_id), 0), 0.0), 6) AS v FROM bw""")
def row_normalize_q(spark, sf_dir):
    lists, vocab = _en_lists(spark, sf_dir)
    return V.row_normalize(V.list_bow(lists, vocab), total="total").withColumn("v", F.round("v", 6))


@register("bow_vocab", sql=f"""WITH {_EN_TOKENS_SQL},
bv AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS word_id FROM
       (SELECT DISTINCT unnest({T.tokenize_en_sql('text')}) AS word FROM benchmark))
SELECT e.doc_id, bv.word_id, count(*) AS n FROM ent e JOIN bv ON e.word = bv.word GROUP BY 1, 2""")
def bow_vocab_q(spark, sf_dir):
    """Counts over a vocabulary given as another table (the words of ``benchmark``)."""
    bench = table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize_en("text")).alias("word")).distinct()
    vocab = V.build_vocab(bench.select("word"), None)
    return V.list_bow(_docs(spark, sf_dir).select("doc_id", T.tokenize_en("text").alias("t")), vocab).drop("total")


_CLEAN_VOCAB_SQL = ("cv AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS word_id "
                    "FROM (SELECT DISTINCT word FROM cd_tokens))")


@register("term_counts", sql=f"""WITH {CD}, {_CLEAN_VOCAB_SQL}
SELECT t.doc_id, cv.word_id, count(*) AS n FROM cd_tokens t JOIN cv ON t.word = cv.word GROUP BY 1, 2""")
def term_counts_q(spark, sf_dir):
    cc = clean_document(_docs(spark, sf_dir))
    enc = encoded_documents(cc, clean_vocab(cc))
    return TK.item_counts(enc.select("doc_id", "ids"), "ids", "word_id", "n")


_NESTED_SQL = """sn AS (SELECT doc_id, sent, count(*) AS n, count(*) FILTER (WHERE id = 0) AS o, '[' || string_agg(CAST(id AS VARCHAR), ', ' ORDER BY pos) || ']' AS s
  FROM ei GROUP BY doc_id, sent),
dn AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(o) AS BIGINT) AS n_oov, '[' || string_agg(s, ', ' ORDER BY sent) || ']' AS ids FROM sn GROUP BY doc_id)"""


@register("encode_ids", sql=f"""WITH {CD}, {LANG_TASK_SQL},
tv AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS word_id FROM
       (SELECT DISTINCT t.word FROM cd_tokens t JOIN lang_task l ON t.doc_id = l.row_id WHERE l.split = 'train')),
ei AS (SELECT t.doc_id, t.sent, t.pos, coalesce(tv.word_id, 0) AS id FROM cd_tokens t LEFT JOIN tv ON t.word = tv.word), {_NESTED_SQL}
SELECT * FROM dn""")
def encode_ids_q(spark, sf_dir):
    """Clean documents of every split encoded with the training-split vocabulary (OOV = 0),
    sentences kept apart and printed as nested lists."""
    cc = clean_document(_docs(spark, sf_dir))
    train = lang_task(spark, sf_dir).filter(F.col("split") == "train").select(F.col("row_id").alias("doc_id"))
    vocab = clean_vocab(cc, cc.documents.select("doc_id", "id").join(train, "doc_id", "left_semi"))
    nested = TK.nested_lists(encoded_documents(cc, vocab).filter(F.size("ids") > 0))
    flat = F.flatten("ids")
    return nested.select("doc_id", F.size(flat).cast("bigint").alias("n_tokens"),
                         F.size(F.filter(flat, lambda x: x == 0)).cast("bigint").alias("n_oov"), V.printed("ids").alias("ids"))


_PRE_TOKENS_SQL = (f"pt AS (SELECT doc_id, unnest(tt) AS word FROM "
                   f"(SELECT doc_id, {T.tokenize_preproc_sql('text')} AS tt FROM documents))")
_IDF_SQL = ("idf AS (SELECT word, df, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM "
            "(SELECT word, count(DISTINCT doc_id) AS df FROM pt GROUP BY word) "
            "WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents))")


def _idf_table(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return V.smoothed_idf(V.list_doc_freq(d.select("doc_id", T.tokenize_preproc("text").alias("t"))), d.count())


@register("idf", sql=f"WITH {_PRE_TOKENS_SQL}, {_IDF_SQL} SELECT word, df, round(idf, 6) AS idf FROM idf")
def idf_q(spark, sf_dir):
    return _idf_table(spark, sf_dir).select("word", "df", F.round("idf", 6).alias("idf"))


@register("vocab_processor", sql=f"""WITH {LANG_TASK_SQL},
tk AS (SELECT row_id, split, generate_subscripts(tt, 1) - 1 AS pos, unnest(tt) AS word
       FROM (SELECT row_id, split, string_split({T.clean_str_sql('text')}, ' ') AS tt FROM lang_task)),
L AS (SELECT max(pos) + 1 AS maxlen FROM tk WHERE split = 'train'),
fv AS (SELECT word, CAST(row_number() OVER (ORDER BY min(row_id * 1000000 + pos), word) AS INTEGER) AS word_id
       FROM tk WHERE split = 'train' GROUP BY word),
id AS (SELECT tk.row_id, list(coalesce(fv.word_id, 0) ORDER BY tk.pos) AS l FROM tk LEFT JOIN fv ON tk.word = fv.word GROUP BY tk.row_id)
SELECT row_id AS doc_id, CAST(maxlen AS INTEGER) AS length,
       array_to_string(list_concat(l, list_transform(range(0, maxlen), lambda i: 0))[1:maxlen], ' ') AS ids FROM id, L""")
def vocab_processor_q(spark, sf_dir, length: int | None = None):
    """Ids by first appearance in the training split (0 = unknown); every document becomes a
    list of ``length`` ids, cut or filled with zeros. The default is the longest training
    document's length; over large corpora pass a length, so that one long document doesn't
    widen all rows."""
    lt = spread(lang_task(spark, sf_dir), "row_id")
    lists = stored(lt.filter(F.col("text").isNotNull()).select(F.col("row_id").alias("doc_id"), "split", F.split(T.clean_str("text"), " ").alias("t")),
                   "padded-tokens")  # read for the length, the vocabulary and the ids
    train = lists.filter(F.col("split") == "train")
    maxlen = length or train.agg(F.max(F.size("t"))).first()[0] or 1
    vocab = stored(V.first_seen_vocab(train.select("doc_id", F.posexplode("t").alias("pos", "word"))), "vocabulary")
    # positions past the length of the result are dropped before documents are encoded
    ids = V.encoded_lists(lists.select("doc_id", F.slice("t", 1, maxlen).alias("t")), vocab)
    return ids.select("doc_id", F.lit(maxlen).cast("int").alias("length"), V.padded_text("ids", maxlen).alias("ids"))


@register("anti_stopwords", sql=f"""WITH {_EN_TOKENS_SQL},
stop AS (SELECT unnest([{", ".join(T.sql_str(w) for w in R.ENGLISH_STOP_WORDS)}]) AS word)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(word, ' ' ORDER BY pos) AS text_out
FROM ent WHERE word NOT IN (SELECT word FROM stop) GROUP BY doc_id""")
def anti_stopwords_q(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in R.ENGLISH_STOP_WORDS], "word string")
    kept = _en_tokens(spark, sf_dir).join(F.broadcast(stop), "word", "left_anti")  # fixed 179-row side
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
        .alias("text_out"))


# ---------------------------------------------------------------------------
# Word-vector features.
# ---------------------------------------------------------------------------
_PUNCT_SQL = T.sql_str(R.PUNCTUATION)


def _vec_tokens(spark, sf_dir):
    """Short-cleaner tokens that are not a piece of the punctuation string."""
    toks = corpus_tokens(_docs(spark, sf_dir))
    return toks.filter(F.instr(F.lit(R.PUNCTUATION), F.col("word")) == 0)


def _token_lists(spark, sf_dir):
    """``(doc_id, t)``: short-cleaner tokens in the row of their document, stored: they are read
    for the ranks of words and for the sums."""
    return stored(_docs(spark, sf_dir).select("doc_id", T.split_ws(T.clean_str("text")).alias("t")), "token-lists")


def document_means(spark, sf_dir, weighted: bool = False):
    """``(doc_id, vec)``: every document's mean word vector, with ``weighted`` each vector times its
    word's inverse document frequency (the largest one for words without)."""
    lists = _token_lists(spark, sf_dir)
    wv = word_vectors(spark, sf_dir, lists).filter(F.instr(F.lit(R.PUNCTUATION), F.col("word")) == 0)
    if weighted:
        idf_t = stored(_idf_table(spark, sf_dir), "idf")  # read for its maximum too
        top = V.max_idf(idf_t)
        wv = (wv.join(idf_t.select("word", "idf"), "word", "left")
              .withColumn("vec", F.transform("vec", lambda x: x * F.coalesce(F.col("idf"), F.lit(top)))))
    return V.mean_vectors(lists, wv, VECTOR_DIM)


def _long(means):
    return means.select("doc_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


@register("avg_vector", sql=f"""WITH {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL},
k AS (SELECT ct.doc_id, wv.vec FROM ct JOIN wv ON ct.word = wv.word WHERE instr({_PUNCT_SQL}, ct.word) = 0),
e AS (SELECT doc_id, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM k),
m AS (SELECT doc_id, dim, avg(x) AS v FROM e GROUP BY doc_id, dim)
SELECT d.doc_id, CAST(g.dim AS INTEGER) AS dim, round(coalesce(m.v, 0.0), 6) AS v
FROM documents d CROSS JOIN range(0, 64) g(dim) LEFT JOIN m ON m.doc_id = d.doc_id AND m.dim = g.dim""")
def avg_vector_q(spark, sf_dir):
    return _long(document_means(spark, sf_dir))


@register("tfidf_vector", sql=f"""WITH {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL}, {_PRE_TOKENS_SQL}, {_IDF_SQL},
k AS (SELECT ct.doc_id, wv.vec, coalesce(idf.idf, (SELECT max(idf) FROM idf)) AS w FROM ct JOIN wv ON ct.word = wv.word
      LEFT JOIN idf ON idf.word = ct.word WHERE instr({_PUNCT_SQL}, ct.word) = 0),
e AS (SELECT doc_id, w, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM k),
m AS (SELECT doc_id, dim, avg(x * w) AS v FROM e GROUP BY doc_id, dim)
SELECT d.doc_id, CAST(g.dim AS INTEGER) AS dim, round(coalesce(m.v, 0.0), 6) AS v
FROM documents d CROSS JOIN range(0, 64) g(dim) LEFT JOIN m ON m.doc_id = d.doc_id AND m.dim = g.dim""")
def tfidf_vector_q(spark, sf_dir):
    return _long(document_means(spark, sf_dir, weighted=True))


@register("join_vectors", sql=f"""WITH {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL}
SELECT ct.doc_id, ct.word, wv.vec_id, count(*) AS n, round(any_value(list_sum(CAST(wv.vec AS DOUBLE[]))), 6) AS vec_sum
FROM ct JOIN wv ON ct.word = wv.word WHERE instr({_PUNCT_SQL}, ct.word) = 0 GROUP BY ct.doc_id, ct.word, wv.vec_id""")
def join_vectors_q(spark, sf_dir):
    """Every word of a document that has a vector, with its count and its vector (reported
    as the vector's id and sum)."""
    counts = _vec_tokens(spark, sf_dir).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    k = TK.salted_join(counts, word_vectors(spark, sf_dir).select("word", "vec_id", "vec"), "word", "inner", "doc_id")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return k.select("doc_id", "word", "vec_id", "n", F.round(total, 6).alias("vec_sum"))


def fallback_vector(wv, word: str = "the"):
    """The vector of the fallback word as a literal (one vector of fixed size reaches
    the driver)."""
    row = wv.filter(F.col("word") == word).select("vec").first()
    if row is None:  # no vector to fall back on: the zero vector
        return F.array_repeat(F.lit(0.0).cast("float"), 64)
    return F.array(*[F.lit(float(x)).cast("float") for x in row["vec"]])


@register("embedding_matrix", sql=f"""WITH {CD}, {_CLEAN_VOCAB_SQL}, {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL},
m AS (SELECT cv.word_id, wv.vec IS NOT NULL AS found, coalesce(wv.vec, (SELECT vec FROM wv WHERE word = 'the'), list_transform(range(0, 64), lambda i: CAST(0.0 AS FLOAT))) AS vec
      FROM cv LEFT JOIN wv ON cv.word = wv.word
      UNION ALL SELECT 0 AS word_id, false AS found, list_transform(range(0, 64), lambda i: CAST(0.0 AS FLOAT)) AS vec)
SELECT word_id, found, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(CAST(unnest(vec) AS DOUBLE), 6) AS v FROM m""")
def embedding_matrix_q(spark, sf_dir):
    """Clean-corpus vocabulary joined to the word vectors; a missing word takes the
    vector of 'the', id 0 is the zero vector."""
    cc = clean_document(_docs(spark, sf_dir))
    wv = word_vectors(spark, sf_dir)
    fb = fallback_vector(wv)
    m = (clean_vocab(cc).join(wv.select("word", "vec"), "word", "left")
         .select("word_id", F.col("vec").isNotNull().alias("found"), F.coalesce("vec", fb).alias("vec")))
    zero = spark.range(1).select(F.lit(0).cast("int").alias("word_id"), F.lit(False).alias("found"),
                                 F.array_repeat(F.lit(0.0).cast("float"), 64).alias("vec"))
    m = m.unionByName(zero)
    return m.select("word_id", "found", F.posexplode("vec").alias("dim", "v")).withColumn(
        "v", F.round(F.col("v").cast("double"), 6))


@register("embedding_init", sql=f"""WITH {CD}, {_CLEAN_VOCAB_SQL}, {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL},
g AS (SELECT cv.word_id, wv.vec, d.dim FROM cv LEFT JOIN wv ON cv.word = wv.word CROSS JOIN range(0, 64) d(dim))
SELECT word_id, CAST(dim AS INTEGER) AS dim, round(coalesce(CAST(vec[dim + 1] AS DOUBLE),
       -0.25 + 0.5 * {uniform_sql(42, "CAST(word_id AS VARCHAR) || '/' || CAST(dim AS VARCHAR)")}), 6) AS v FROM g""")
def embedding_init_q(spark, sf_dir):
    """Vocabulary vectors; a missing word gets U(-0.25, 0.25) per dimension (row-keyed)."""
    cc = clean_document(_docs(spark, sf_dir))
    wv = word_vectors(spark, sf_dir)
    m = clean_vocab(cc).join(wv.select("word", "vec"), "word", "left")
    m = m.select("word_id", F.col("vec"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("dim"))
    rnd = F.lit(-0.25) + F.lit(0.5) * uniform(42, F.concat(F.col("word_id").cast("string"), F.lit("/"),
                                                           F.col("dim").cast("string")))
    return m.select("word_id", "dim", F.round(F.coalesce(F.element_at("vec", F.col("dim") + 1).cast("double"), rnd), 6)
                    .alias("v"))
