"""Catalogue: text cleaning, tokenising and corpus-statistics queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tokens as TK
from ..tables import table
from .documents import clean_document, clean_document_sql
from .registry import register

# Kept-word report: the minimum end-to-end slice.
TOP_WORDS = 20


@register("top_words_by_lang", sql=f"""
WITH {clean_document_sql()},
c AS (SELECT d.lang, t.word, count(*) AS n FROM cd_tokens t JOIN documents d ON t.doc_id = d.doc_id
      GROUP BY d.lang, t.word)
SELECT lang, word, n, rnk FROM (
  SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rnk FROM c)
WHERE rnk <= {TOP_WORDS}
""")
def top_words_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cc = clean_document(docs.select("doc_id", "text"))
    counts = (cc.documents.select("doc_id", "id").join(docs.select("doc_id", "lang"), "doc_id")
              .select("lang", F.explode("id").alias("id")).groupBy("lang", "id").agg(F.count(F.lit(1)).alias("n"))
              .join(cc.words, "id").select("lang", "word", "n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("word"))
    return (counts.withColumn("rnk", F.row_number().over(w))
            .filter(F.col("rnk") <= TOP_WORDS).select("lang", "word", "n", "rnk"))


def _clean_rows(cc):
    """Every document that has a sentence, with its kept sentences, words and text."""
    rows = TK.looked_up(cc.documents.filter(F.size("sents") > 0), "id", cc.words, "id", "word", "word")
    words = F.aggregate("n_kept", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("sents").cast("bigint").alias("n_sent"), words.alias("n_words"),
                       F.when(F.col("doc_id").isNotNull(), F.array_join("word", " ")).otherwise("").alias("text_out"))


@register("clean_document", sql=f"""
WITH {clean_document_sql()}
SELECT s.doc_id, CAST(count(DISTINCT s.sent) AS BIGINT) AS n_sent,
       CAST(coalesce(sum(s.n_kept), 0) AS BIGINT) AS n_words,
       coalesce((SELECT string_agg(t.word, ' ' ORDER BY t.tpos) FROM cd_tokens t WHERE t.doc_id = s.doc_id), '') AS text_out
FROM cd_sent s GROUP BY s.doc_id
""")
def clean_document_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cc = clean_document(docs)
    return _clean_rows(cc)


# ---------------------------------------------------------------------------
# Row-wise cleaners and tokenisers on whole document texts.
# ---------------------------------------------------------------------------
from ..functions import text as T  # noqa: E402
from ..tables import spread  # noqa: E402


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


def _string_query(key, fn, sql_fn):
    @register(key, sql=f"SELECT doc_id, {sql_fn('text')} AS text_out FROM documents")
    def q(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn("text").alias("text_out"))
    return q


_string_query("clean_str", T.clean_str, T.clean_str_sql)
_string_query("clean_simple", T.clean_simple, T.clean_simple_sql)
_string_query("clean_text", T.clean_text, T.clean_text_sql)
_string_query("clean_email", T.clean_email, T.clean_email_sql)
_string_query("remove_stopwords", T.remove_stopwords, T.remove_stopwords_sql)
_string_query("remove_stopwords_short", lambda c: T.remove_stopwords(c, "short"),
              lambda e: T.remove_stopwords_sql(e, "short"))


def _token_query(key, fn, sql_fn):
    @register(key, sql=f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS text_out
                           FROM (SELECT doc_id, {sql_fn('text')} AS t FROM documents)""")
    def q(spark, sf_dir):
        t = fn("text")
        return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("text_out"))
    return q


_token_query("tokenize_en", T.tokenize_en, T.tokenize_en_sql)
_token_query("tokenize_preproc", T.tokenize_preproc, T.tokenize_preproc_sql)


@register("split_sentences", sql=f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent, unnest(s) AS sentence
FROM (SELECT doc_id, {T.split_sentences_sql(T.clean_simple_sql('text', False))} AS s FROM documents)""")
def split_sentences_q(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(T.split_sentences(T.clean_simple("text", False))).alias("sent", "sentence"))


@register("flatten_sentences", sql=f"""
SELECT doc_id, CAST(len(f) AS INTEGER) AS n, array_to_string(f, ' ') AS text_out FROM (
  SELECT doc_id, flatten(list_transform({T.split_sentences_sql(T.clean_simple_sql('text'))},
                                       lambda s: {T.split_ws_sql(T.clean_str_sql('s'))})) AS f FROM documents)""")
def flatten_sentences_q(spark, sf_dir):
    nested = F.transform(T.split_sentences(T.clean_simple("text")), lambda s: T.split_ws(T.clean_str(s)))
    f = F.flatten(nested)
    return _docs(spark, sf_dir).select("doc_id", F.size(f).alias("n"), F.array_join(f, " ").alias("text_out"))


# Lemma table derived from the corpus vocabulary: a token ending in "s" maps to the
# token without it when that word is also in the vocabulary.
def lemma_table(tokens):
    vocab = tokens.select("word").distinct()
    cand = (vocab.filter(F.col("word").endswith("s") & (F.length("word") > 1))
            .select(F.col("word").alias("token"), F.expr("substring(word, 1, length(word) - 1)").alias("lemma")))
    return cand.join(vocab.withColumnRenamed("word", "lemma"), "lemma", "left_semi")


@register("normalize_tokens", sql=f"""
WITH t AS (SELECT doc_id, generate_subscripts(tt, 1) AS pos, unnest(tt) AS word
           FROM (SELECT doc_id, {T.tokenize_en_sql('text')} AS tt FROM documents)),
v AS (SELECT DISTINCT word FROM t),
lem AS (SELECT word AS token, substring(word, 1, length(word) - 1) AS lemma FROM v
        WHERE suffix(word, 's') AND length(word) > 1 AND substring(word, 1, length(word) - 1) IN (SELECT word FROM v))
SELECT t.doc_id, CAST(count(*) AS INTEGER) AS n, string_agg(coalesce(lem.lemma, t.word), ' ' ORDER BY t.pos) AS text_out
FROM t LEFT JOIN lem ON t.word = lem.token GROUP BY t.doc_id""")
def normalize_tokens_q(spark, sf_dir):
    from ..operators.tokens import explode_tokens, lemmatise
    toks = explode_tokens(_docs(spark, sf_dir).select("doc_id", T.tokenize_en("text").alias("t")), "doc_id", "t")
    mapped = lemmatise(toks, lemma_table(toks))
    return (mapped.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
        .alias("text_out")))


# ---------------------------------------------------------------------------
# n-grams on whole documents; n-terms on whole part names.
# ---------------------------------------------------------------------------

def _gram_counts_sql(list_sql_by_n: dict, source_sql: str, key: str = "doc_id") -> str:
    parts = []
    for n, lst in list_sql_by_n.items():
        parts.append(f"SELECT {key}, {n} AS n, unnest({lst}) AS gram FROM ({source_sql})")
    body = " UNION ALL ".join(parts)
    return f"SELECT {key}, CAST(n AS INTEGER) AS n, gram, count(*) AS cnt FROM ({body}) GROUP BY {key}, n, gram"


def _gram_counts(docs, lists):
    """``(doc_id, n, gram, cnt)`` of ``docs (doc_id, t)``; ``lists`` has a column of grams for each
    ``n``. A document's grams are counted where its row lies; only documents that share an id
    are put together by a shuffle of their counts."""
    g = F.array(*[F.struct(F.lit(n).alias("n"), grams.alias("g")) for n, grams in lists.items()])

    def counted(d):
        each = d.select("doc_id", T.tokenize_en("text").alias("t")).select("doc_id", F.explode(g).alias("s"))
        return TK.item_counts(each.select("doc_id", "s.n", "s.g"), "g", "gram")
    once, again = TK.parted_by_repeats(docs)
    if again is None:
        return counted(once)
    return counted(once).unionByName(counted(again).groupBy("doc_id", "n", "gram").agg(F.sum("cnt").alias("cnt")))


_TOK_SRC = f"SELECT doc_id, {T.tokenize_en_sql('text')} AS t FROM documents"


@register("ngrams", sql=_gram_counts_sql({n: T.ngrams_sql("t", n, "_") for n in (1, 2, 3, 4)}, _TOK_SRC))
def ngrams_q(spark, sf_dir):
    return _gram_counts(_docs(spark, sf_dir), {n: T.ngrams("t", n, "_") for n in (1, 2, 3, 4)})


@register("ngrams_skip", sql=f"""
SELECT doc_id, CAST(n AS INTEGER) AS n, gram, count(*) AS cnt FROM (
  SELECT doc_id, 2 AS n, unnest(CASE WHEN len(t) > 1 THEN flatten(list_transform(range(0, len(t) - 1),
     lambda i: list_filter([CASE WHEN i + 1 < len(t) THEN t[i + 1] || '_' || t[i + 2] END,
                            CASE WHEN i + 2 < len(t) THEN t[i + 1] || '_' || t[i + 3] END], lambda x: x IS NOT NULL)))
     ELSE t END) AS gram FROM ({_TOK_SRC}))
GROUP BY doc_id, n, gram""")
def ngrams_skip_q(spark, sf_dir):
    return _gram_counts(_docs(spark, sf_dir), {2: T.ngrams("t", 2, "_", skip=1)})


@register("ngrams_multi", sql=_gram_counts_sql({c: T.ngrams_multi_sql("t", c, " ") for c in (12, 123)}, _TOK_SRC))
def ngrams_multi_q(spark, sf_dir):
    return _gram_counts(_docs(spark, sf_dir), {c: T.ngrams_multi("t", c, " ") for c in (12, 123)})


_NAME_SRC = f"SELECT p_partkey, {T.split_ws_sql('p_name')} AS t FROM part"


@register("nterms", sql=f"""
SELECT p_partkey, CAST(n AS INTEGER) AS n, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS pos, unnest(g) AS term FROM (
  {" UNION ALL ".join(f"SELECT p_partkey, {n} AS n, {T.nterms_sql('t', n, '_')} AS g FROM ({_NAME_SRC})" for n in (1, 2, 3, 4))})""")
def nterms_q(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    p = p.select("p_partkey", T.split_ws("p_name").alias("t"))
    g = F.array(*[F.struct(F.lit(n).alias("n"), T.nterms("t", n, "_").alias("g")) for n in (1, 2, 3, 4)])
    ex = p.select("p_partkey", F.explode(g).alias("s"))
    return ex.select("p_partkey", "s.n", F.posexplode("s.g").alias("pos", "term"))


@register("clean_document_mr", sql=f"""
WITH {clean_document_sql('mr')}
SELECT s.doc_id, CAST(count(DISTINCT s.sent) AS BIGINT) AS n_sent,
       CAST(coalesce(sum(s.n_kept), 0) AS BIGINT) AS n_words,
       coalesce((SELECT string_agg(t.word, ' ' ORDER BY t.tpos) FROM cd_tokens t WHERE t.doc_id = s.doc_id), '') AS text_out
FROM cd_sent s GROUP BY s.doc_id
""")
def clean_document_mr(spark, sf_dir):
    """The short-review variant: only stop words are removed (no frequency filter,
    no truncation, whitespace kept for sentence splitting)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cc = clean_document(docs, dataset="mr")
    return _clean_rows(cc)
