"""Document cleaning plan: sentences -> tokens -> corpus counts -> frequency filter
-> truncation -> token lists by document.

Two passes over the corpus (counts, then filter), both distributed. The frequency bar reaches
the driver, and the kept words do in bounded groups, to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import tokens as TK
from ..operators import vocab as V
from ..operators.ranking import global_rank
from ..session import stored
from ..tables import spread


def stop_words_for(dataset: str):
    words = list(R.ENGLISH_STOP_WORDS)
    if dataset == "20ng":
        words += R.NEWSGROUP_EXTRA_STOP_WORDS
    return words


@dataclass
class CleanCorpus:
    lists: DataFrame       # (doc_id, t): every row's words before the filter, a list per sentence
    freq: DataFrame        # (word, n)
    bar: int
    words: DataFrame       # (word, id): words that pass the filter; ids in their order
    documents: DataFrame   # (doc_id, sents, n_kept, sent, pos, id), one row per document: kept
    #                        sentences with their kept words, kept tokens of kept sentences in order
    key: str = "doc_id"

    @property
    def sentences(self) -> DataFrame:
        """(doc_id, sent)"""
        return self.lists.select(self.key, F.posexplode("t").alias("sent", "_t")).drop("_t")

    @property
    def raw_tokens(self) -> DataFrame:
        """(doc_id, sent, pos, word) before the filter"""
        return TK.explode_tokens(self.lists.select(self.key, F.posexplode("t").alias("sent", "t")), [self.key, "sent"], "t")

    @property
    def sent_counts(self) -> DataFrame:
        """(doc_id, sent, n_kept) for the kept sentences"""
        return self.documents.select(self.key, F.explode(F.arrays_zip("sents", "n_kept")).alias("s")).select(
            self.key, F.col("s.sents").alias("sent"), F.col("s.n_kept").cast("bigint").alias("n_kept"))

    @property
    def word_lists(self) -> DataFrame:
        """(doc_id, sent, pos, word): the kept tokens as lists"""
        return TK.looked_up(self.documents.select(self.key, "sent", "pos", "id"), "id", self.words, "id", "word", "word").drop("id")

    @property
    def tokens(self) -> DataFrame:
        """(doc_id, sent, pos, word, tpos) kept tokens of kept sentences"""
        return self.word_lists.select(self.key, F.posexplode(F.arrays_zip("sent", "pos", "word")).alias("tpos", "t")).select(
            self.key, "t.sent", "t.pos", "t.word", "tpos")


def clean_document(docs: DataFrame, dataset: str = "20ng", key: str = "doc_id", text: str = "text",
                   lemma: DataFrame | None = None, min_freq: int = 5, top: int = 10,
                   max_words: int = 2000) -> CleanCorpus:
    """``max_words``: a document keeps its sentences up to the one that passes this many
    kept words (the recipe's own limit). Tokens stay in the row of their document."""
    # Written once: both corpus passes (counts, then the filter) read it and the regex chains run once.
    lists = stored(TK.sentence_lists(spread(docs, key), key, text, dataset == "20ng"), "sentences")
    if lemma is not None:
        both = TK.looked_up(lists, "t", stored(lemma, "lemmas"), "token", "lemma", "l")
        lists = stored(both.select(key, F.zip_with("t", "l", lambda t, l: F.zip_with(t, l, lambda w, x: F.coalesce(x, w))).alias("t")), "sentences")
    freq = stored(TK.list_freq(lists, "t"), "word-counts")
    stop = stop_words_for(dataset)
    if dataset == "mr":
        bar, kept = 0, freq.filter(~F.col("word").isin(stop)).select("word")
    else:
        bar = TK.frequency_bar(freq, top)
        kept = TK.kept_words(freq, stop, min_freq, bar)
    words = stored(global_rank(kept, ["word"], out="id").select("word", F.col("id").cast("int").alias("id")), "kept-words")
    # The cut is decided on a document's sentences, so its row is bounded by max_words and one sentence.
    documents = TK.keep_by_frequency(lists, words, max_words if dataset == "20ng" else None, key)
    return CleanCorpus(lists, freq, bar, words, stored(documents, "clean-documents"), key)


def encoded_documents(cc: CleanCorpus, vocab: DataFrame) -> DataFrame:
    """``cc.documents`` with ``ids``, the tokens' ids of ``vocab (word, word_id)``; null for words
    it does not have."""
    by_id = stored(cc.words.join(vocab.select("word", "word_id"), "word").select("id", "word_id"), "word-ids")
    return TK.looked_up(cc.documents, "id", by_id, "id", "word_id", "ids")


def clean_vocab(cc: CleanCorpus, documents: DataFrame | None = None) -> DataFrame:
    """``(word, n, word_id)``: the words of the kept tokens (of ``documents``, rows of
    ``cc.documents``), ids from 1 in the order of words."""
    ids = (cc.documents if documents is None else documents).select(F.explode("id").alias("id"))
    # ids are in the order of words
    return V.build_vocab(ids, None, word="id", first_id=1).join(cc.words, "id").select("word", "n", "word_id")


# ---------------------------------------------------------------------------
# SQL twin (DuckDB) used by the oracle checks.
# ---------------------------------------------------------------------------

def clean_document_sql(dataset: str = "20ng", source: str = "documents", min_freq: int = 5,
                       top: int = 10, max_words: int = 2000) -> str:
    """CTE list defining cd_s, cd_t, cd_freq, cd_bar, cd_kept, cd_sent, cd_tokens."""
    stop = "[" + ", ".join(T.sql_str(w) for w in stop_words_for(dataset)) + "]"
    sents = T.split_sentences_sql(T.clean_simple_sql("text", dataset == "20ng"))
    toks = T.split_ws_sql(T.clean_str_sql("sentence"))
    if dataset == "mr":
        kept_filter = f"NOT list_contains({stop}, t.word)"
    else:
        kept_filter = (f"f.n >= {min_freq} AND f.n < (SELECT bar FROM cd_bar) "
                       f"AND NOT list_contains({stop}, t.word)")
    trunc = f"WHERE before <= {max_words}" if dataset == "20ng" else ""
    return f"""
cd_s AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent, unnest(ss) AS sentence
         FROM (SELECT doc_id, {sents} AS ss FROM {source})),
cd_t AS (SELECT doc_id, sent, generate_subscripts(tt, 1) - 1 AS pos, unnest(tt) AS word
         FROM (SELECT doc_id, sent, {toks} AS tt FROM cd_s)),
cd_freq AS (SELECT word, count(*) AS n FROM cd_t GROUP BY word),
cd_bar AS (SELECT min(n) AS bar FROM (SELECT n FROM cd_freq ORDER BY n DESC LIMIT {top})),
cd_kept AS (SELECT t.doc_id, t.sent, t.pos, t.word FROM cd_t t JOIN cd_freq f ON t.word = f.word
            WHERE {kept_filter}),
cd_scount AS (SELECT s.doc_id, s.sent, count(k.word) AS n_kept FROM cd_s s
              LEFT JOIN cd_kept k ON s.doc_id = k.doc_id AND s.sent = k.sent GROUP BY s.doc_id, s.sent),
cd_sent AS (SELECT doc_id, sent, n_kept FROM (
              SELECT *, coalesce(sum(n_kept) OVER (PARTITION BY doc_id ORDER BY sent
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cd_scount) {trunc}),
cd_tokens AS (SELECT k.doc_id, k.sent, k.pos, k.word,
                     row_number() OVER (PARTITION BY k.doc_id ORDER BY k.sent, k.pos) - 1 AS tpos
              FROM cd_kept k SEMI JOIN cd_sent s ON k.doc_id = s.doc_id AND k.sent = s.sent)"""
