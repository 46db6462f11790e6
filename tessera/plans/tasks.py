"""Derived task tables (all computed by Spark from the given tables).

* lang task: documents with ``y`` = language id, a hash split and planted label noise.
* word-vector table: corpus words ranked by (count desc, word asc); the word of
  rank r takes ``embeddings.embedding`` of ``vec_id = r``.
* stored probabilities: deterministic class scores for report queries that need
  no fitted model.

Each builder has a SQL twin for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..operators.ranking import global_rank
from ..operators.tokens import list_freq, short_word_freq
from ..tables import table

SEED = 42
LANGS_SQL = "[" + ", ".join(f"'{x}'" for x in R.LANG_LABELS) + "]"
K_LANG = len(R.LANG_LABELS)


def split_of(u: F.Column) -> F.Column:
    return F.when(u < 0.5, "train").when(u < 0.75, "valid").otherwise("test")


def split_of_sql(u: str) -> str:
    return f"(CASE WHEN {u} < 0.5 THEN 'train' WHEN {u} < 0.75 THEN 'valid' ELSE 'test' END)"


def lang_task(spark, sf_dir) -> DataFrame:
    """``(row_id, text, y, split)``; y = 0..3 for en, de, es, fr."""
    return lang_rows(table(spark, sf_dir, "documents"), "text")


def lang_rows(docs: DataFrame, *columns) -> DataFrame:
    """The lang task of ``docs (doc_id, lang, ...)``: row_id, the given columns, y and split."""
    known = F.array(*[F.lit(x) for x in R.LANG_LABELS])
    # a language outside the list (or none) is no class of the task: its rows go
    return docs.filter(F.col("lang").isin(list(R.LANG_LABELS))).select(
        F.col("doc_id").alias("row_id"), *columns, (F.array_position(known, F.col("lang")) - 1).cast("int").alias("y"),
        split_of(uniform(SEED, "doc_id")).alias("split"))


LANG_TASK_SQL = (f"lang_task AS (SELECT doc_id AS row_id, text, "
                 f"CAST(list_position({LANGS_SQL}, lang) - 1 AS INTEGER) AS y, "
                 f"{split_of_sql(uniform_sql(SEED, 'doc_id'))} AS split FROM documents WHERE list_contains({LANGS_SQL}, lang))")


def corpus_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Short-text-cleaner tokens in long form ``(key, pos, word)``."""
    return docs.select(key, F.posexplode(T.split_ws(T.clean_str(text))).alias("pos", "word"))


CORPUS_TOKENS_SQL = (f"ct AS (SELECT doc_id, generate_subscripts(tt, 1) - 1 AS pos, unnest(tt) AS word "
                     f"FROM (SELECT doc_id, {T.split_ws_sql(T.clean_str_sql('text'))} AS tt FROM documents))")


def word_vectors(spark, sf_dir, lists: DataFrame | None = None) -> DataFrame:
    """``(word, vec array<float>)`` for the words whose rank has an embedding row. ``lists``: the
    corpus tokens as lists ``t``."""
    freq = list_freq(lists, "t") if lists is not None else short_word_freq(table(spark, sf_dir, "documents"))
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    ranked = global_rank(freq, [F.col("n").desc(), F.col("word")], out="vec_id")
    return ranked.join(emb, "vec_id").select("word", "vec", "vec_id")


WORD_VECTORS_SQL = ("wv AS (SELECT r.word, e.embedding AS vec, e.vec_id FROM (SELECT word, "
                    "row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS vec_id FROM ct GROUP BY word) r "
                    "JOIN embeddings e ON e.vec_id = r.vec_id)")


# ---------------------------------------------------------------------------
# Planted label noise on the training split, and stored deterministic scores.
# ---------------------------------------------------------------------------
NOISE_RATE = 0.2


def noisy_train(spark, sf_dir, rate: float = NOISE_RATE) -> DataFrame:
    """Training rows of the lang task with ``int(n * rate)`` flipped labels:
    ``(row_id, y, y_clean, is_noisy)``. Texts stay out of the global sort that draws the
    labels; join them back by ``row_id`` where they are needed."""
    from ..operators.sampling import corrupt_label
    tr = lang_task(spark, sf_dir).filter(F.col("split") == "train").select("row_id", "y")
    return corrupt_label(tr, rate, SEED)


def noisy_train_sql(rate: float = NOISE_RATE) -> str:
    u42, u43 = uniform_sql(SEED, "row_id"), uniform_sql(SEED + 1, "row_id")
    return f"""{LANG_TASK_SQL},
tr AS (SELECT row_id, y FROM lang_task WHERE split = 'train'),
cls AS (SELECT list_sort(list(DISTINCT y)) AS c FROM tr),
nz0 AS (SELECT row_id, y AS y_clean, {u43} AS u43,
        row_number() OVER (ORDER BY {u42}, row_id) - 1 < (SELECT floor(count(*) * {rate}) FROM tr) AS is_noisy FROM tr),
noisy AS (SELECT row_id, y_clean, is_noisy,
          CAST(CASE WHEN is_noisy THEN list_filter(cls.c, lambda x: x <> y_clean)[CAST(floor(u43 * (len(cls.c) - 1)) AS INTEGER) + 1]
               ELSE y_clean END AS INTEGER) AS y FROM nz0, cls)"""


def with_scores(df: DataFrame, key: str = "row_id", k: int = K_LANG) -> DataFrame:
    """Stored class probabilities ``p`` (hash uniforms normalised over k) and a
    stored data value ``value = u(7, id)``."""
    us = [uniform(SEED + j, key) for j in range(k)]
    total = us[0]
    for u in us[1:]:
        total = total + u
    return (df.withColumn("p", F.array(*[u / total for u in us]))
            .withColumn("value", uniform(7, key)))


def scores_sql(src: str, key: str = "row_id", k: int = K_LANG) -> str:
    """SELECT over ``src`` adding p and value (columns of src kept)."""
    us = [uniform_sql(SEED + j, key) for j in range(k)]
    cols = ", ".join(f"{u} AS _u{j}" for j, u in enumerate(us))
    tot = " + ".join(f"_u{j}" for j in range(k))
    plist = "[" + ", ".join(f"_u{j} / ({tot})" for j in range(k)) + "]"
    return (f"SELECT * EXCLUDE ({', '.join(f'_u{j}' for j in range(k))}), {plist} AS p, "
            f"{uniform_sql(7, key)} AS value FROM (SELECT *, {cols} FROM {src})")
