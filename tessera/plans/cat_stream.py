"""Catalogue: streaming runs over the documents folder (file source -> stateless
operators -> parquet sink), read back as batch tables."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LANG_LABELS
from ..operators import vocab as V
from ..operators.tokens import explode_tokens
from ..sources.writers import run_dir
from ..streaming import scoring as SS
from ..streaming import valuing as SV
from ..tables import table
from .cat_values import DATA_SQL, nb_sql
from . import valuation as VA
from .cat_vocab import _EN_TOKENS_SQL, VOCAB_SIZE
from .registry import register
from .tasks import LANG_TASK_SQL, lang_task


@register("stream_clean_str", sql=f"SELECT doc_id, {T.clean_str_sql('text')} AS text_out FROM documents")
def stream_clean_str(spark, sf_dir):
    run = run_dir(spark, "stream-" + uuid.uuid4().hex[:10])
    SS.run_to_parquet(SS.clean_stream(SS.document_stream(spark, sf_dir)), f"{run}/out", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/out")


@register("stream_predict", sql=f"""WITH {DATA_SQL}, trc AS (SELECT row_id, y FROM lang_task WHERE split = 'train'),
alld AS (SELECT doc_id AS row_id FROM documents), {nb_sql('s', 'trc', 'alld')}
SELECT row_id AS doc_id, CAST(pred AS INTEGER) AS pred FROM s_y""")
def stream_predict(spark, sf_dir):
    """Fit counts -> naive Bayes on the training split (batch), then score the document
    stream with the fitted pipeline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokenize_en("text").alias("t"))
    vocab = V.build_vocab(explode_tokens(docs, "doc_id", "t"), VOCAB_SIZE)
    words = [r["word"] for r in vocab.orderBy("word_id").select("word").collect()]  # <= VOCAB_SIZE words
    lt = lang_task(spark, sf_dir).filter(F.col("split") == "train")
    pipe = Pipeline(stages=[CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="features"),
                            NaiveBayes(featuresCol="features", labelCol="label")])
    model = pipe.fit(lt.withColumn("tokens", T.tokenize_en("text")).withColumn("label", F.col("y").cast("double")))
    run = run_dir(spark, "stream-" + uuid.uuid4().hex[:10])
    SS.run_to_parquet(SS.score_stream(SS.document_stream(spark, sf_dir), model), f"{run}/out", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/out")


@register("stream_encode", sql=f"""WITH {LANG_TASK_SQL}, {_EN_TOKENS_SQL},
tv AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS word_id FROM
       (SELECT DISTINCT e.word FROM ent e JOIN lang_task l ON l.row_id = e.doc_id WHERE l.split = 'train'))
SELECT d.doc_id, coalesce(string_agg(CASE WHEN e.word IS NOT NULL THEN CAST(coalesce(tv.word_id, 0) AS VARCHAR) END, ' ' ORDER BY e.pos), '') AS ids
FROM documents d LEFT JOIN ent e ON e.doc_id = d.doc_id LEFT JOIN tv ON tv.word = e.word GROUP BY d.doc_id""")
def stream_encode(spark, sf_dir):
    """The document stream encoded with a published version of the training split's vocabulary."""
    run = run_dir(spark, "stream-" + uuid.uuid4().hex[:10])
    train = lang_task(spark, sf_dir).filter("split = 'train'").select(F.col("row_id").alias("doc_id"), T.tokenize_en("text").alias("t"))
    version = SV.publish_vocabulary(V.build_vocab(explode_tokens(train, "doc_id", "t"), None, first_id=1), f"{run}/vocabulary")
    vocab = SV.read_vocabulary(spark, f"{run}/vocabulary", version)
    SV.by_batch(SS.document_stream(spark, sf_dir), lambda docs: SV.encode_documents(docs, vocab), f"{run}/out", f"{run}/ckpt")
    out = spark.read.option("basePath", f"{run}/out").parquet(f"{run}/out")
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("stream_values")
def stream_values(spark, sf_dir, iterations: int = 20):
    """Row values of arriving documents from a published valuer (trained for ``iterations``)."""
    run = run_dir(spark, "stream-" + uuid.uuid4().hex[:10])
    data = VA.lang_features(spark, sf_dir)
    tr = VA.ValuerTrainer(data, predictor="logistic", perf="log_loss", moving_baseline=0.9, resume=True).train(iterations)
    SV.release_of(tr, data.words, tr.reference).publish(spark, f"{run}/valuer")
    release = SV.Release.read(spark, f"{run}/valuer")

    def labelled(docs):
        known = F.array(*[F.lit(x) for x in LANG_LABELS])
        return docs.filter(F.col("lang").isin(*LANG_LABELS)).select(F.col("doc_id").alias("row_id"), "text", (F.array_position(known, F.col("lang")) - 1).alias("y"))
    SV.by_batch(SS.document_stream(spark, sf_dir), lambda docs: SV.value_rows(labelled(docs), release), f"{run}/out", f"{run}/ckpt")
    return spark.read.option("basePath", f"{run}/out").parquet(f"{run}/out").select("row_id", "data_value")
