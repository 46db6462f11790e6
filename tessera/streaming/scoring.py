"""Incremental cleaning and scoring of arriving documents.

The reference has no streaming operators; what streams here are the stateless
steps (cleaners, vocabulary encoding, fitted-model scoring), which Spark applies
to a streaming DataFrame unchanged. ``trigger(availableNow=True)`` processes
everything present and stops, so the same job serves backfills and schedules.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, name: str = "documents", max_files_per_trigger: int = 64) -> DataFrame:
    """The table ``name`` below ``folder`` as a stream of its files: a folder of part files, or one
    file (then every file of this name)."""
    table = f"{folder.rstrip('/')}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    reader = spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Append to a parquet folder, processing all available input, then stop."""
    q = (df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def clean_stream(stream: DataFrame) -> DataFrame:
    return stream.select("doc_id", T.clean_str("text").alias("text_out"))


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply a fitted pipeline (tokeniser, vocabulary counts, classifier) per micro-batch."""
    out = model.transform(stream.withColumn("tokens", T.tokenize_en("text")))
    return out.select("doc_id", F.col("prediction").cast("int").alias("pred"))
