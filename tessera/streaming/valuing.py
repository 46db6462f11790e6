"""Encoding and valuing of arriving rows.

A vocabulary is published as numbered versions below a folder, and a stream reads one version
for its whole life, so a restart encodes as before. A trained valuer is published with all that
valuing a row needs: its parameters, its vocabulary and the linear reference model whose
differences are its input. Each micro-batch is written to a folder of its own number and a
replayed batch overwrites it, so results are the same after a failure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import valuer as VL
from ..operators import vocab as V
from ..operators.network import softmax


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in fs.globStatus(path) or [])


def publish_vocabulary(vocab: DataFrame, root: str) -> int:
    """Write ``vocab (word, word_id)`` as the next version below ``root``."""
    version = max(_versions(vocab.sparkSession, root), default=0) + 1
    vocab.select("word", "word_id").write.parquet(f"{root}/v={version}")
    return version


def read_vocabulary(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema("word string, word_id int").parquet(f"{root}/v={version}")


def by_batch(stream: DataFrame, transform, sink: str, checkpoint: str) -> None:
    """Run ``transform`` on every micro-batch of what is there, then stop. Batch k is written to
    ``sink/batch=k``; a replay overwrites it. A stream without rows leaves one empty batch."""
    seen = []

    def write(batch: DataFrame, number: int) -> None:
        seen.append(number)
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not seen and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        transform(spark.createDataFrame([], stream.schema)).write.parquet(f"{sink}/batch=0")


def encode_documents(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, ids)``: token ids in order, 0 for words outside the vocabulary; a document
    without tokens has an empty list. Encoded in the document's row; rows that share an id are
    one document, their tokens by position. Rows without an id have no tokens."""
    ids = V.encoded_lists(docs.select("doc_id", T.tokenize_en("text").alias("t")), vocab)
    return ids.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("ids")).otherwise(F.array().cast("array<int>")).alias("ids"))


@dataclass
class Release:
    """A published valuer: vocabulary words in the order of their ids, network, reference model."""
    words: list
    k: int
    hidden: int
    comb: int
    theta: np.ndarray
    weights: np.ndarray  # (k, d) of the reference model on counts
    bias: np.ndarray     # (k,)

    SCHEMA = "words array<string>, k int, hidden int, comb int, theta array<double>, weights array<double>, bias array<double>"

    def publish(self, spark: SparkSession, path: str) -> None:
        row = (list(self.words), self.k, self.hidden, self.comb, self.theta.tolist(), self.weights.ravel().tolist(), self.bias.tolist())
        spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Release:
        r = spark.read.schema(cls.SCHEMA).parquet(path).first()
        return cls(r.words, r.k, r.hidden, r.comb, np.array(r.theta), np.array(r.weights).reshape(r.k, -1), np.array(r.bias))


def value_rows(rows: DataFrame, release: Release) -> DataFrame:
    """``(row_id, data_value)`` of labelled rows ``(row_id, text, y)``. No step needs another
    row, so this runs on a stream as it does on a table. Unlabelled rows are left out."""
    d, k = len(release.words), release.k
    like = VL.init_params(d, k, release.hidden, release.comb, 0)
    theta, weights, bias, index = release.theta, release.weights, release.bias, {w: i for i, w in enumerate(release.words)}

    def run(batches):
        p = VL.unflatten(theta, like)
        for b in batches:
            if not b.num_rows:
                continue
            n = np.zeros((b.num_rows, d))
            for i, words in enumerate(b.column("t").to_pylist()):
                for w in words or ():
                    j = index.get(w)
                    if j is not None:
                        n[i, j] += 1
            y = np.eye(k)[b.column("y").to_numpy().astype(int)]
            diff = np.abs(y - softmax(n @ weights.T + bias))
            total = n.sum(1, keepdims=True)
            v, _ = VL.forward(p, n / np.where(total > 0, total, 1), y, diff)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(v)], names=["row_id", "data_value"])
    given = rows.filter(F.col("y").isNotNull()).select("row_id", T.tokenize_en("text").alias("t"), F.col("y").cast("int").alias("y"))
    return given.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, data_value double")


def release_of(trainer, words: list, model) -> Release:
    """The release of a trained valuer with a fitted logistic regression as its reference."""
    hidden, comb = trainer.params["W2"].shape
    return Release(words, trainer.data.k, hidden, comb, trainer.theta, model.coefficientMatrix.toArray(), model.interceptVector.toArray())


