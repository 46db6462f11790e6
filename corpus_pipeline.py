"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token shards.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All stages but the last return the columns of ``documents``.

Since a stage's input is always written out, a stage begins by deleting the scratch tables
that the stages before it left in the shared folder.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, token_store
from tessera.llm.common import delete, release, scratch_paths
from tessera.llm.queries import TOKENIZER
from tessera.session import ensure_checkpoint_dir
from tessera.tables import table


_LEFT: dict[str, list[str]] = {}  # by application: scratch tables of the last stage that ran


def _stage(fn):
    """A stage that first deletes what the stage before it left in the shared folder."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _LEFT.pop(app, []))
        before = set(scratch_paths(spark))
        out = fn(spark, docs, sf_dir)
        _LEFT[app] = [p for p in scratch_paths(spark) if p not in before]
        return out
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the next stage puts documents in order of doc_id, so the shards' order isn't kept
    return mixing.mixed_documents(docs, ordered=False)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.documents(spark, token_store.store(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

ORACLE_SQL = None  # SimHash, edit verification and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    release(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
    return docs
