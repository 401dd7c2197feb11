"""A training-data pipeline of five stages over ``documents``.

Each stage reads what its predecessor kept, written as Parquet, and its decisions
take effect: a quality draw, exact and near duplicates, benchmark passages, and
encoding of what is left. A stage's intermediate tables are deleted when the next one
begins, for its output is written by then.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bpe, decontaminate, exact_dedup, importance, jaccard_join
from turnloom.llm.common import cut, new_folder, table
from turnloom.sources.tables import made_since, release

#: Folders of intermediate tables of the stage that ran last.
_last: list[str] = []


def _stage(work):
    """A stage that begins by deleting its predecessor's intermediate tables."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_last)
        mark = len(made_since(0))
        out = work(spark, docs, sf_dir)
        _last[:] = made_since(mark)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.Resampler(docs, table(spark, sf_dir, "labels")).kept_rows()


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.bpe_decode(bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), path)
    return coded.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]

#: The draw and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = new_folder(spark, "pipeline")
            docs = cut(docs, path)
            release(before)  # the stage that read it has been written
            before = [path]
    return docs
