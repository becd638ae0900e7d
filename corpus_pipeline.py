"""The corpus pipeline: raw documents to packed token files.

STAGES are applied in order by :func:`run`; each stage's rows are written as Parquet in the shared folder and read again
as the documents of the next one. All stages but the last keep the columns of ``documents``, whatever they are, also extra
ones whose names clash with the operators' own. Very long texts are handled whole, and no rows give no rows everywhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import recorded, release, stage
from siltstone.llm.op01_language import known_language
from siltstone.llm.op02_mixing import mixed_documents
from siltstone.llm.op04_tokens import read_tokens, write_tokens
from siltstone.llm.op05_decontamination import clean_documents
from siltstone.llm.op06_jaccard import one_of_each


_held: list[str] = []


def _apart(function: Callable) -> Callable:
    """A stage that first deletes what the one before had staged on its way: that one's rows are written by then."""

    @wraps(function)
    def stage_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        with recorded(_held):
            return function(spark, docs, sf_dir)

    return stage_apart


@_apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null, empty and letterless texts go; repeated rows stay or go together. Without
    any labelled row no language is learned and all go."""
    return known_language(docs)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group linked by a Jaccard similarity of 0.8 over five-word shingles. Of
    repeated rows one stays; texts without words are linked with nothing and stay; a null doc_id comes after all others."""
    return one_of_each(docs, k=5, percent=80)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Null and empty texts stay, repeated rows stay or go
    together; null or wordless benchmark items take nothing out."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, equal rows one by one. A null source is a source of its own; null
    and empty texts add nothing to a target and stay or go with their hash."""
    return mixed_documents(docs)


@_apart
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the token files. A null text is empty and has the end id alone; a null doc_id comes first, ties
    are in order of their texts, repeated rows are documents of their own."""
    return read_tokens(write_tokens(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A trained model and near-duplicate groups aren't expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
