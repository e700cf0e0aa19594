"""The corpus pipeline: five stages over ``documents``, each over all that the stage
before it kept. Part of the training-data operators (``graphloom.llm``)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, exact_dedup, mixing, ngram_join, quality
from graphloom.llm.common import stored
from graphloom.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.5 or more stays)."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, weights, ["doc_id", "lang", "source", "n_chars", "text"]).filter("score >= 0.5").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, that with the largest doc_id."""
    return exact_dedup.distinct_documents(docs, COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: that with the
    smallest doc_id. Documents without a doc_id stay."""
    found = ngram_join.ngram_components(docs, k=5, percent=80)
    gone = found.filter("doc_id is not null and component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents once or twice as their source's target asks, in
    the order of the schedule."""
    return mixing.mixed_documents(docs, mixing.mix(docs, identity=COLUMNS), COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: Training and byte-pair merges have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
