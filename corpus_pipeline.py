"""Corpus pipeline: quality filter, near-dedup, decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, minhash, mixing, quality, tokens
from corvane.llm.tables import keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those whose probability is below one half. Word
    vectors come from all of docs, the network from the labelled ones.

    Null, empty and blank texts have probability 0 and go. Very long texts are judged whole. Rows with a
    null doc_id are judged like others. Repeated rows go or stay together. Empty docs: empty result.
    Columns of any name pass through.
    """
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), rows=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least doc_id.

    Texts without words (null, empty, only punctuation) and rows with a null doc_id stay. Very long
    texts are compared whole. Of rows that repeat doc_id and text one stays, the least by its other
    columns. Empty docs: empty result. Columns of any name pass through.
    """
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of 13 words with a benchmark item go.

    Null and empty texts and rows with a null doc_id stay. Very long texts are searched whole. Repeated
    rows go or stay together, with all rows of their doc_id. Empty docs or benchmark: docs as they are.
    Columns of any name pass through.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are sampled to their token budgets; a document that is taken twice is there twice. Keys are
    scaled by the classifier's probability, trained on all documents as they were before any stage.

    Null, empty and blank texts have the smallest weight and no tokens. Very long texts are counted
    whole; one that doesn't fit ends its source's prefix. Rows with a null doc_id share one random
    number; a null source is a source of its own. Repeated rows, and ties in the key, are taken or left
    together. Empty docs: empty result. Columns of any name pass through.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = "_p_quality"
    while name in docs.columns:
        name += "_"
    weighted = keep(docs.withColumn(name, quality.p_quality(docs, model)), "weighted")
    return mixing.mix_sources(weighted, rows=True, weight=name).drop(name)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by shard, with the index of their keys (doc_id, copy).

    Null texts have null ids, empty ones empty ids. Very long texts are encoded whole. Rows with a null
    doc_id are kept, spread over the shards. Repeated rows are copies 0, 1, ... of their doc_id. Empty
    docs: empty result. Other columns are ignored, whatever their names.
    """
    return tokens.token_index(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_ids", write_token_ids),
]

#: Signatures, fingerprints, trained weights and BPE have no SQL; tests/llm/test_pipeline.py compares the stages after the classifier with brute force and plain loops, the classifier with its operator's result (which tests/llm/test_operators.py checks).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
