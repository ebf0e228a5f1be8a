"""From raw documents to training tokens: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycell.llm import bpe_codec, cotraining, exact_dedup, positional_index, simhash_dedup
from tallycell.llm.common import scratch, table, written
from tallycell.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels among them, finds good."""
    return cotraining.keep_good(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id."""
    return simhash_dedup.without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Every row is judged by its own text, also those without doc_id and those
    that share one: the index names rows by numbers that are written first, so they stay the same."""
    with scratch(spark) as keep:
        rows = keep(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
        index = positional_index.build_index(rows.select(F.col("number").alias("doc_id"), "row.text"))
        found = positional_index.contamination(index, table(spark, sf_dir, "benchmark")).filter("contaminated")
        dirty = keep(found.select(F.col("doc_id").alias("number")), "contaminated")
    return rows.join(dirty, "number", "left_anti").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the token ids and of what they decode to."""
    return bpe_codec.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("bpe", encoded)]
#: A trained classifier and a tokenizer take part: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
