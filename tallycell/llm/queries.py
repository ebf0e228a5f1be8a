"""The registered queries of this subpackage, by name, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallycell.llm import (bpe_codec, chat_format, cotraining, exact_dedup, lexical_index, license_scan, merkle, passages, positional_index, simhash_dedup,
                           token_counts, token_files, warc)
from tallycell.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_scan(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages")).drop("html")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional_index.build_index(table(spark, sf_dir, "documents"))
    return positional_index.contamination(index, table(spark, sf_dir, "benchmark"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_chats(rows))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_quality": op7_quality,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_passages": op10_passages,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_files": op12_token_files,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op1_license_scan": license_scan.SQL, "op3_warc": warc.SQL, "op5_decontamination": positional_index.SQL, "op8_chat_format": chat_format.SQL, "op9_exact_dedup": exact_dedup.SQL,
                           "op11_lexical_search": lexical_index.SQL, "op13_merkle": merkle.SQL}
