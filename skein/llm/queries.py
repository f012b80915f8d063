"""Queries of the llm operators over a folder of tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import oracles
from skein.llm.conversations import conversations, find_broken
from skein.llm.language import find_unnamed_languages, label_documents, label_segments
from skein.llm.mixing import mix, mixing_checks
from skein.llm.packing import fill_report, pack, packing_checks
from skein.llm.pairs import find_defects, label_pairs
from skein.llm.text_quality import find_not_prose, text_stats
from skein.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _capacity(spark: SparkSession, d: str, container: str) -> int:
    return int(table(spark, d, "capacities").where(f"container = '{container}'").first()["max_tokens"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_broken(table(spark, d, "messages"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_unnamed_languages(table(spark, d, "documents"), table(spark, d, "common_words"))


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    return label_documents(table(spark, d, "documents"), table(spark, d, "common_words"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return label_segments(table(spark, d, "documents"), table(spark, d, "common_words"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return find_defects(table(spark, d, "turns"), table(spark, d, "documents"), table(spark, d, "common_words"))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return label_pairs(table(spark, d, "turns"), table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), _capacity(spark, d, "medium"))


def p8_packed_small(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), _capacity(spark, d, "small"))


def p8_packed_large(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), _capacity(spark, d, "large"))


def _of_each_container(spark: SparkSession, d: str, made: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    documents = table(spark, d, "documents")
    parts = []
    for r in table(spark, d, "capacities").orderBy("container").collect():  # a configuration of some rows
        packed = written(pack(documents, r.max_tokens))
        parts.append(made(documents, packed, r.max_tokens).select(F.lit(r.container).alias("kind"), "*"))
    return reduce(DataFrame.unionByName, parts)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return _of_each_container(spark, d, lambda _, packed, size: fill_report(packed, size))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return _of_each_container(spark, d, packing_checks)


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing_checks(*mix(documents, targets), documents)


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), target_entropy=1.6)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_stats(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p2_conversations, p3_found, p3_documents, p3_segments, p4_found, p4_labels, p8_packed, p8_packed_small, p8_packed_large, p8_fill, p8_checks, p9_selection, p9_shares, p9_checks, p9_tempered, p10_found, p10_stats)
}
ORACLES: dict[str, str] = {"p2_found": oracles.P2, "p2_conversations": oracles.P2_CONVERSATIONS, "p8_checks": oracles.P8_CHECKS, "p9_checks": oracles.P9_CHECKS}
