"""Queries p3 and p6 to p8: nearest times, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartzbar.llm import encoding, nearest_time, packing, sentences
from quartzbar.llm.oracles import SQL  # noqa: F401
from quartzbar.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_time.match_funding(
        table(spark, d, "funding_rates"), table(spark, d, "bars"), table(spark, d, "exchange_responses")
    ).select("funding_id", "side", "match_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_faults(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p6_ids, p7_containers, p7_report, p7_faults, p8_found)}
