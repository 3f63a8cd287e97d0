"""Queries that write bars to files and read them again by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.fields import ARCHIVE_CSV_FIELDS
from quartzbar.plans.bars import VALID_SQL, valid
from quartzbar.session import shared_folder
from quartzbar.sources import bar_files, sinks

_PRICES = ("open", "high", "low", "close", "volume")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _composite(spark: SparkSession, d: str) -> DataFrame:
    """One bar per minute over all symbols: least open and low, greatest high, close and volume, all trades."""
    v = valid(spark, d).groupBy("m").agg(
        F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.max("volume").alias("volume"),
        F.sum("number_of_trades").alias("number_of_trades"),
    )
    return v.withColumn("open_time", F.timestamp_micros(F.col("m") * 60_000_000))


def _out(bars: DataFrame) -> DataFrame:
    return bars.select(F.unix_micros("open_time").alias("t_us"), *_PRICES, F.col("number_of_trades").cast("double").alias("number_of_trades"))


def bars_through_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = _composite(spark, d).select(F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("open_time"), *_PRICES, "number_of_trades")
    sinks.write_bars(rows, folder, "csv")
    return _out(bar_files.read_csv_bars(spark, folder))


def bars_through_archive(spark: SparkSession, d: str) -> DataFrame:
    """Files of the archive's columns without a header, each in order of time."""
    folder = _folder(spark)
    values = {"open_time": (F.col("m") * 60_000).cast("string"), "close_time": (F.col("m") * 60_000 + 59_999).cast("string"), "count": F.col("number_of_trades").cast("string"), "ignore": F.lit("0")}
    rows = _composite(spark, d).repartitionByRange(4, "m").sortWithinPartitions("m")
    rows.select(*((values[c] if c in values else F.col(c).cast("string") if c in _PRICES else F.lit("0")).alias(c) for c in ARCHIVE_CSV_FIELDS)).write.csv(folder)
    return _out(bar_files.read_archive_csv(spark, f"{folder}/*.csv"))


def bars_through_parquet(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    v = valid(spark, d).select("symbol", F.timestamp_micros(F.col("m") * 60_000_000).alias("open_time"), *_PRICES, "number_of_trades")
    sinks.write_bars(v, folder)
    back = bar_files.read_parquet_bars(spark, folder)
    return back.select("symbol", "month", F.unix_micros("open_time").alias("t_us"), *_PRICES, "number_of_trades")


QUERIES = {f.__name__: f for f in (bars_through_csv, bars_through_archive, bars_through_parquet)}
_COMPOSITE_SQL = f"""
SELECT m * 60000000 AS t_us, min(open) AS open, max(high) AS high, min(low) AS low, max(close) AS close, max(volume) AS volume, sum(number_of_trades) AS number_of_trades FROM ({VALID_SQL}) GROUP BY m
"""
SQL = {
    "bars_through_csv": _COMPOSITE_SQL,
    "bars_through_archive": _COMPOSITE_SQL,
    "bars_through_parquet": f"""
SELECT symbol, strftime(make_timestamp(CAST(m AS BIGINT) * 60000000), '%Y-%m') AS month, m * 60000000 AS t_us, open, high, low, close, volume, number_of_trades FROM ({VALID_SQL})
""",
}
