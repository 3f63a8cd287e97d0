"""Queries p1, p2, p4 and p5: raw feeds, readings and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartzbar.operators import bad_rows, regular_grid, schema_drift, spikes
from quartzbar.plans import drift_oracle, record_oracles
from quartzbar.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    changes = schema_drift.schema_changes(table(spark, d, "feed_files"), table(spark, d, "feed_rows"))
    return changes.where("change <> 'alternative'").select("file_id", "field", "change")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "feed_files"), table(spark, d, "feed_rows"))


def p1_bars(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_bars(table(spark, d, "feed_files"), table(spark, d, "feed_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = spikes.implausible_readings(table(spark, d, "bars"), table(spark, d, "depth_snapshots"))
    return found.select("src", "row_id", "field")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "bars"), table(spark, d, "depth_snapshots"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "bars"), table(spark, d, "coverage_windows"))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """Fits and supports have the precision of a float; readings are as they are."""
    single = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    return _grid(spark, d).selectExpr(
        "symbol", "minute_ms", "missing", "status", "readings", *(f"IF(missing, {single(c)}, {c}) AS {c}" for c in ("close", "volume")), *(f"{single(c)} AS {c}" for c in ("close_fit", "volume_fit", "support"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("missing").select("symbol", "minute_ms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.parse_records(table(spark, d, "archive_records")).where("reason IS NOT NULL").select("rec_id", "reason")


def p5_bars(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.parse_records(table(spark, d, "archive_records")).where("reason IS NULL").drop("reason", "detail")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_bars, p2_found, p2_report, p4_found, p4_grid, p5_found, p5_bars)}

SQL = {
    "p4_found": """
WITH readings AS (
  SELECT DISTINCT symbol, CAST(floor((epoch_us(open_time) + 30000000) / 60000000) AS BIGINT) AS m
  FROM bars WHERE close IS NOT NULL AND volume IS NOT NULL AND NOT isnan(close) AND NOT isnan(volume)
), grid AS (
  SELECT symbol, unnest(range(CAST(epoch_us(start_time) // 60000000 AS BIGINT), CAST(epoch_us(end_time) // 60000000 AS BIGINT))) AS m
  FROM coverage_windows
)
SELECT symbol, m * 60000 AS minute_ms FROM grid ANTI JOIN readings USING (symbol, m)
""",
} | {n: record_oracles.SQL[n] for n in ("p4_grid", "p5_found", "p5_bars")} | drift_oracle.SQL
