"""Queries on sources, periods, streams at rest, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.operators import bad_rows, bar_features, timeframes
from quartzbar.plans import record_oracles
from quartzbar.plans.bars import VALID_SQL, valid
from quartzbar.session import table
from quartzbar.sources.bar_files import parse_kline_messages, parse_kline_rows, with_periods
from quartzbar.streaming.bars_stream import alerts, batch_gap_events

# Sources with what they offer: backfill, archive, live capture, whether they are critical.
SOURCES = {
    "klines_1m": (True, True, True, True), "mark_price_1m": (False, False, True, False), "premium_index_1m": (False, False, True, False),
    "funding_rate": (True, False, True, False), "exchange_info": (False, False, True, False), "leverage_bracket": (False, False, True, False),
    "depth_snapshot": (False, False, True, False), "agg_trades": (False, False, True, False), "liquidation_feed": (False, False, True, False),
    "adl_quantile": (False, False, True, False), "metrics": (True, True, True, False), "regime_classifier": (True, False, True, False),
}
PERIODS = [("up", "2020-01-01 06:00:00", "2020-01-01 12:00:00"), ("down", "2020-01-01 10:00:00", "2020-01-01 18:00:00"), ("range", "2020-01-02 00:00:00", "2020-01-03 00:00:00")]


def gap_events(spark: SparkSession, d: str) -> DataFrame:
    return batch_gap_events(valid(spark, d))


def gap_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts(gap_events(spark, d))


def kline_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every bar written as the message of a closed candle and parsed again."""
    b = table(spark, d, "bars")
    text = lambda c: F.col(c).cast("string")
    k = F.struct(
        F.expr("unix_micros(CAST(open_time AS TIMESTAMP)) DIV 1000").alias("t"), text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c"),
        text("volume").alias("v"), text("quote_volume").alias("q"), F.col("number_of_trades").alias("n"), text("taker_buy_base_volume").alias("V"),
        text("taker_buy_quote_volume").alias("Q"), F.lit(True).alias("x"),
    )
    parsed = parse_kline_messages(b.select(F.to_json(F.struct(F.col("symbol").alias("s"), k.alias("k"))).alias("value")), "value")
    return parsed.select("symbol", F.unix_micros("open_time").alias("t_us"), "open", "high", "low", "close", "volume", "quote_volume", "number_of_trades", "taker_buy_base_volume")


def kline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every archive record that is a valid bar, read as an API row."""
    p = parse_kline_rows(bad_rows.api_rows(table(spark, d, "archive_records")), "row")
    return p.select(F.unix_micros("open_time").alias("t_us"), "open", "high", "low", "close", "volume", "quote_volume", "number_of_trades")


def bars_in_periods(spark: SparkSession, d: str) -> DataFrame:
    """Bars by symbol and the first period they are in."""
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(PERIODS)], "rank int, regime string, start string, end_exclusive string")
    p = p.select("rank", "regime", F.to_timestamp("start").alias("start"), F.to_timestamp("end_exclusive").alias("end_exclusive"))
    b = table(spark, d, "bars").select("symbol", F.col("open_time").cast("timestamp").alias("open_time"))
    return with_periods(b, p, "none").groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


def source_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grade of each source: D critical without live capture, A with all three, B with backfill and live, else C."""
    s = spark.createDataFrame([(k, *v) for k, v in SOURCES.items()], "source string, backfill boolean, archive boolean, live boolean, critical boolean")
    grade = (
        F.when(F.col("critical") & ~F.col("live"), "D").when(F.col("backfill") & F.col("archive") & F.col("live"), "A")
        .when(F.col("backfill") & F.col("live"), "B").otherwise("C")
    )
    return s.select("source", grade.alias("grade"))


def _registry() -> list[tuple[str, str, str, float]]:
    named = [(n, f) for f, names in bar_features.FAMILIES.items() for n in names]
    named += [(n, f"timeframe_{tf}") for tf in timeframes.FRAMES for n in timeframes.names(tf)]
    return [(n, f, bar_features.clip_class(n), bar_features.CLIP_LIMITS[bar_features.clip_class(n)]) for n, f in named]


def feature_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_registry(), "feature string, family string, class string, clip_abs double")


def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol of the instruments a hash of its canonical text: equal rows, equal hash."""
    i = table(spark, d, "instruments")
    text = F.concat_ws("|", "symbol", F.col("tick_size").cast("decimal(20,8)").cast("string"), F.col("lot_size").cast("decimal(20,8)").cast("string"), F.col("funding_interval_min").cast("string"))
    return i.select("symbol", F.sha2(text, 256).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_events, gap_alerts, kline_messages, kline_rows, bars_in_periods, source_grades, feature_registry, row_hashes,
    )
}

_GAPS = f"""
SELECT symbol, m + 1 AS minute, nx - m - 1 AS missing, CASE WHEN nx - m - 1 >= 3 THEN 'stream_desync' WHEN nx - m - 1 = 2 THEN 'gap_cross_timeout' ELSE 'gap' END AS kind
FROM (SELECT symbol, m, lead(m) OVER (PARTITION BY symbol ORDER BY m) AS nx FROM ({VALID_SQL})) WHERE nx > m + 1
"""
SQL = {
    "gap_events": _GAPS,
    "gap_alerts": f"""
WITH e AS ({_GAPS}) SELECT 'desync' AS rule, symbol, minute FROM e WHERE kind = 'stream_desync' UNION ALL SELECT 'long_gap', symbol, minute FROM e WHERE missing >= 10
""",
    "kline_messages": """
SELECT symbol, epoch_us(open_time) // 1000 * 1000 AS t_us, open, high, low, close, volume, quote_volume, CAST(number_of_trades AS DOUBLE) AS number_of_trades, taker_buy_base_volume FROM bars
""",
    "kline_rows": record_oracles.SQL["kline_rows"],
    "bars_in_periods": """
SELECT symbol, CASE WHEN t >= TIMESTAMP '2020-01-01 06:00:00' AND t < TIMESTAMP '2020-01-01 12:00:00' THEN 'up' WHEN t >= TIMESTAMP '2020-01-01 10:00:00' AND t < TIMESTAMP '2020-01-01 18:00:00' THEN 'down'
  WHEN t >= TIMESTAMP '2020-01-02 00:00:00' AND t < TIMESTAMP '2020-01-03 00:00:00' THEN 'range' ELSE 'none' END AS regime, count(*) AS n
FROM (SELECT symbol, make_timestamp(epoch_us(open_time)) AS t FROM bars) GROUP BY ALL
""",
    "source_grades": """
SELECT source, CASE WHEN live = 0 AND source = 'klines_1m' THEN 'D' WHEN backfill + archive + live = 3 THEN 'A' WHEN backfill = 1 AND live = 1 THEN 'B' ELSE 'C' END AS grade
FROM (SELECT source, CAST(source IN ('klines_1m', 'funding_rate', 'metrics', 'regime_classifier') AS INTEGER) AS backfill, CAST(source IN ('klines_1m', 'metrics') AS INTEGER) AS archive, 1 AS live
      FROM (SELECT unnest(['klines_1m', 'mark_price_1m', 'premium_index_1m', 'funding_rate', 'exchange_info', 'leverage_bracket', 'depth_snapshot', 'agg_trades', 'liquidation_feed', 'adl_quantile', 'metrics', 'regime_classifier']) AS source))
""",
    "feature_registry": "SELECT feature, family, class, CAST(clip_abs AS DOUBLE) AS clip_abs FROM (VALUES " + ", ".join(f"('{n}', '{f}', '{c}', {x})" for n, f, c, x in _registry()) + ") AS s(feature, family, class, clip_abs)",
    "row_hashes": "SELECT symbol, sha256(symbol || '|' || CAST(CAST(tick_size AS DECIMAL(20, 8)) AS VARCHAR) || '|' || CAST(CAST(lot_size AS DECIMAL(20, 8)) AS VARCHAR) || '|' || CAST(funding_interval_min AS VARCHAR)) AS hash FROM instruments",
}
