"""Queries on controls: shuffled labels, score bins, flips, detrended levels, entries into zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.windows import rounded
from quartzbar.operators import bar_features, controls
from quartzbar.plans.bars import CANONICAL_SQL, canonical
from quartzbar.plans.evaluation import _one, _with_scored, scored
from quartzbar.plans.learning_data import _LABELS, barrier_labels

SEED = 11


def shuffled_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = barrier_labels(spark, d).select("symbol", F.col("idx").alias("start"), "label")
    return controls.shuffled(rows, "label", SEED)


def score_bins(spark: SparkSession, d: str) -> DataFrame:
    return controls.score_bins(scored(spark, d)).selectExpr("bin", "n", *rounded(["rate", "lower", "upper"]))


def flip_rate(spark: SparkSession, d: str) -> DataFrame:
    return controls.flip_rate(scored(spark, d).selectExpr("symbol", "idx", "round(p, 9) AS p"), 0.5).selectExpr("symbol", "rows", "flips", *rounded(["rate"]))


def detrended_levels(spark: SparkSession, d: str) -> DataFrame:
    return controls.detrended(canonical(spark, d), 60).selectExpr("symbol", "idx", *rounded(["level"]))


def _block_rows(spark: SparkSession, d: str) -> DataFrame:
    f = bar_features.with_features(canonical(spark, d), "zscores", "activity", keep=("open", "high", "low", "close"))
    return f.select("symbol", "idx", "open", "high", "low", "close", "volume_zscore_20", "taker_imbalance")


def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    return controls.order_blocks(_block_rows(spark, d)).select("symbol", "idx", "side")


def order_block_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = _block_rows(spark, d)
    entries = controls.zone_entries(rows, controls.order_blocks(rows))
    return entries.selectExpr("symbol", "idx", "block_idx", "signal", *rounded(["confidence"]))


_BLOCKS = f"""
f AS MATERIALIZED (
  SELECT symbol, idx, open, high, low, close, coalesce((2 * taker_buy_base_volume - volume) / nullif(volume, 0), 0) AS flow,
         CASE WHEN count(*) OVER w = 20 AND stddev_pop(volume) OVER w > 1e-12 * avg(volume) OVER w THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w ELSE 0 END AS loud
  FROM ({CANONICAL_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), fits AS MATERIALIZED (
  SELECT symbol, idx FROM f
  WHERE close <> open AND abs(close - open) / (high - low) >= 0.6 AND greatest((high - greatest(open, close)) / (high - low), (least(open, close) - low) / (high - low)) <= 0.2
    AND loud >= 1 AND abs(flow) >= 0.3
), blocks AS (
  SELECT symbol, min(idx) AS idx FROM fits GROUP BY symbol
  UNION ALL
  SELECT b.symbol, min(n.idx) FROM blocks AS b JOIN fits AS n ON n.symbol = b.symbol AND n.idx >= b.idx + 5 GROUP BY b.symbol
)"""

QUERIES = {
    f.__name__: f
    for f in (shuffled_labels, score_bins, flip_rate, detrended_levels, order_blocks, order_block_entries)
}
SQL = {
    "shuffled_labels": f"""
WITH l AS MATERIALIZED (SELECT symbol, idx, label FROM ({_LABELS})),
a AS (SELECT symbol, idx, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k FROM l),
b AS (SELECT symbol, label, row_number() OVER (PARTITION BY symbol ORDER BY CAST('0x' || substr(md5(symbol || '/' || idx || '/{SEED}'), 1, 15) AS BIGINT)) AS k FROM l)
SELECT symbol, idx AS start, label FROM a JOIN b USING (symbol, k)
""",
    "score_bins": _with_scored(f""", g AS (SELECT least(CAST(floor(p * 20) AS INTEGER), 19) AS bin, count(*) AS n, avg(y) AS r FROM scored GROUP BY ALL)
SELECT bin, n, {_one("r", "rate")}, {_one("greatest(0, r - 1.96 * sqrt(r * (1 - r) / n))", "lower")}, {_one("least(1, r + 1.96 * sqrt(r * (1 - r) / n))", "upper")} FROM g
""").replace(") , g", "), g"),
    "flip_rate": _with_scored(f""", s AS (SELECT symbol, idx, CASE WHEN round(p, 9) >= 0.5 THEN 1 ELSE 0 END AS side FROM scored),
f AS (SELECT symbol, CASE WHEN lag(side) OVER (PARTITION BY symbol ORDER BY idx) <> side THEN 1 ELSE 0 END AS flip FROM s)
SELECT symbol, count(*) AS rows, CAST(sum(flip) AS BIGINT) AS flips, {_one("sum(flip) / greatest(count(*) - 1, 1)", "rate")} FROM f GROUP BY symbol
""").replace(") , s", "), s"),
    "detrended_levels": f"""
WITH c AS ({CANONICAL_SQL}), x AS (
  SELECT symbol, idx, ln(close) - avg(CASE WHEN gap_flag = 0 THEN ln(close) END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS level FROM c
)
SELECT symbol, idx, {_one("level", "level")} FROM x
""",
    "order_blocks": f"""
WITH RECURSIVE {_BLOCKS} SELECT symbol, idx, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS side FROM blocks JOIN f USING (symbol, idx)
""",
    "order_block_entries": f"""
WITH RECURSIVE {_BLOCKS}, z AS (SELECT symbol, idx, close > open AS up, low, high FROM blocks JOIN f USING (symbol, idx)),
e AS (
  SELECT f.symbol, f.idx, max(z.idx) AS block_idx, arg_max(z.up, z.idx) AS up, any_value(f.flow) AS flow
  FROM f JOIN z ON z.symbol = f.symbol AND z.idx BETWEEN f.idx - 9 AND f.idx AND f.close BETWEEN z.low AND z.high GROUP BY f.symbol, f.idx
)
SELECT symbol, idx, block_idx, CASE WHEN up THEN 'BUY' ELSE 'SELL' END AS signal, {_one("least(1, abs(flow)) * 0.8 + 0.2", "confidence")} FROM e
""",
}
