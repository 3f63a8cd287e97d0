"""Queries on external features, labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.windows import frame, rounded
from quartzbar.operators import external_features, labels, splits
from quartzbar.plans.bars import CANONICAL_SQL, canonical
from quartzbar.session import table

BOOK = ("spread", "spread_bps", "bid_ask_imbalance", "order_book_pressure", "best_bid_qty_ratio", "best_ask_qty_ratio", "microprice_deviation")
FUNDING = ("funding_rate", "next_funding_rate", "minutes_to_next_funding", "funding_blackout_active")
HORIZON, TP, SL, THRESHOLD = 60, 0.01, 0.005, 0.001
SPLIT_HORIZON, EMBARGO = 15, 10


def features_book(spark: SparkSession, d: str) -> DataFrame:
    rows = external_features.book_features(canonical(spark, d), table(spark, d, "depth_snapshots"))
    return rows.selectExpr("symbol", "idx", *rounded(list(BOOK)))


def features_funding(spark: SparkSession, d: str) -> DataFrame:
    rows = external_features.funding_features(canonical(spark, d), table(spark, d, "funding_rates"))
    return rows.selectExpr("symbol", "idx", *rounded(list(FUNDING), 8))


def metrics_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of five minutes made of the events: a stand-in for exchange metrics."""
    e = table(spark, d, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 300_000_000)
    ticks = e.groupBy(F.col("event_type").alias("symbol"), t.alias("idx")).agg(
        F.count(F.lit(1)).cast("double").alias("open_interest"), F.sum("value").alias("open_interest_value"), (F.max("value") / F.avg("value")).alias("taker_ratio")
    )
    return ticks


def features_metrics(spark: SparkSession, d: str) -> DataFrame:
    # Row numbers of ticks, as lags count ticks.
    from pyspark.sql import Window

    ticks = metrics_ticks(spark, d).withColumn("tick", F.col("idx")).withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("tick")) - 1)
    return external_features.metrics_features(ticks).selectExpr("symbol", "idx", *rounded(list(external_features.METRICS)))


def barrier_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.triple_barriers(canonical(spark, d), HORIZON, TP, SL, THRESHOLD)
    return rows.selectExpr(*(c for c in rows.columns if c != "target_return"), *rounded(["target_return"]))


def label_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.reason_counts(labels.triple_barriers(canonical(spark, d), HORIZON, TP, SL, THRESHOLD))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Minutes that were read, each with the interval of its label."""
    return canonical(spark, d).where("gap_flag = 0").select("symbol", F.col("idx").alias("start"), (F.col("idx") + SPLIT_HORIZON).alias("end"))


def uniqueness_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.uniqueness_weights(samples(spark, d))
    return rows.selectExpr("symbol", "start", "`end`", *rounded(["weight"]))


def combinatorial_purged_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.combinatorial_purged(samples(spark, d), 5, 2, EMBARGO)
    return rows.groupBy("symbol", "split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def walk_forward_splits(spark: SparkSession, d: str) -> DataFrame:
    counts = samples(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return splits.walk_forward(counts, 120, 40, 40, SPLIT_HORIZON)


QUERIES = {
    f.__name__: f
    for f in (
        features_book, features_funding, features_metrics, barrier_labels, label_reason_counts, uniqueness_weights,
        combinatorial_purged_splits, walk_forward_splits,
    )
}

_NORM = "regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g')"
_LABELS = f"""
WITH c AS MATERIALIZED (SELECT symbol, idx, open, high, low, close, gap_flag FROM ({CANONICAL_SQL})),
last AS (SELECT symbol, max(idx) AS n FROM c GROUP BY symbol),
j AS (
  SELECT a.symbol, a.idx, b.idx AS k, b.close > b.open AS up, b.close < b.open AS down, b.gap_flag = 1 AS gap,
         b.high >= a.close * (1 + {TP}) AS tp, b.low <= a.close * (1 - {SL}) AS sl, b.low <= a.close * (1 - {TP}) AS stp, b.high >= a.close * (1 + {SL}) AS ssl,
         CASE WHEN b.idx = a.idx + {HORIZON} THEN (b.close - a.close) / a.close END AS ret
  FROM c AS a JOIN last USING (symbol) JOIN c AS b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + {HORIZON} WHERE a.idx + {HORIZON} <= last.n
), f AS (
  SELECT symbol, idx, max(ret) AS ret, bool_or(gap) AS any_gap,
         arg_min({{'tp': tp, 'sl': sl, 'up': up, 'down': down, 'gap': gap}}, k) FILTER (tp OR sl) AS x,
         arg_min({{'tp': stp, 'sl': ssl, 'down': down}}, k) FILTER (stp OR ssl) AS s
  FROM j GROUP BY symbol, idx
)
SELECT symbol, idx,
  CAST(CASE WHEN x IS NULL THEN ret > {THRESHOLD} WHEN x.tp AND x.sl THEN x.up ELSE x.tp END AS INTEGER) AS label,
  CASE WHEN x IS NULL THEN CASE WHEN any_gap THEN 'gap_cross_timeout' ELSE 'timeout_no_tp' END
       WHEN x.tp AND x.sl THEN CASE WHEN x.up THEN 'tp_first' WHEN x.down THEN 'sl_first' ELSE 'ambiguous_path' END
       WHEN x.tp THEN 'tp_first' WHEN x.gap THEN 'gap_cross_sl' ELSE 'sl_first' END AS label_reason,
  CAST(CASE WHEN x IS NULL THEN false WHEN x.tp AND x.sl THEN x.up ELSE x.tp END AS INTEGER) AS long_success,
  CASE WHEN x IS NULL THEN 'long_timeout' WHEN (x.tp AND x.sl AND x.up) OR (x.tp AND NOT x.sl) THEN 'long_tp_first' ELSE 'long_sl_first' END AS long_reason,
  CAST(CASE WHEN s IS NULL THEN false WHEN s.tp AND s.sl THEN s.down ELSE s.tp END AS INTEGER) AS short_success,
  CASE WHEN s IS NULL THEN 'short_timeout' WHEN (s.tp AND s.sl AND s.down) OR (s.tp AND NOT s.sl) THEN 'short_tp_first' ELSE 'short_sl_first' END AS short_reason,
  CAST(ret > 0 AS INTEGER) AS direction, {rounded(["ret"])[0].removesuffix(" AS ret")} AS target_return
FROM f
"""
_SAMPLES = f"SELECT symbol, idx AS s, idx + {SPLIT_HORIZON} AS e FROM ({CANONICAL_SQL}) WHERE gap_flag = 0"
SQL = {
    "features_book": f"""
WITH d AS (
  SELECT symbol, epoch_us(snapshot_time) AS t, arg_max({{'b': best_bid, 'a': best_ask, 'bq': bid_qty, 'aq': ask_qty, 'mp': microprice}}, (epoch_us(arrived_at), snapshot_id)) AS v
  FROM depth_snapshots WHERE best_bid > 0 AND best_ask > 0 GROUP BY ALL
), j AS (SELECT c.symbol, c.idx, v.b, v.a, v.bq, v.aq, v.mp, (v.a + v.b) / 2 AS mid FROM ({CANONICAL_SQL}) AS c ASOF LEFT JOIN d ON d.symbol = c.symbol AND c.m * 60000000 >= d.t),
f AS (
  SELECT symbol, idx, coalesce((a - b) / nullif(mid, 0), 0.0001) AS spread, 10000 * coalesce((a - b) / nullif(mid, 0), 0.0001) AS spread_bps,
    coalesce((bq - aq) / nullif(bq + aq, 0), 0) AS bid_ask_imbalance, coalesce((bq - aq) / nullif(bq + aq, 0), 0) AS order_book_pressure,
    coalesce(bq / nullif(bq + aq, 0), 0.5) AS best_bid_qty_ratio, coalesce(aq / nullif(bq + aq, 0), 0.5) AS best_ask_qty_ratio,
    coalesce((mp - mid) / nullif(mid, 0), 0) AS microprice_deviation FROM j
)
SELECT symbol, idx, {", ".join(rounded(list(BOOK)))} FROM f
""",
    "features_metrics": f"""
WITH t AS (
  SELECT event_type AS symbol, epoch_us(ts) // 300000000 AS tick, CAST(count(*) AS DOUBLE) AS open_interest, sum(value) AS open_interest_value, max(value) / avg(value) AS taker_ratio
  FROM events GROUP BY ALL
), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tick) - 1 AS idx FROM t),
f AS (SELECT symbol, CAST(idx AS INTEGER) AS idx, {", ".join(f"{frame(e, 'symbol')} AS {n}" for n, e in external_features.METRICS.items())} FROM n)
SELECT symbol, idx, {", ".join(rounded(list(external_features.METRICS)))} FROM f
""",
    "barrier_labels": _LABELS,
    "label_reason_counts": f"""
WITH r AS (SELECT unnest([{", ".join(f"'{r}'" for r in labels.REASONS)}]) AS label_reason)
SELECT label_reason, count(l.idx) AS n FROM r LEFT JOIN ({_LABELS}) AS l USING (label_reason) GROUP BY ALL
""",
    "uniqueness_weights": f"""
WITH x AS MATERIALIZED ({_SAMPLES}),
d AS (SELECT symbol, i, sum(d) AS d FROM (SELECT symbol, s AS i, 1 AS d FROM x UNION ALL SELECT symbol, e + 1, -1 FROM x) GROUP BY ALL),
g AS (SELECT symbol, unnest(range(min(i), max(i) + 1)) AS i FROM d GROUP BY symbol),
c AS (SELECT g.symbol, g.i, sum(coalesce(d, 0)) OVER (PARTITION BY g.symbol ORDER BY g.i) AS n FROM g LEFT JOIN d USING (symbol, i)),
p AS (SELECT symbol, i, sum(CASE WHEN n > 0 THEN 1.0 / n ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS upto, CASE WHEN n > 0 THEN 1.0 / n ELSE 0 END AS own FROM c),
w AS (SELECT x.symbol, x.s AS start, x.e AS "end", (b.upto - a.upto + a.own) / (x.e - x.s + 1) AS weight FROM x JOIN p AS a ON a.symbol = x.symbol AND a.i = x.s JOIN p AS b ON b.symbol = x.symbol AND b.i = x.e)
SELECT symbol, start, "end", {rounded(["weight"])[0]} FROM w
""",
    "combinatorial_purged_splits": f"""
WITH x AS MATERIALIZED (SELECT symbol, s, e, ntile(5) OVER (PARTITION BY symbol ORDER BY s) - 1 AS g FROM ({_SAMPLES})),
sp AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(5) AS p(a), range(5) AS q(b) WHERE a < b),
gs AS (SELECT symbol, g, min(s) AS a, max(e) AS b FROM x GROUP BY ALL),
r AS (
  SELECT x.symbol, sp.split, x.s, x.e, CASE WHEN x.g IN (sp.a, sp.b) THEN 'test'
    WHEN (x.s <= u.b AND u.a <= x.e) OR (x.s <= v.b AND v.a <= x.e) THEN 'purged'
    WHEN (x.s > u.b AND x.s <= u.b + {EMBARGO}) OR (x.s > v.b AND x.s <= v.b + {EMBARGO}) THEN 'embargoed' ELSE 'train' END AS role
  FROM x, sp JOIN gs AS u ON u.symbol = x.symbol AND u.g = sp.a JOIN gs AS v ON v.symbol = x.symbol AND v.g = sp.b
)
SELECT symbol, CAST(split AS INTEGER) AS split, role, count(*) AS n, min(s) AS first_start, max(e) AS last_end FROM r GROUP BY ALL
""",
    "walk_forward_splits": f"""
WITH n AS (SELECT symbol, count(*) AS n FROM ({_SAMPLES}) GROUP BY symbol),
k AS (SELECT symbol, unnest(range(0, (n - {200 + 2 * SPLIT_HORIZON}) // 40 + 1)) AS split FROM n WHERE n >= {200 + 2 * SPLIT_HORIZON})
SELECT symbol, split, split * 40 AS train_start, split * 40 + 120 AS train_end, split * 40 + {120 + SPLIT_HORIZON} AS validation_start, split * 40 + {160 + SPLIT_HORIZON} AS validation_end,
       split * 40 + {160 + 2 * SPLIT_HORIZON} AS test_start, split * 40 + {200 + 2 * SPLIT_HORIZON} AS test_end FROM k
""",
}
