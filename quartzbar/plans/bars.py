"""Queries on the canonical timeline and its window features."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.windows import rounded
from quartzbar.operators import bar_features, recursive_features, timeframes, timeline
from quartzbar.plans import feature_oracles
from quartzbar.session import table

VALID_SQL = """
  SELECT * EXCLUDE (came, id, k) FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, m ORDER BY came DESC NULLS LAST, id DESC) AS k FROM (
      SELECT symbol, CAST(floor((epoch_us(open_time) + 30000000) / 60000000) AS BIGINT) AS m, open, high, low, close, volume,
             coalesce(quote_volume, 0) AS quote_volume, CAST(coalesce(number_of_trades, 0) AS DOUBLE) AS number_of_trades,
             coalesce(taker_buy_base_volume, 0) AS taker_buy_base_volume, coalesce(taker_buy_quote_volume, 0) AS taker_buy_quote_volume,
             ingested_at AS came, bar_id AS id
      FROM bars
      WHERE isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume)
        AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0
        AND low <= least(open, close) AND greatest(open, close) <= high
    )
  ) WHERE k = 1
"""
# Materialised: one join side is the other's grouping, and must not be planned twice.
CANONICAL_SQL = f"""
  WITH v AS MATERIALIZED ({VALID_SQL}),
  g AS MATERIALIZED (SELECT symbol, min(m) AS lo, unnest(range(min(m), max(m) + 1)) AS m FROM v GROUP BY symbol)
  SELECT symbol, m - lo AS idx, m, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, lc AS close,
         coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(number_of_trades, 0) AS number_of_trades,
         coalesce(taker_buy_base_volume, 0) AS taker_buy_base_volume, coalesce(taker_buy_quote_volume, 0) AS taker_buy_quote_volume,
         CASE WHEN own IS NULL THEN 1 ELSE 0 END AS gap_flag, CAST(m - lm AS INTEGER) AS gap_length
  FROM (
    SELECT g.symbol, g.m, g.lo, v.* EXCLUDE (symbol, m, close), v.close AS own,
           last_value(v.close IGNORE NULLS) OVER w AS lc, last_value(v.m IGNORE NULLS) OVER w AS lm
    FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.m = g.m
    WINDOW w AS (PARTITION BY g.symbol ORDER BY g.m)
  )
"""


def valid(spark: SparkSession, d: str) -> DataFrame:
    return timeline.valid_bars(table(spark, d, "bars"))


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return timeline.canonical(valid(spark, d), timeline.first_minutes(table(spark, d, "bars")))


def bar_validation(spark: SparkSession, d: str) -> DataFrame:
    return timeline.validation_counts(table(spark, d, "bars"))


def canonical_timeline(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d).select("symbol", "idx", "m", *timeline.PRICES, *timeline.VOLUMES, "gap_flag", "gap_length")


def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.gap_summary(canonical(spark, d))


def missing_days(spark: SparkSession, d: str) -> DataFrame:
    return timeline.missing_days(valid(spark, d))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol: rows, valid bars, canonical minutes, first and last minute, days with and without a bar."""
    v = valid(spark, d)
    raw = table(spark, d, "bars").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    days = v.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("a"), F.max("m").alias("b"))
    s = days.groupBy("symbol").agg(F.sum("n").alias("bars"), F.min("a").alias("first"), F.max("b").alias("last"), F.count(F.lit(1)).alias("days"), (F.max("day") - F.min("day") + 1).alias("span"))
    return raw.join(s, "symbol").select("symbol", "rows", "bars", (F.col("last") - F.col("first") + 1).alias("minutes"), "first", "last", "days", (F.col("span") - F.col("days")).alias("missing_days"))


def max_gap_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest repaired run inside the last 120 minutes, runs cut at the window's start, and the gap pressure."""
    rows = timeline.in_chunks(canonical(spark, d).select("symbol", "idx", "gap_flag", "gap_length"))
    last = "OVER (PARTITION BY symbol, chunk ORDER BY idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
    # Only the run that covers the window's first row can be cut: its length there is known from that row.
    rows = rows.selectExpr(
        "symbol", "idx", "core", "gap_flag",
        f"collect_list(CASE WHEN gap_flag = 1 THEN struct(idx, gap_length) END) {last} AS runs",
        "avg(gap_flag) OVER (PARTITION BY symbol, chunk ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ratio_20",
    )
    rows = rows.selectExpr(
        "symbol", "idx", "core", "ratio_20",
        "CAST(coalesce(array_max(transform(runs, r -> least(r.gap_length, r.idx - idx + 120))), 0) AS BIGINT) AS max_gap_run_120",
    )
    return rows.where("core").selectExpr(
        "symbol", "idx", "max_gap_run_120", "round(ratio_20 * (1 + max_gap_run_120), 6) + 0e0 AS canonical_gap_pressure"
    )


def features(family: str, spark: SparkSession, d: str) -> DataFrame:
    """The features of one family, clipped to the limits of their classes."""
    names = bar_features.family_columns(family)
    rows = bar_features.clip(bar_features.with_features(canonical(spark, d), family), names)
    return rows.selectExpr("symbol", "idx", *rounded(names))


def features_recursive(spark: SparkSession, d: str) -> DataFrame:
    rows = recursive_features.with_recursive_features(canonical(spark, d))
    return rows.selectExpr("symbol", "idx", *rounded(list(recursive_features.NAMES)))


def features_timeframe(tf: str, spark: SparkSession, d: str) -> DataFrame:
    return timeframes.onto_minutes(canonical(spark, d), tf).selectExpr("symbol", "idx", *rounded(timeframes.names(tf)))


def features_timeframes(spark: SparkSession, d: str) -> DataFrame:
    """The indicators of all timeframes at once."""
    rows = timeframes.all_onto_minutes(canonical(spark, d), timeline.spans(table(spark, d, "bars")))
    return rows.selectExpr("symbol", "idx", *rounded([n for tf in timeframes.FRAMES for n in timeframes.names(tf)]))


#: Bars of the test tables span days, not years: a period of two hours stands for the week.
PERIOD = 120
_WEEKLY = (
    "weekly_ma20_slope_closed", "weekly_ma50_slope_closed", "weekly_ma20_above_ma50", "weekly_drawdown",
    "weekly_vol_contraction", "close_vs_weekly_ma20", "close_vs_weekly_ma50",
)


def features_weekly(spark: SparkSession, d: str) -> DataFrame:
    rows = timeframes.weekly_onto_minutes(canonical(spark, d), minutes=PERIOD, offset=0, short=4, long=5)
    return rows.selectExpr("symbol", "idx", *rounded(list(_WEEKLY)))


def features_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The weekly features over 20 and 50 weeks that end on Sunday."""
    return timeframes.weekly_onto_minutes(canonical(spark, d)).selectExpr("symbol", "idx", *rounded(list(_WEEKLY)))


def resampled_bars(spark: SparkSession, d: str) -> DataFrame:
    b = timeframes.closed_buckets(canonical(spark, d), 15)
    return b.selectExpr("symbol", "bucket", "open", "high", "low", "close", *rounded(["volume"], 3))


_CLIPPED = ("returns", "vol_adjusted", "zscores")


def clip_report(spark: SparkSession, d: str) -> DataFrame:
    """Per feature: class, limit, values clipped, values not finite."""
    names = bar_features.family_columns(*_CLIPPED)
    rows = bar_features.with_features(canonical(spark, d), *_CLIPPED).selectExpr(*(f"CAST({n} AS DOUBLE) AS {n}" for n in names))
    counts = rows.agg(*(F.sum(F.when(F.abs(n) > bar_features.CLIP_LIMITS[bar_features.clip_class(n)], 1).otherwise(0)).cast("long").alias(n) for n in names))
    long = counts.unpivot([], names, "feature_name", "clipped_count")
    limit = F.create_map(*(F.lit(x) for n in names for x in (n, bar_features.CLIP_LIMITS[bar_features.clip_class(n)])))
    kind = F.create_map(*(F.lit(x) for n in names for x in (n, bar_features.clip_class(n))))
    return long.select("feature_name", kind[F.col("feature_name")].alias("feature_type"), limit[F.col("feature_name")].alias("clip_abs"), "clipped_count")


def _clip_sql() -> str:
    limits = ", ".join(f"('{n}', {x})" for f in _CLIPPED for n, (_, x) in feature_oracles.FEATURES[f].items())
    return f"""
WITH f AS ({feature_oracles.sql(CANONICAL_SQL, *_CLIPPED, digits=12, clipped=False)}),
u AS (UNPIVOT f ON COLUMNS(* EXCLUDE (symbol, idx)) INTO NAME feature_name VALUE x),
k AS (SELECT * FROM (VALUES {limits}) AS k(feature_name, clip_abs))
SELECT feature_name, CASE WHEN feature_name LIKE '%vol_adj' THEN 'vol_adj' WHEN feature_name LIKE '%regime%' THEN 'regime' WHEN feature_name LIKE '%zscore%' THEN 'zscore'
    WHEN feature_name LIKE '%return%' THEN 'return' ELSE 'ratio' END AS feature_type, CAST(any_value(clip_abs) AS DOUBLE) AS clip_abs, count(*) FILTER (abs(x) > clip_abs) AS clipped_count
FROM u JOIN k USING (feature_name) GROUP BY feature_name
"""


QUERIES = {
    f.__name__: f for f in (bar_validation, canonical_timeline, gap_summary, missing_days, coverage_report, max_gap_run, clip_report)
} | {f"features_{name}": partial(features, name) for name in bar_features.FAMILIES}
QUERIES |= {f.__name__: f for f in (features_recursive, features_timeframes, features_weekly, features_weeks, resampled_bars)}
QUERIES |= {f"features_{tf}": partial(features_timeframe, tf) for tf in timeframes.FRAMES}

SQL = {
    "bar_validation": """
SELECT count(*) AS rows,
       count(*) FILTER (isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume)
         AND least(open, high, low, close) > 0 AND volume >= 0 AND low <= least(open, close) AND greatest(open, close) <= high) AS valid,
       count(*) FILTER (open IS NULL OR isnan(open) OR high IS NULL OR isnan(high) OR low IS NULL OR isnan(low)
         OR close IS NULL OR isnan(close) OR volume IS NULL OR isnan(volume)) AS not_finite,
       count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive,
       count(*) FILTER (volume < 0) AS negative_volume,
       count(*) FILTER (NOT isnan(close) AND (low > least(open, close) OR high < greatest(open, close))) AS not_ordered
FROM bars
""",
    "canonical_timeline": CANONICAL_SQL,
    "gap_summary": f"""
SELECT symbol, count(*) AS minutes, CAST(sum(gap_flag) AS BIGINT) AS repaired_minutes, round(avg(gap_flag), 6) AS gap_ratio, max(gap_length) AS longest_run
FROM ({CANONICAL_SQL}) GROUP BY symbol
""",
    "missing_days": f"""
WITH d AS (SELECT DISTINCT symbol, CAST(floor(m / 1440) AS BIGINT) AS day FROM ({VALID_SQL}))
SELECT symbol, day FROM (SELECT symbol, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY symbol) ANTI JOIN d USING (symbol, day)
""",
    "coverage_report": f"""
WITH v AS ({VALID_SQL}), r AS (SELECT symbol, count(*) AS rows FROM bars GROUP BY symbol)
SELECT v.symbol, any_value(r.rows) AS rows, count(*) AS bars, max(m) - min(m) + 1 AS minutes, min(m) AS first, max(m) AS last, count(DISTINCT m // 1440) AS days, max(m // 1440) - min(m // 1440) + 1 - count(DISTINCT m // 1440) AS missing_days
FROM v JOIN r USING (symbol) GROUP BY v.symbol
""",
    "max_gap_run": f"""
WITH c AS MATERIALIZED (SELECT symbol, idx, gap_flag, gap_length FROM ({CANONICAL_SQL})),
r AS (
  SELECT a.symbol, a.idx, coalesce(max(least(b.gap_length, b.idx - a.idx + 120)), 0) AS run
  FROM c AS a LEFT JOIN c AS b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx - 119 AND a.idx AND b.gap_flag = 1 GROUP BY ALL
), q AS (SELECT symbol, idx, avg(gap_flag) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ratio_20 FROM c)
SELECT symbol, idx, CAST(run AS BIGINT) AS max_gap_run_120, round(ratio_20 * (1 + run), 6) + 0e0 AS canonical_gap_pressure FROM r JOIN q USING (symbol, idx)
""",
    "clip_report": _clip_sql(),
} | {f"features_{name}": feature_oracles.sql(CANONICAL_SQL, name) for name in bar_features.FAMILIES}
SQL |= {f"features_{tf}": feature_oracles.frame_sql(CANONICAL_SQL, minutes, tf) for tf, minutes in timeframes.FRAMES.items()}
SQL["features_timeframes"] = (
    "SELECT * FROM " + " JOIN ".join(f"({SQL[f'features_{tf}']}) AS f{tf}" + ("" if i == 0 else " USING (symbol, idx)") for i, tf in enumerate(timeframes.FRAMES))
)
SQL["features_recursive"] = (
    f"SELECT symbol, idx, {', '.join(rounded(list(recursive_features.NAMES)))} FROM ({recursive_features.sql_text(CANONICAL_SQL)})"
)
SQL["resampled_bars"] = f"""
SELECT symbol, CAST(floor(m / 15) AS BIGINT) AS bucket, arg_min(open, m) AS open, max(high) AS high, min(low) AS low, arg_max(close, m) AS close,
       {rounded(["sum(volume)"], 3)[0].removesuffix(" AS sum(volume)")} AS volume
FROM ({CANONICAL_SQL}) GROUP BY ALL HAVING count(*) = 15
"""


def _weekly_sql(minutes: int, offset: int, short: int, long: int) -> str:
    return f"""
WITH canon AS MATERIALIZED ({CANONICAL_SQL}),
w AS (SELECT symbol, CAST(floor((m - {offset}) / {minutes}) AS BIGINT) AS b, arg_max(close, m) AS close FROM canon GROUP BY ALL),
x AS (
  SELECT *, CASE WHEN count(*) OVER s = {short} THEN avg(close) OVER s END AS ma_s, CASE WHEN count(*) OVER l = {long} THEN avg(close) OVER l END AS ma_l,
         CASE WHEN count(*) OVER s = {short} THEN stddev_samp(close) OVER s END AS sd_s, CASE WHEN count(*) OVER l = {long} THEN stddev_samp(close) OVER l END AS sd_l,
         max(close) OVER (PARTITION BY symbol ORDER BY b) AS top, count(*) OVER (PARTITION BY symbol) >= {long} AS enough
  FROM w WINDOW s AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN {short - 1} PRECEDING AND CURRENT ROW), l AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN {long - 1} PRECEDING AND CURRENT ROW)
), y AS (
  SELECT *, (b + 1) * {minutes} + {offset} AS known_at, coalesce(ma_s / lag(ma_s) OVER o - 1, 0) AS slope_s, coalesce(ma_l / lag(ma_l) OVER o - 1, 0) AS slope_l
  FROM x WINDOW o AS (PARTITION BY symbol ORDER BY b)
), z AS (
  SELECT c.symbol, c.idx, coalesce(e.enough, false) AS ok, coalesce(slope_s, 0) AS weekly_ma20_slope_closed, coalesce(slope_l, 0) AS weekly_ma50_slope_closed,
         CASE WHEN ma_s > ma_l THEN 1 ELSE 0 END AS weekly_ma20_above_ma50, coalesce(y.close / top - 1, 0) AS weekly_drawdown,
         CASE WHEN y.b IS NULL THEN 1 ELSE greatest(0, least(10, coalesce(sd_s / coalesce(nullif(sd_l, 0), 1e-8), 1))) END AS weekly_vol_contraction,
         coalesce(c.close / ma_s - 1, 0) AS close_vs_weekly_ma20, coalesce(c.close / ma_l - 1, 0) AS close_vs_weekly_ma50
  FROM canon AS c ASOF LEFT JOIN y ON c.symbol = y.symbol AND c.m >= y.known_at JOIN (SELECT DISTINCT symbol, enough FROM x) AS e ON e.symbol = c.symbol
)
SELECT symbol, idx, {", ".join(rounded(list(_WEEKLY), of=lambda n: f"CASE WHEN ok THEN CAST({n} AS DOUBLE) ELSE 0 END"))} FROM z
"""


SQL["features_weekly"] = _weekly_sql(PERIOD, 0, 4, 5)
SQL["features_weeks"] = _weekly_sql(7 * 1440, 4 * 1440, 20, 50)
