"""Closed bars of longer timeframes and their indicators, carried onto the minutes that may know them.

A bucket closes when all its minutes are there; its indicators hold from the minute after its last one. As the
timeline is dense, every bucket after a symbol's first is complete, so the backward as-of join onto the minutes
is an equality join on the number of the last closed bucket. Buckets are folded before the shuffle; windows
run over buckets, whose number per symbol is bounded by the span of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.functions.windows import frame, shared
from quartzbar.session import checkpointed

FRAMES = {"15m": 15, "1h": 60, "4h": 240}
HISTORY = 24


def closed_buckets(timeline: DataFrame, minutes: int) -> DataFrame:
    """symbol, bucket, open, high, low, close, volume of every complete bucket of epoch-aligned minutes."""
    return (
        timeline.groupBy("symbol", F.floor(F.col("m") / minutes).alias("bucket"))
        .agg(
            F.min_by("open", "m").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "m").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") == minutes)
        .drop("n")
    )


def _ema_of_last(n: int) -> str:
    """Exponential mean of at most n last closes, seeded with the oldest, as a weighted sum of lags."""
    terms = []
    for j in range(n):
        x = f"coalesce(lag(close, {j}) @, 0)" if j else "close"
        terms.append(f"CASE WHEN {j} < e - 1 THEN a * power(1 - a, {j}) WHEN {j} = e - 1 THEN power(1 - a, {j}) ELSE 0 END * {x}")
    return " + ".join(terms)


_SD = "CASE WHEN stddev_pop({x}) @20 > 1e-12 * abs(avg({x}) @20) THEN stddev_pop({x}) @20 ELSE 0 END"
#: Layers as in bar_features; k counts a symbol's closed buckets from 0, n those that a feature may see.
LAYERS: list[dict[str, str]] = [
    {"k": "row_number() @ - 1", "pc": "lag(close, 1) @", "ph": "lag(high, 1) @", "pl": "lag(low, 1) @"},
    {
        "idx": "bucket", "e": "least(k + 1, 20)", "a": "2.0 / (least(k + 1, 20) + 1)",
        "tr": "CASE WHEN k > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE 0 END",
        "up": "CASE WHEN k > 0 THEN greatest(close - pc, 0) ELSE 0 END", "down": "CASE WHEN k > 0 THEN greatest(pc - close, 0) ELSE 0 END",
        "pdm": "CASE WHEN k > 0 AND high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END",
        "mdm": "CASE WHEN k > 0 AND pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END",
        "ma": "avg(close) @10",
    },
    {"di_p": "avg(pdm) @14", "di_m": "avg(mdm) @14", "atr": "avg(tr) @14", "gain": "avg(up) @14", "loss": "avg(down) @14"},
]
INDICATORS: dict[str, str] = {
    "trend_slope": "CASE WHEN k >= 1 THEN coalesce(regr_slope(close, bucket) @10 / nullif(close, 0), 0) ELSE 0 END",
    "return": "CASE WHEN k >= 1 THEN coalesce(close / nullif(first_value(close) @11, 0) - 1, 0) ELSE 0 END",
    "ema_gap": f"coalesce((close - ({_ema_of_last(20)})) / nullif(close, 0), 0)",
    "ma_slope": "CASE WHEN k >= 10 THEN coalesce(ma / nullif(lag(ma, 1) @, 0) - 1, 0) ELSE 0 END",
    "rsi": "CASE WHEN k < 14 THEN 50 WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END",
    "atr_pct": "CASE WHEN k >= 14 THEN coalesce(atr / nullif(close, 0), 0) ELSE 0 END",
    "bb_width": f"coalesce(4 * ({_SD.format(x='close')}) / nullif(avg(close) @20, 0), 0)",
    "adx": "CASE WHEN k >= 14 THEN coalesce(100 * abs(di_p - di_m) / nullif(di_p + di_m, 0), 0) ELSE 0 END",
    "volume_z": f"coalesce((volume - avg(volume) @20) / nullif({_SD.format(x='volume')}, 0), 0)",
}
DAY_INDICATORS: dict[str, str] = {
    "trend_slope_24h": "CASE WHEN k >= 1 THEN coalesce(regr_slope(close, bucket) @24 / nullif(close, 0), 0) ELSE 0 END",
    "return_24h": "coalesce(close / nullif(first_value(close) @24, 0) - 1, 0)",
    "drawdown_from_24h_high": "coalesce(1 - close / nullif(max(high) @24, 0), 0)",
    "distance_from_24h_high": "coalesce(close / nullif(max(high) @24, 0) - 1, 0)",
    "distance_from_24h_low": "coalesce(close / nullif(min(low) @24, 0) - 1, 0)",
    "rolling_high_breakout_24h": "CASE WHEN close >= max(high) @24 THEN 1 ELSE 0 END",
    "rolling_low_breakdown_24h": "CASE WHEN close <= min(low) @24 THEN 1 ELSE 0 END",
}


def names(tf: str) -> list[str]:
    return [f"{n}_{tf}" for n in INDICATORS] + (list(DAY_INDICATORS) if tf == "1h" else [])


def _wanted(tf: str) -> dict[str, str]:
    return {f"{n}_{tf}": e for n, e in INDICATORS.items()} | (DAY_INDICATORS if tf == "1h" else {})


def indicators(buckets: DataFrame, tf: str) -> DataFrame:
    """symbol, bucket and the indicators of one timeframe."""
    rows = buckets
    for layer in LAYERS:
        rows = rows.withColumns({n: F.expr(frame(e, "symbol", "bucket")) for n, e in layer.items()})
    calls, rest = shared(_wanted(tf), "symbol", "bucket")
    rows = rows.withColumns({n: F.expr(e) for n, e in calls.items()})
    return rows.select("symbol", "bucket", *(F.expr(e).cast("double").alias(n) for n, e in rest.items()))


def onto_minutes(timeline: DataFrame, tf: str) -> DataFrame:
    """symbol, idx and the indicators of the last bucket closed before each minute; neutral where there is none."""
    minutes = FRAMES[tf]
    known = indicators(closed_buckets(timeline, minutes), tf)
    rows = timeline.select("symbol", "idx", (F.floor(F.col("m") / minutes) - 1).alias("bucket"))
    joined = rows.join(known, ["symbol", "bucket"], "left")
    neutral = lambda n: F.lit(50.0 if n.startswith("rsi_") else 0.0)
    return joined.select("symbol", "idx", *(F.coalesce(F.col(n), neutral(n)).alias(n) for n in names(tf)))


def all_onto_minutes(timeline: DataFrame, ends: DataFrame) -> DataFrame:
    """symbol, idx and the indicators of all timeframes; ends: symbol, lo, hi.

    The longer buckets are made of whole shorter ones, and what minutes see changes with the shortest bucket only:
    everything is joined per such bucket, and the minutes are written out of it at last. So the timeline is read
    once, and only buckets are shuffled after that.
    """
    least = min(FRAMES.values())
    parts = {tf: closed_buckets(timeline, minutes) for tf, minutes in FRAMES.items() if minutes == least}
    short = checkpointed(next(iter(parts.values())))
    for tf, minutes in FRAMES.items():
        if minutes == least:
            parts[tf] = short
            continue
        ratio = minutes // least
        grouped = short.groupBy("symbol", F.floor(F.col("bucket") / ratio).alias("long")).agg(
            F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
        )
        parts[tf] = grouped.where(F.col("n") == ratio).select("symbol", F.col("long").alias("bucket"), "open", "high", "low", "close", "volume")
    # Every short bucket that holds a minute, whole or not.
    out = ends.select("symbol", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / least), F.floor(F.col("hi") / least))).alias("cell"))
    for tf, minutes in FRAMES.items():
        known = indicators(parts[tf], tf).withColumnRenamed("bucket", f"_{tf}")
        out = out.withColumn(f"_{tf}", F.floor(F.col("cell") * least / minutes) - 1).join(known, ["symbol", f"_{tf}"], "left")
    # The buckets are few and would be put together into few tasks; the minutes are many.
    out = out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "cell")
    minute = F.explode(F.sequence(F.greatest(F.col("lo"), F.col("cell") * least), F.least(F.col("hi"), F.col("cell") * least + least - 1))).alias("m")
    every = [n for tf in FRAMES for n in names(tf)]
    neutral = lambda n: F.lit(50.0 if n.startswith("rsi_") else 0.0)
    return out.select("symbol", "lo", minute, *every).select("symbol", (F.col("m") - F.col("lo")).alias("idx"), *(F.coalesce(F.col(n), neutral(n)).alias(n) for n in every))


def weekly(timeline: DataFrame, minutes: int = 7 * 1440, offset: int = 4 * 1440, short: int = 20, long: int = 50) -> DataFrame:
    """Per period and symbol: means over the short and long window, their slopes, drawdown, contraction.

    A period is a week that ends on Sunday, or any number of minutes; offset puts its border (epoch minute 0 is
    a Thursday). A period's values hold from the minute after its end.
    """
    p = timeline.groupBy("symbol", F.floor((F.col("m") - offset) / minutes).alias("bucket")).agg(F.max_by("close", "m").alias("close"))
    full = lambda n, e: f"CASE WHEN count(close) @{n} = {n} THEN {e} END"
    layers = [
        {"ma_s": full(short, f"avg(close) @{short}"), "ma_l": full(long, f"avg(close) @{long}"),
         "sd_s": full(short, f"stddev_samp(close) @{short}"), "sd_l": full(long, f"stddev_samp(close) @{long}"),
         "top": "max(close) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"ma20_slope": "coalesce(ma_s / lag(ma_s, 1) @ - 1, 0)", "ma50_slope": "coalesce(ma_l / lag(ma_l, 1) @ - 1, 0)",
         "ma20_above_ma50": "CASE WHEN ma_s > ma_l THEN 1 ELSE 0 END", "drawdown": "close / top - 1",
         "vol_contraction": "greatest(0, least(10, coalesce(sd_s / coalesce(nullif(sd_l, 0), 1e-8), 1)))"},
    ]
    for layer in layers:
        p = p.withColumns({n: F.expr(frame(e, "symbol", "bucket")) for n, e in layer.items()})
    return p.select("symbol", "bucket", "ma_s", "ma_l", "ma20_slope", "ma50_slope", "ma20_above_ma50", "drawdown", "vol_contraction")


def weekly_onto_minutes(timeline: DataFrame, minutes: int = 7 * 1440, offset: int = 4 * 1440, short: int = 20, long: int = 50) -> DataFrame:
    """symbol, idx and the weekly features of each minute; all 0 for a symbol with less than ``long`` periods."""
    w = weekly(timeline, minutes, offset, short, long)
    enough = w.groupBy("symbol").agg((F.count(F.lit(1)) >= long).alias("enough"))
    rows = timeline.select("symbol", "idx", "close", (F.floor((F.col("m") - offset) / minutes) - 1).alias("bucket"))
    j = rows.join(w, ["symbol", "bucket"], "left").join(enough, "symbol")
    pick = lambda n, default: F.when(F.col("enough"), F.coalesce(F.col(n).cast("double"), F.lit(default))).otherwise(0.0)
    return j.select(
        "symbol", "idx", pick("ma20_slope", 0.0).alias("weekly_ma20_slope_closed"), pick("ma50_slope", 0.0).alias("weekly_ma50_slope_closed"),
        pick("ma20_above_ma50", 0.0).alias("weekly_ma20_above_ma50"), pick("drawdown", 0.0).alias("weekly_drawdown"),
        pick("vol_contraction", 1.0).alias("weekly_vol_contraction"),
        *(F.when(F.col("enough"), F.coalesce(F.col("close") / F.col(m) - 1, F.lit(0.0))).otherwise(0.0).alias(f"close_vs_weekly_{n}") for m, n in (("ma_s", "ma20"), ("ma_l", "ma50"))),
    )
