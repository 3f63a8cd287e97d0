"""Features of other sources, carried onto the minutes: order book, funding, metrics ticks.

A minute sees the last record at or before its beginning; where there is none the defaults hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.functions.keys import entity_key, epoch_us
from quartzbar.functions.windows import frame, strict
from quartzbar.operators.asof import asof_backward, asof_nearest

MINUTE_US, DAY_US = 60_000_000, 86_400_000_000


def _safe(n: Column, d: Column, default: float) -> Column:
    return F.coalesce(F.when(d != 0, n / d), F.lit(default))


def _minutes(timeline: DataFrame) -> DataFrame:
    return timeline.select(F.col("symbol").alias("entity"), (F.col("m") * MINUTE_US).alias("t"), "symbol", "idx", "close")


def book_features(timeline: DataFrame, depth: DataFrame) -> DataFrame:
    """symbol, idx, spread, spread_bps, imbalances, quantity ratios, microprice deviation."""
    usable = depth.where("best_bid > 0 AND best_ask > 0")
    right = usable.select(
        F.col("symbol").alias("entity"), F.unix_micros(F.col("snapshot_time").cast("timestamp")).alias("t"),
        F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("came"), "snapshot_id", "best_bid", "best_ask", "bid_qty", "ask_qty", "microprice",
    )
    got = asof_backward(_minutes(timeline), right, ["best_bid", "best_ask", "bid_qty", "ask_qty", "microprice"], DAY_US, ["came", "snapshot_id"])
    mid, total = (F.col("best_bid") + F.col("best_ask")) / 2, F.col("bid_qty") + F.col("ask_qty")
    spread = _safe(F.col("best_ask") - F.col("best_bid"), mid, 0.0001)
    lean = _safe(F.col("bid_qty") - F.col("ask_qty"), total, 0.0)
    return got.select(
        "symbol", "idx", spread.alias("spread"), (spread * 10_000).alias("spread_bps"), lean.alias("bid_ask_imbalance"), lean.alias("order_book_pressure"),
        _safe(F.col("bid_qty"), total, 0.5).alias("best_bid_qty_ratio"), _safe(F.col("ask_qty"), total, 0.5).alias("best_ask_qty_ratio"),
        _safe(F.col("microprice") - mid, mid, 0.0).alias("microprice_deviation"),
    )


def funding_features(timeline: DataFrame, funding: DataFrame, blackout_min: float = 60, nearest: bool = True) -> DataFrame:
    """symbol, idx, funding_rate, next_funding_rate, minutes_to_next_funding, funding_blackout_active.

    Of each minute the funding row nearest in time, which may lie ahead; else the last at or before it.
    """
    right = funding.where("next_funding_time <> 0").select(
        entity_key(F.col("symbol")).alias("entity"), epoch_us(F.col("next_funding_time")).alias("t"), "funding_id", "current_rate", "next_rate", "minutes_to_next"
    )
    join = asof_nearest if nearest else asof_backward
    got = join(_minutes(timeline), right, ["current_rate", "next_rate", "minutes_to_next"], DAY_US, ["funding_id"])
    left = F.coalesce(F.when(~F.isnan("minutes_to_next"), F.col("minutes_to_next")), F.lit(480.0))
    return got.select(
        "symbol", "idx", F.coalesce("current_rate", F.lit(0.0)).alias("funding_rate"), F.coalesce("next_rate", F.lit(0.0)).alias("next_funding_rate"),
        left.alias("minutes_to_next_funding"), (left <= blackout_min).cast("double").alias("funding_blackout_active"),
    )


# What stands for a mark price and premium that are missing.
MARK_FACTOR, MARK_PREMIUM = 1.0002, 0.0002


def mark_prices(responses: DataFrame) -> DataFrame:
    """entity, t (microseconds), mark_price, premium of the well-formed payloads that give a mark price; of one time the last response counts."""
    v = F.try_parse_json("payload")
    rows = responses.where("status_code = 200").select(
        "response_id", entity_key(F.try_variant_get(v, "$.symbol", "string")).alias("entity"), epoch_us(F.try_variant_get(v, "$.time", "bigint")).alias("t"),
        F.try_variant_get(v, "$.markPrice", "double").alias("mark_price"), F.try_variant_get(v, "$.premium", "double").alias("premium"),
    )
    known = rows.where("mark_price IS NOT NULL AND t IS NOT NULL AND entity <> ''")
    return known.groupBy("entity", "t").agg(F.max_by(F.struct("mark_price", "premium"), "response_id").alias("b")).select("entity", "t", "b.*")


def mark_features(timeline: DataFrame, marks: DataFrame) -> DataFrame:
    """symbol, idx, mark_price_basis, premium_index from marks (entity, t, mark_price, premium) of exactly the minute's time.

    Without one the mark price is taken as a fixed factor of the close.
    """
    j = _minutes(timeline).join(marks, ["entity", "t"], "left")
    mark = F.coalesce("mark_price", F.col("close") * MARK_FACTOR)
    premium = F.when(F.col("mark_price").isNull(), MARK_PREMIUM).otherwise(F.coalesce("premium", F.lit(0.0)))
    return j.select("symbol", "idx", _safe(mark - F.col("close"), F.col("close"), 0.0).alias("mark_price_basis"), premium.alias("premium_index"))


def carried(timeline: DataFrame, source: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """symbol, idx and columns of the last source row (entity, t, ...) at or before each minute, or their defaults."""
    got = asof_backward(_minutes(timeline), source, list(defaults), DAY_US)
    return got.select("symbol", "idx", *(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(v)).alias(c) for c, v in defaults.items()))


#: Window expressions over ticks of five minutes, numbered by idx. A change of nothing is 0; windows may be partial.
def _change(x: str, k: int) -> str:
    return f"coalesce(({x} - lag({x}, {k}) @) / nullif(abs(lag({x}, {k}) @), 0), 0)"


def _partial_z(x: str, n: int) -> str:
    sd = f"stddev_pop({x}) @{n}"
    return f"CASE WHEN count({x}) @{n} >= 2 AND {sd} > 1e-12 * abs(avg({x}) @{n}) THEN ({x} - avg({x}) @{n}) / {sd} ELSE 0 END"


METRICS: dict[str, str] = {
    "oi_change_rate_5m": _change("open_interest", 1), "oi_change_rate_30m": _change("open_interest", 6),
    "oi_zscore_1d": _partial_z("open_interest", 288), "oi_value_zscore_1d": _partial_z("open_interest_value", 288),
    "taker_ls_ratio": "taker_ratio", "taker_ls_ratio_change_5m": _change("taker_ratio", 1),
    "strict_oi_mean_12": strict(12, "avg(open_interest) @12", "NULL"),
}


def metrics_features(ticks: DataFrame) -> DataFrame:
    """Features of metrics ticks (symbol, idx, open_interest, open_interest_value, taker_ratio), last write per tick.

    Ticks are five minutes apart, so a symbol's window is bounded by the span of time.
    """
    return ticks.select("symbol", "idx", *(F.expr(frame(e, "symbol")).cast("double").alias(n) for n, e in METRICS.items()))


ACCOUNTS: dict[str, str] = {
    "toptrader_ls_account": "count_toptrader_long_short_ratio", "toptrader_ls_position": "sum_toptrader_long_short_ratio", "global_ls_account": "count_long_short_ratio",
    "toptrader_ls_account_change_5m": _change("count_toptrader_long_short_ratio", 1), "global_ls_account_change_5m": _change("count_long_short_ratio", 1),
}


def account_features(ticks: DataFrame) -> DataFrame:
    """The features of the account ratios of metrics ticks (symbol, idx and the ratios as named by read_metrics_csv)."""
    return ticks.select("symbol", "idx", *(F.expr(frame(e, "symbol")).cast("double").alias(n) for n, e in ACCOUNTS.items()))


def position_features(timeline: DataFrame, queue: DataFrame, brackets: DataFrame) -> DataFrame:
    """symbol, idx, adl_indicator (the rank in the deleveraging queue) and leverage_bracket_utilization (the position's
    notional by the cap of its bracket) of the last rows of queue (entity, t, quantile) and brackets (entity, t, notional,
    cap) at or before each minute; 0 without one."""
    rank = carried(timeline, queue, {"quantile": 0.0}).withColumnRenamed("quantile", "adl_indicator")
    used = carried(timeline, brackets, {"notional": 0.0, "cap": 0.0})
    share = F.when(F.col("notional") == 0, 0.0).otherwise(F.col("notional") / F.greatest(F.col("cap"), F.lit(1e-12)))
    return rank.join(used.select("symbol", "idx", share.alias("leverage_bracket_utilization")), ["symbol", "idx"])


def metrics_onto_minutes(timeline: DataFrame, ticks: DataFrame) -> DataFrame:
    """symbol, idx and the eleven metrics features of the last tick at or before each minute; 0 before the first.

    ticks: symbol, create_time and the quantities as read_metrics_csv names them.
    """
    w = Window.partitionBy("symbol").orderBy("create_time")
    # Ticks are minutes apart: their number per symbol is bounded by the span of time.
    numbered = ticks.withColumn("idx", F.row_number().over(w) - 1).withColumns(
        {"open_interest": F.col("sum_open_interest"), "open_interest_value": F.col("sum_open_interest_value"), "taker_ratio": F.col("sum_taker_long_short_vol_ratio")}
    )
    wanted = {n: e for n, e in (METRICS | ACCOUNTS).items() if n != "strict_oi_mean_12"}
    known = numbered.select(
        F.col("symbol").alias("entity"), F.unix_micros(F.col("create_time").cast("timestamp")).alias("t"), *(F.expr(frame(e, "symbol")).cast("double").alias(n) for n, e in wanted.items())
    )
    return carried(timeline, known, dict.fromkeys(wanted, 0.0))
