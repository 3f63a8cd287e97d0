"""Features of bars by trailing windows, in layers: each layer may use the columns of those before it.

All windows of a layer share one partitioning and order, so a feature set costs one shuffle and one sort,
however many features it has. Partitions are chunks of minutes with a halo (see timeline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.functions.windows import from_row, ratio, shared, slope, spread, strict, to_mean, zscore
from quartzbar.operators.timeline import in_chunks

_LN_HL, _LN_CO = "ln(high / low)", "ln(close / open)"


def _return(k: int) -> str:
    return f"coalesce(close / nullif(lag(close, {k}) @, 0) - 1, 0)"


def _denominator(*names: str) -> str:
    """The greatest finite value above 1e-12; without one NaN if any is not finite, else 1e-12."""
    finite = ", ".join(f"CASE WHEN {n} - {n} = 0 AND {n} > 1e-12 THEN {n} END" for n in names)
    best = f"greatest({finite})" if len(names) > 1 else finite
    return f"coalesce({best}, CASE WHEN {' AND '.join(f'coalesce({n} - {n} = 0, false)' for n in names)} THEN 1e-12 ELSE CAST('NaN' AS DOUBLE) END)"


#: Fixed value: the dead band of the direction of the previous horizon.
DEAD_BAND = 0.001

KEYS = "symbol, chunk"
LAYERS: list[dict[str, str]] = [
    {
        "ret1": _return(1),
        "range_": "high - low",
        "range_pct": ratio("high - low", "close"),
        "prev_close": "coalesce(lag(close, 1) @, close)",
        "hl2": f"power({_LN_HL}, 2)",
        "gk": f"0.5 * power({_LN_HL}, 2) - (2 * ln(2) - 1) * power({_LN_CO}, 2)",
        "upper": "greatest(0, high - greatest(open, close))",
        "lower": "greatest(0, least(open, close) - low)",
        **{f"sma_{n}": strict(n, f"avg(close) @{n}") for n in (5, 10, 20, 60)},
        **{f"rolling_vwap_{n}": strict(n, ratio(f"sum(close * volume) @{n}", f"sum(volume) @{n}")) for n in (20, 60)},
        "range_high_20": strict(20, "max(high) @20"),
        "range_low_20": strict(20, "min(low) @20"),
    },
    {
        "true_range": "greatest(high - low, abs(high - prev_close), abs(low - prev_close))",
        "dev_vwap_20": "CASE WHEN rolling_vwap_20 <> 0 THEN close - rolling_vwap_20 ELSE 0 END",
        "prev_high_20": "coalesce(lag(range_high_20, 1) @, 0)",
        "prev_low_20": "coalesce(lag(range_low_20, 1) @, 0)",
        **{f"rv_{n}": from_row(n, spread("ret1", n)) for n in (5, 15, 30, 60, 120)},
        **{f"return_{k}": _return(k) for k in (3, 5, 10, 15, 30, 60)},
    },
    {
        "atr_pct": strict(14, ratio("avg(true_range) @14", "close")),
        "atr_pct_30": strict(30, ratio("avg(true_range) @30", "close")),
        "close_zscore_20": zscore("close", 20),
        "close_zscore_60": zscore("close", 60),
        "volume_zscore_20": zscore("volume", 20),
        "trade_count_zscore_20": zscore("number_of_trades", 20),
        "momentum_10": "return_10",
        "momentum_30": "return_30",
        # A difference that is rounding noise is none: it may be divided by next to nothing later.
        "sma_20_60_spread": "CASE WHEN abs(sma_20 - sma_60) > 1e-12 * close THEN (sma_20 - sma_60) / close ELSE 0 END",
        "high_low_range": "range_pct",
        "body_pct": ratio("abs(close - open)", "close"),
        "taker_imbalance": ratio("2 * taker_buy_base_volume - volume", "volume"),
        "volume_sma_60_ratio": to_mean("volume", 60),
        "return_1": "ret1",
    },
]

_WIDE = _denominator("rv_15", "rv_60", "rv_120", "atr_pct")
FAMILIES: dict[str, dict[str, str]] = {
    "returns": {
        **{f"return_{k}": f"return_{k}" for k in (1, 3, 5, 10, 15, 30, 60)},
        "log_return_1": "coalesce(ln(close / nullif(lag(close, 1) @, 0)), 0)",
        "log_return_5": "coalesce(ln(close / nullif(lag(close, 5) @, 0)), 0)",
        "momentum_10": "momentum_10", "momentum_30": "momentum_30",
        "rolling_return_max_20": from_row(20, "max(ret1) @20"),
        "rolling_return_min_20": from_row(20, "min(ret1) @20"),
    },
    "trend": {
        **{f"close_sma_{n}_ratio": to_mean("close", n) for n in (5, 10, 20, 60)},
        "sma_5_20_spread": ratio("sma_5 - sma_20", "close"), "sma_20_60_spread": "sma_20_60_spread",
        "trend_slope_10": slope("close", 10), "trend_slope_30": slope("close", 30),
        "distance_to_high_20": strict(20, "close / nullif(range_high_20, 0) - 1"),
        "distance_to_low_20": strict(20, "close / nullif(range_low_20, 0) - 1"),
        "prev_horizon_trend": from_row(
            15, f"CASE WHEN lag(close, 1) @ / lag(close, 15) @ - 1 > {DEAD_BAND} THEN 1 WHEN lag(close, 1) @ / lag(close, 15) @ - 1 < -{DEAD_BAND} THEN -1 ELSE 0 END"
        ),
    },
    "volatility": {
        **{f"rv_{n}": f"rv_{n}" for n in (5, 15, 30, 60, 120)},
        "atr_pct": "atr_pct", "atr_pct_30": "atr_pct_30",
        "parkinson_vol_20": strict(20, "sqrt(avg(hl2) @20 / (4 * ln(2)))"),
        "garman_klass_vol_20": strict(20, "sqrt(greatest(avg(gk) @20, 0))"),
        "range_vol_20": strict(20, spread("range_pct", 20)),
        "har_rv_short": "rv_5", "har_rv_medium": "rv_30", "har_rv_long": "rv_120",
    },
    "activity": {
        **{f"volume_sma_{n}_ratio": to_mean("volume", n) for n in (5, 20, 60)},
        "quote_volume_sma_20_ratio": to_mean("quote_volume", 20),
        "taker_ratio": ratio("taker_buy_base_volume", "volume"), "taker_imbalance": "taker_imbalance",
        "taker_quote_ratio": ratio("taker_buy_quote_volume", "quote_volume"),
        "trade_count_ratio": to_mean("number_of_trades", 20), "trade_count_zscore_20": "trade_count_zscore_20",
        "volume_per_trade": ratio("volume", "number_of_trades"), "quote_volume_per_trade": ratio("quote_volume", "number_of_trades"),
        "volume_shock_20": "volume_zscore_20",
    },
    "candle": {
        "high_low_range": "high_low_range", "body_pct": "body_pct",
        "upper_shadow": ratio("upper", "close"), "lower_shadow": ratio("lower", "close"),
        "close_location_value": ratio("(close - low) - (high - close)", "high - low"),
        "wick_imbalance": ratio("upper - lower", "high - low"), "body_to_range": ratio("abs(close - open)", "high - low"),
        "range_sma_20_ratio": to_mean("range_", 20),
        "inside_bar_flag": "CASE WHEN high <= lag(high, 1) @ AND low >= lag(low, 1) @ THEN 1 ELSE 0 END",
        "outside_bar_flag": "CASE WHEN high >= lag(high, 1) @ AND low <= lag(low, 1) @ THEN 1 ELSE 0 END",
    },
    "gaps": {
        "gap_flag": "gap_flag", "gap_length": "gap_length", "repaired_flag": "gap_flag",
        **{f"gap_ratio_{n}": f"avg(gap_flag) @{n}" for n in (20, 60, 120)},
    },
    "zscores": {
        "close_zscore_20": "close_zscore_20", "close_zscore_60": "close_zscore_60",
        "volume_zscore_5": zscore("volume", 5), "volume_zscore_20": "volume_zscore_20",
        "rv_zscore_60": zscore("rv_5", 60), "range_zscore_20": zscore("range_pct", 20),
        "volatility_regime_60": to_mean("rv_15", 60), "volume_regime_60": "volume_sma_60_ratio",
    },
    "vol_adjusted": {
        **{f"{n}_vol_adj": f"{n} / {_WIDE}" for n in ("return_1", "return_5", "return_10", "return_30", "momentum_10", "momentum_30")},
        **{f"{n}_vol_adj": f"{n} / {_denominator('rv_60')}" for n in ("close_zscore_20", "close_zscore_60")},
        "sma_spread_vol_adj": f"sma_20_60_spread / {_denominator('rv_60')}",
        "candle_range_vol_adj": f"high_low_range / {_denominator('rv_60')}", "body_pct_vol_adj": f"body_pct / {_denominator('rv_60')}",
        "volume_zscore_20_vol_adj": f"volume_zscore_20 / {_denominator('rv_60')}",
        "trade_count_zscore_20_vol_adj": f"trade_count_zscore_20 / {_denominator('rv_60')}",
        "taker_imbalance_vol_adj": f"taker_imbalance / {_denominator('rv_60')}",
    },
    "calendar": {
        "hour": "CAST(floor(m / 60) AS BIGINT) % 24", "minute": "m % 60",
        "day_of_week": "(CAST(floor(m / 1440) AS BIGINT) + 3) % 7",
        "session_asia": "CASE WHEN CAST(floor(m / 60) AS BIGINT) % 24 < 8 THEN 1 ELSE 0 END",
        "session_europe": "CASE WHEN CAST(floor(m / 60) AS BIGINT) % 24 BETWEEN 8 AND 15 THEN 1 ELSE 0 END",
        "session_us": "CASE WHEN CAST(floor(m / 60) AS BIGINT) % 24 >= 16 THEN 1 ELSE 0 END",
        "session_overlap": "CASE WHEN CAST(floor(m / 60) AS BIGINT) % 24 BETWEEN 8 AND 15 THEN 1 ELSE 0 END",
        "weekend_flag": "CASE WHEN (CAST(floor(m / 1440) AS BIGINT) + 3) % 7 >= 5 THEN 1 ELSE 0 END",
    },
    "range": {
        "bb_width_20": strict(20, ratio(f"2 * ({spread('close', 20)})", "avg(close) @20")),
        "bb_percent_b": strict(20, f"CASE WHEN ({spread('close', 20)}) = 0 THEN 0.5 ELSE (close - avg(close) @20 + 2 * stddev_pop(close) @20) / nullif(4 * stddev_pop(close) @20, 0) END"),
        "rolling_vwap_20": "rolling_vwap_20", "rolling_vwap_60": "rolling_vwap_60",
        "price_vs_rolling_vwap_20": "coalesce(close / nullif(rolling_vwap_20, 0) - 1, 0)",
        "price_vs_rolling_vwap_60": "coalesce(close / nullif(rolling_vwap_60, 0) - 1, 0)",
        "range_high_20": "range_high_20", "range_low_20": "range_low_20", "range_mid_20": "(range_high_20 + range_low_20) / 2",
        "range_position_20": "CASE WHEN range_high_20 <= range_low_20 THEN 0 ELSE least(1, greatest(0, (close - range_low_20) / nullif(range_high_20 - range_low_20, 0))) END",
        "distance_to_range_high": "coalesce(close / nullif(range_high_20, 0) - 1, 0)",
        "distance_to_range_low": "coalesce(close / nullif(range_low_20, 0) - 1, 0)",
        "fake_break_low": "CASE WHEN prev_low_20 <> 0 AND lag(close, 1) @ >= prev_low_20 AND close < prev_low_20 AND close > open THEN 1 ELSE 0 END",
        "fake_break_high": "CASE WHEN prev_high_20 <> 0 AND lag(close, 1) @ <= prev_high_20 AND close > prev_high_20 AND close < open THEN 1 ELSE 0 END",
        "close_back_inside_range": (
            "CASE WHEN prev_high_20 <> 0 AND prev_low_20 <> 0 AND (lag(close, 1) @ > prev_high_20 OR lag(close, 1) @ < prev_low_20)"
            " AND close BETWEEN range_low_20 AND range_high_20 THEN 1 ELSE 0 END"
        ),
        "vwap_deviation_zscore": from_row(38, ratio("dev_vwap_20", spread("dev_vwap_20", 20))),
        "bb_zscore": "close_zscore_20",
    },
}


def with_features(timeline: DataFrame, *families: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The timeline's symbol, idx, the columns to keep and the features of the families."""
    rows = in_chunks(timeline)
    wanted = {n: e for f in families for n, e in FAMILIES[f].items()}
    for layer in LAYERS:
        rows = _apply(rows, layer)
    # Features are named at last: one may share the name of a column that others are made of.
    calls, rest = shared(wanted, KEYS)
    rows = rows.withColumns({n: F.expr(e) for n, e in calls.items()}) if calls else rows
    return rows.where("core").select("symbol", "idx", *keep, *(F.expr(e).alias(n) for n, e in rest.items()))


def _apply(rows: DataFrame, layer: dict[str, str]) -> DataFrame:
    calls, rest = shared(layer, KEYS)
    if calls:
        rows = rows.withColumns({n: F.expr(e) for n, e in calls.items()})
    return rows.withColumns({n: F.expr(e) for n, e in rest.items()}).drop(*calls)


# Limits by class of feature, and the classes in the order in which names are tried.
CLIP_LIMITS = {
    "zscore": 10.0, "ratio": 100.0, "return": 0.20, "vol_adj": 10.0, "bps": 10_000.0, "vol": 10.0,
    "price": 1_000_000.0, "regime": 10.0, "flag": 1.0, "minutes": 1440.0, "funding": 1.0, "adl": 4.0,
}
_PREFIXED = {"price": ("range_high_", "range_low_", "range_mid_", "rolling_vwap_"), "vol": ("rv_", "atr", "har_rv")}


def clip_class(name: str) -> str:
    """The class of a feature, by the first rule its name meets."""
    for word in ("vol_adj", "bps", "adl", "minutes", "funding", "flag", "regime", "zscore"):
        if word in name:
            return word
    if name.startswith(_PREFIXED["price"]):
        return "price"
    if name.startswith(_PREFIXED["vol"]) or "volatility" in name or "_vol" in name:
        return "vol"
    if any(word in name for word in ("ratio", "pct", "vs_")):
        return "ratio"
    return "return" if "return" in name else "ratio"


def clip(rows: DataFrame, names: list[str]) -> DataFrame:
    """Values beyond their class's limit are set to it; what is not finite becomes null."""
    for n in names:
        limit = CLIP_LIMITS[clip_class(n)]
        rows = rows.withColumn(n, F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), n))))
    return rows


def family_columns(*families: str) -> list[str]:
    return [n for f in families for n in FAMILIES[f]]
