"""SQL of the features, written from their definitions and apart from the operators.

Where the operators use window aggregates, here each row has the list of its last values, and the formulas are
functions of lists. Limits stand beside the formulas.
"""

from __future__ import annotations

from quartzbar.functions.windows import rounded

_O = "OVER (PARTITION BY symbol ORDER BY idx)"


def _last(x: str, n: int) -> str:
    return f"list({x}) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _back(x: str, k: int) -> str:
    return f"lag({x}, {k}) {_O}"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b}) END)"


def _full(n: int, e: str) -> str:
    """e where n values are there, else 0."""
    return f"(CASE WHEN idx + 1 < {n} THEN 0 ELSE coalesce({e}, 0) END)"


def _mean(x: str, n: int) -> str:
    return f"list_avg({_last(x, n)})"


def _sd(x: str, n: int) -> str:
    # Deviations that are mere rounding count as none.
    return f"(CASE WHEN list_stddev_pop({_last(x, n)}) > 1e-12 * abs({_mean(x, n)}) THEN list_stddev_pop({_last(x, n)}) ELSE 0 END)"


def _z(x: str, n: int) -> str:
    return _full(n, _div(f"{x} - {_mean(x, n)}", _sd(x, n)))


def _over_mean(x: str, n: int) -> str:
    return _full(n, f"CASE WHEN {_mean(x, n)} = 0 THEN 0 ELSE {x} / {_mean(x, n)} - 1 END")


def _line(x: str, n: int) -> str:
    weights = ", ".join(f"{i - (n - 1) / 2:.1f}" for i in range(n))
    steps = n * (n * n - 1) / 12
    return _full(n, f"CASE WHEN len({_last(x, n)}) = {n} THEN list_inner_product(CAST({_last(x, n)} AS DOUBLE[]), [{weights}]::DOUBLE[]) / {steps} / {x} END")


def _return(k: int) -> str:
    return f"(CASE WHEN idx < {k} THEN 0 ELSE close / {_back('close', k)} - 1 END)"


def _vwap(n: int) -> str:
    return _full(n, _div(f"list_sum({_last('close * volume', n)})", f"list_sum({_last('volume', n)})"))


# Each layer may use the columns of those before it.
_LAYERS: list[dict[str, str]] = [
    {
        **{f"r{k}": _return(k) for k in (1, 3, 5, 10, 15, 30, 60)},
        "size": "high - low", "share": _div("high - low", "close"), "above": "high - greatest(open, close)", "below": "least(open, close) - low",
        "before": f"coalesce({_back('close', 1)}, close)", "hl": "ln(high) - ln(low)", "co": "ln(close) - ln(open)",
        **{f"mean{n}": _full(n, _mean("close", n)) for n in (5, 10, 20, 60)}, "vwap20": _vwap(20), "vwap60": _vwap(60),
        "top": _full(20, f"list_max({_last('high', 20)})"), "bottom": _full(20, f"list_min({_last('low', 20)})"),
    },
    {
        "true_size": "greatest(size, abs(high - before), abs(low - before))", "off": "CASE WHEN vwap20 = 0 THEN 0 ELSE close - vwap20 END",
        "top_before": f"coalesce({_back('top', 1)}, 0)", "bottom_before": f"coalesce({_back('bottom', 1)}, 0)", "last_close": _back("close", 1),
        **{f"v{n}": f"(CASE WHEN idx < {n} THEN 0 ELSE {_sd('r1', n)} END)" for n in (5, 15, 30, 60, 120)},
        "flow": _div("taker_buy_base_volume - (volume - taker_buy_base_volume)", "volume"),
    },
    {
        "atr14": _full(14, _div(_mean("true_size", 14), "close")), "atr30": _full(30, _div(_mean("true_size", 30), "close")), "z20": _z("close", 20), "z60": _z("close", 60),
        "vz20": _z("volume", 20), "tz20": _z("number_of_trades", 20), "gap2060": "CASE WHEN abs(mean20 - mean60) <= 1e-12 * close THEN 0 ELSE (mean20 - mean60) / close END",
    },
    {"wide": "greatest(v15, v60, v120, atr14, 1e-12)", "v60d": "greatest(v60, 1e-12)"},
]

_HOUR = "CAST(floor(m / 60) AS BIGINT) % 24"
_DAY = "dayofweek(make_timestamp(CAST(m AS BIGINT) * 60000000))"
#: family -> feature -> (formula, limit)
FEATURES: dict[str, dict[str, tuple[str, float]]] = {
    "returns": {
        **{f"return_{k}": (f"r{k}", 0.2) for k in (1, 3, 5, 10, 15, 30, 60)},
        "log_return_1": (f"CASE WHEN idx < 1 THEN 0 ELSE ln(close) - ln({_back('close', 1)}) END", 0.2), "log_return_5": (f"CASE WHEN idx < 5 THEN 0 ELSE ln(close) - ln({_back('close', 5)}) END", 0.2),
        "momentum_10": ("r10", 100), "momentum_30": ("r30", 100),
        "rolling_return_max_20": (f"CASE WHEN idx < 20 THEN 0 ELSE list_max({_last('r1', 20)}) END", 0.2), "rolling_return_min_20": (f"CASE WHEN idx < 20 THEN 0 ELSE list_min({_last('r1', 20)}) END", 0.2),
    },
    "trend": {
        **{f"close_sma_{n}_ratio": (_over_mean("close", n), 100) for n in (5, 10, 20, 60)}, "sma_5_20_spread": (_div("mean5 - mean20", "close"), 100), "sma_20_60_spread": ("gap2060", 100),
        "trend_slope_10": (_line("close", 10), 100), "trend_slope_30": (_line("close", 30), 100), "distance_to_high_20": (_full(20, "close / top - 1"), 100), "distance_to_low_20": (_full(20, "close / bottom - 1"), 100),
        "prev_horizon_trend": (f"CASE WHEN idx < 15 THEN 0 WHEN last_close / {_back('close', 15)} - 1 > 0.001 THEN 1 WHEN last_close / {_back('close', 15)} - 1 < -0.001 THEN -1 ELSE 0 END", 100),
    },
    "volatility": {
        **{f"rv_{n}": (f"v{n}", 10) for n in (5, 15, 30, 60, 120)}, "atr_pct": ("atr14", 10), "atr_pct_30": ("atr30", 10),
        "parkinson_vol_20": (_full(20, f"sqrt(list_avg(list_transform({_last('hl', 20)}, lambda x: x * x)) / (4 * ln(2)))"), 10),
        "garman_klass_vol_20": (_full(20, f"sqrt(greatest(0, 0.5 * list_avg(list_transform({_last('hl', 20)}, lambda x: x * x)) - (2 * ln(2) - 1) * list_avg(list_transform({_last('co', 20)}, lambda x: x * x))))"), 10),
        "range_vol_20": (_full(20, _sd("share", 20)), 10), "har_rv_short": ("v5", 10), "har_rv_medium": ("v30", 10), "har_rv_long": ("v120", 10),
    },
    "activity": {
        **{f"volume_sma_{n}_ratio": (_over_mean("volume", n), 100) for n in (5, 20, 60)}, "quote_volume_sma_20_ratio": (_over_mean("quote_volume", 20), 10),
        "taker_ratio": (_div("taker_buy_base_volume", "volume"), 100), "taker_imbalance": ("flow", 100), "taker_quote_ratio": (_div("taker_buy_quote_volume", "quote_volume"), 100),
        "trade_count_ratio": (_over_mean("number_of_trades", 20), 100), "trade_count_zscore_20": ("tz20", 10), "volume_per_trade": (_div("volume", "number_of_trades"), 100),
        "quote_volume_per_trade": (_div("quote_volume", "number_of_trades"), 10), "volume_shock_20": ("vz20", 100),
    },
    "candle": {
        "high_low_range": ("share", 100), "body_pct": ("abs(close - open) / close", 100), "upper_shadow": ("above / close", 100), "lower_shadow": ("below / close", 100),
        "close_location_value": (_div("2 * close - low - high", "size"), 100), "wick_imbalance": (_div("above - below", "size"), 100), "body_to_range": (_div("abs(close - open)", "size"), 100),
        "range_sma_20_ratio": (_over_mean("size", 20), 100),
        "inside_bar_flag": (f"CASE WHEN idx > 0 AND high <= {_back('high', 1)} AND low >= {_back('low', 1)} THEN 1 ELSE 0 END", 1),
        "outside_bar_flag": (f"CASE WHEN idx > 0 AND high >= {_back('high', 1)} AND low <= {_back('low', 1)} THEN 1 ELSE 0 END", 1),
    },
    "gaps": {"gap_flag": ("gap_flag", 1), "gap_length": ("gap_length", 100), "repaired_flag": ("gap_flag", 1), **{f"gap_ratio_{n}": (_mean("gap_flag", n), 100) for n in (20, 60, 120)}},
    "zscores": {
        "close_zscore_20": ("z20", 10), "close_zscore_60": ("z60", 10), "volume_zscore_5": (_z("volume", 5), 10), "volume_zscore_20": ("vz20", 10), "rv_zscore_60": (_z("v5", 60), 10),
        "range_zscore_20": (_z("share", 20), 10), "volatility_regime_60": (_over_mean("v15", 60), 10), "volume_regime_60": (_over_mean("volume", 60), 10),
    },
    "vol_adjusted": {
        **{f"return_{k}_vol_adj": (f"r{k} / wide", 10) for k in (1, 5, 10, 30)}, "momentum_10_vol_adj": ("r10 / wide", 10), "momentum_30_vol_adj": ("r30 / wide", 10),
        "close_zscore_20_vol_adj": ("z20 / v60d", 10), "close_zscore_60_vol_adj": ("z60 / v60d", 10), "sma_spread_vol_adj": ("gap2060 / v60d", 10), "candle_range_vol_adj": ("share / v60d", 10),
        "body_pct_vol_adj": ("abs(close - open) / close / v60d", 10), "volume_zscore_20_vol_adj": ("vz20 / v60d", 10), "trade_count_zscore_20_vol_adj": ("tz20 / v60d", 10), "taker_imbalance_vol_adj": ("flow / v60d", 10),
    },
    "calendar": {
        "hour": (_HOUR, 100), "minute": ("CAST(m AS BIGINT) % 60", 100), "day_of_week": (f"({_DAY} + 6) % 7", 100), "session_asia": (f"CAST({_HOUR} < 8 AS INTEGER)", 100),
        "session_europe": (f"CAST({_HOUR} >= 8 AND {_HOUR} < 16 AS INTEGER)", 100), "session_us": (f"CAST({_HOUR} >= 16 AS INTEGER)", 100),
        "session_overlap": (f"CAST({_HOUR} >= 8 AND {_HOUR} < 16 AS INTEGER)", 100), "weekend_flag": (f"CAST({_DAY} IN (0, 6) AS INTEGER)", 1),
    },
    "range": {
        "bb_width_20": (_full(20, f"2 * {_sd('close', 20)} / {_mean('close', 20)}"), 100),
        "bb_percent_b": (_full(20, f"CASE WHEN {_sd('close', 20)} = 0 THEN 0.5 ELSE 0.5 + (close - {_mean('close', 20)}) / (4 * {_sd('close', 20)}) END"), 100),
        "rolling_vwap_20": ("vwap20", 1e6), "rolling_vwap_60": ("vwap60", 1e6), "price_vs_rolling_vwap_20": ("CASE WHEN vwap20 = 0 THEN 0 ELSE close / vwap20 - 1 END", 100),
        "price_vs_rolling_vwap_60": ("CASE WHEN vwap60 = 0 THEN 0 ELSE close / vwap60 - 1 END", 100), "range_high_20": ("top", 1e6), "range_low_20": ("bottom", 1e6), "range_mid_20": ("(top + bottom) / 2", 1e6),
        "range_position_20": ("CASE WHEN top <= bottom THEN 0 ELSE greatest(0, least(1, (close - bottom) / (top - bottom))) END", 100),
        "distance_to_range_high": ("CASE WHEN top = 0 THEN 0 ELSE close / top - 1 END", 100), "distance_to_range_low": ("CASE WHEN bottom = 0 THEN 0 ELSE close / bottom - 1 END", 100),
        "fake_break_low": ("CAST(coalesce(bottom_before > 0 AND last_close >= bottom_before AND close < bottom_before AND close > open, false) AS INTEGER)", 100),
        "fake_break_high": ("CAST(coalesce(top_before > 0 AND last_close <= top_before AND close > top_before AND close < open, false) AS INTEGER)", 100),
        "close_back_inside_range": ("CAST(coalesce(top_before > 0 AND bottom_before > 0 AND (last_close > top_before OR last_close < bottom_before) AND close >= bottom AND close <= top, false) AS INTEGER)", 100),
        "vwap_deviation_zscore": (f"CASE WHEN idx < 38 THEN 0 ELSE {_div('off', _sd('off', 20))} END", 10), "bb_zscore": ("z20", 10),
    },
}


def _used(wanted: list[str]) -> list[dict[str, str]]:
    """The layers with the columns that the formulas need, directly or not."""
    import re

    text, out = " ".join(wanted), []
    for layer in reversed(_LAYERS):
        kept = {n: e for n, e in layer.items() if re.search(rf"\b{n}\b", text)}
        text += " " + " ".join(kept.values())
        out.append(kept)
    return out[::-1]


def sql(canonical_sql: str, *families: str, digits: int = 6, clipped: bool = True) -> str:
    """symbol, idx and the features of the families."""
    wanted = {n: x for f in families for n, x in FEATURES[f].items()}
    parts, last = [f"canon AS MATERIALIZED ({canonical_sql})"], "canon"
    for i, layer in enumerate(_used([e for e, _ in wanted.values()])):
        if layer:
            parts.append(f"step{i} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {last})")
            last = f"step{i}"
    parts.append(f"found AS (SELECT symbol, idx, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, (e, _) in wanted.items())} FROM {last})")
    value = lambda n: f"greatest(-{wanted[n][1]}, least({wanted[n][1]}, {n}))" if clipped else n
    return f"WITH {', '.join(parts)} SELECT symbol, idx, {', '.join(rounded(list(wanted), digits, value))} FROM found"


_B = "PARTITION BY symbol ORDER BY bucket"


def _upto(x: str, n: int) -> str:
    return f"list({x}) OVER ({_B} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _fit(x: str) -> str:
    """Slope of a list of any length over 0, 1, ..."""
    return (
        f"(CASE WHEN len({x}) < 2 THEN 0 ELSE list_sum(list_transform({x}, lambda y, i: (i - (len({x}) + 1) / 2.0) * y))"
        f" * 12.0 / (len({x}) * (len({x}) * len({x}) - 1.0)) END)"
    )


_FLAT = "CASE WHEN list_stddev_pop({x}) > 1e-12 * abs(list_avg({x})) THEN list_stddev_pop({x}) ELSE 0 END"
_MOVES = "list_filter(list_transform({h}, lambda x, i: CASE WHEN i > 1 THEN {e} END), lambda x: x IS NOT NULL)"


def _moves(e: str) -> str:
    """A value of each bucket and the one before it (y), over the last 15 buckets."""
    return _MOVES.format(h="h15", e=e.replace("y.", "h15[i - 1]."))


def frame_sql(canonical_sql: str, minutes: int, tf: str, digits: int = 6) -> str:
    """The indicators of closed buckets by lists of the buckets before them, carried onto the minutes."""
    up, down = "greatest(0, x.c - y.c)", "greatest(0, y.c - x.c)"
    parts = f"""
canon AS MATERIALIZED ({canonical_sql}),
b AS MATERIALIZED (
  SELECT symbol, CAST(floor(m / {minutes}) AS BIGINT) AS bucket, first(open ORDER BY m) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY m) AS c, sum(volume) AS v
  FROM canon GROUP BY ALL HAVING count(*) = {minutes}
), s AS MATERIALIZED (
  SELECT symbol, bucket, c, h, l, v, {_upto("c", 10)} AS c10, {_upto("c", 11)} AS c11, {_upto("c", 20)} AS c20, {_upto("v", 20)} AS v20, {_upto("c", 24)} AS c24, {_upto("h", 24)} AS hi24, {_upto("l", 24)} AS lo24,
         {_upto("{'h': h, 'l': l, 'c': c}", 15)} AS h15
  FROM b
), t AS MATERIALIZED (
  SELECT *, len(c20) AS n, 2.0 / (len(c20) + 1) AS a, list_avg({_moves(up)}) AS gain, list_avg({_moves(down)}) AS loss,
         list_avg({_moves("greatest(x.h - x.l, abs(x.h - y.c), abs(x.l - y.c))")}) AS atr,
         list_avg({_moves("CASE WHEN x.h - y.h > y.l - x.l AND x.h > y.h THEN x.h - y.h ELSE 0 END")}) AS plus,
         list_avg({_moves("CASE WHEN y.l - x.l > x.h - y.h AND y.l > x.l THEN y.l - x.l ELSE 0 END")}) AS minus,
         list_reduce(c20, lambda e, x: e + 2.0 / (len(c20) + 1) * (x - e)) AS ema
  FROM s
), x AS (
  SELECT symbol, (bucket + 1) * {minutes} AS known_at,
    {_fit("c10")} / c AS trend_slope_{tf}, c / c11[1] - 1 AS return_{tf}, (c - ema) / c AS ema_gap_{tf},
    CASE WHEN len(c11) < 11 THEN 0 ELSE list_avg(c11[2:11]) / list_avg(c11[1:10]) - 1 END AS ma_slope_{tf},
    CASE WHEN len(h15) < 15 THEN 50 WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 * gain / (gain + loss) END AS rsi_{tf},
    CASE WHEN len(h15) < 15 THEN 0 ELSE atr / c END AS atr_pct_{tf}, 4 * ({_FLAT.format(x="c20")}) / list_avg(c20) AS bb_width_{tf},
    CASE WHEN len(h15) < 15 OR plus + minus = 0 THEN 0 ELSE 100 * abs(plus - minus) / (plus + minus) END AS adx_{tf},
    CASE WHEN ({_FLAT.format(x="v20")}) = 0 THEN 0 ELSE (v - list_avg(v20)) / ({_FLAT.format(x="v20")}) END AS volume_z_{tf}
"""
    names = [f"{n}_{tf}" for n in ("trend_slope", "return", "ema_gap", "ma_slope", "rsi", "atr_pct", "bb_width", "adx", "volume_z")]
    if tf == "1h":
        parts += f""", {_fit("c24")} / c AS trend_slope_24h, c / c24[1] - 1 AS return_24h, 1 - c / list_max(hi24) AS drawdown_from_24h_high, c / list_max(hi24) - 1 AS distance_from_24h_high,
    c / list_min(lo24) - 1 AS distance_from_24h_low, CAST(c >= list_max(hi24) AS INTEGER) AS rolling_high_breakout_24h, CAST(c <= list_min(lo24) AS INTEGER) AS rolling_low_breakdown_24h"""
        names += ["trend_slope_24h", "return_24h", "drawdown_from_24h_high", "distance_from_24h_high", "distance_from_24h_low", "rolling_high_breakout_24h", "rolling_low_breakdown_24h"]
    out = rounded(names, digits, lambda n: f"CAST(coalesce({n}, {50 if n.startswith('rsi_') else 0}) AS DOUBLE)")
    return f"WITH {parts} FROM t) SELECT c.symbol, c.idx, {', '.join(out)} FROM canon AS c ASOF LEFT JOIN x ON c.symbol = x.symbol AND c.m >= x.known_at"
