"""Features that depend on all bars before: exponential means, Wilder's index, their combinations.

Each chunk of minutes starts its recursions anew FORGET minutes ahead of its first row. The slowest weight
that remains after them, (59/61)^FORGET, is below 1e-18, under the rounding of a double; so the results are
those of one pass over the whole symbol, and no symbol needs to fit into one task. Only the first chunk is
seeded by the series' true beginning, whose warm-up values it alone shows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quartzbar.operators.timeline import in_chunks

FORGET = 1536
NAMES = (
    "close_ema_12_ratio", "close_ema_26_ratio", "ema_12_26_spread", "ema_5_slope", "ema_20_slope", "ema_60_slope",
    "rsi_7", "rsi_14", "macd_line", "macd_signal", "macd_hist",
)


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean with weight 2 / (span + 1), seeded with the first value."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def wilder_rsi(close: np.ndarray, period: int) -> np.ndarray:
    """Wilder's index: seeded with the means of the first changes; 50 until then and where nothing changes."""
    out = np.full(len(close), 50.0)
    if len(close) < period + 1:
        return out
    change = np.diff(close)
    means = []
    for part in (np.maximum(change, 0), np.maximum(-change, 0)):
        series = np.concatenate([[part[:period].mean()], part[period:]])
        means.append(pd.Series(series).ewm(alpha=1 / period, adjust=False).mean().to_numpy())
    gain, loss = means
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100 - 100 / (1 + gain / loss)
    # Differences of equal prices are exactly zero; what decays towards it counts as nothing at last.
    value = np.where(loss > 0, value, np.where(gain > 0, 100.0, 50.0))
    out[period:] = value
    return out


def slope_over(x: np.ndarray, n: int) -> np.ndarray:
    """Least-squares slope over the last n values in units of the current one; 0 where there are fewer."""
    out = np.zeros(len(x))
    if len(x) >= n:
        steps = np.arange(n) - (n - 1) / 2
        view = np.lib.stride_tricks.sliding_window_view(x, n)
        out[n - 1 :] = (view - view[:, -1:]) @ steps / (steps @ steps) / view[:, -1]
    return out


def of_chunk(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("idx", kind="stable")
    close, idx = p["close"].to_numpy("float64"), p["idx"].to_numpy()
    emas = {n: ema(close, n) for n in (5, 12, 20, 26, 60)}
    shown = {n: np.where(idx >= n - 1, e, 0.0) for n, e in emas.items()}
    ratio = lambda e: np.where(e != 0, close / np.where(e != 0, e, 1) - 1, 0.0)
    line = shown[12] - shown[26]
    signal = np.where(idx >= 8, ema(line, 9), 0.0)
    slope = lambda n, w: np.where(idx >= n + w - 1, slope_over(emas[n], w), 0.0)
    out = {
        "symbol": p["symbol"].astype(object), "idx": idx,
        "close_ema_12_ratio": ratio(shown[12]), "close_ema_26_ratio": ratio(shown[26]), "ema_12_26_spread": line / close,
        "ema_5_slope": slope(5, 5), "ema_20_slope": slope(20, 10), "ema_60_slope": slope(60, 10),
        "rsi_7": wilder_rsi(close, 7), "rsi_14": wilder_rsi(close, 14),
        "macd_line": line, "macd_signal": signal, "macd_hist": line - signal,
    }
    return pd.DataFrame(out)[p["core"].to_numpy(bool)]


def with_recursive_features(timeline: DataFrame) -> DataFrame:
    """The timeline's symbol, idx and the recursive features."""
    rows = in_chunks(timeline.select("symbol", "idx", "close"), before=FORGET)
    schema = "symbol string, idx long, " + ", ".join(f"{n} double" for n in NAMES)
    return rows.groupBy("symbol", "chunk").applyInPandas(of_chunk, schema)


def sql_text(canonical_sql: str) -> str:
    """The same features as one recursive query over whole symbols."""
    step = lambda n: f"{2 / (n + 1)!r} * c.close + {1 - 2 / (n + 1)!r} * s.e{n}"
    rsi_items, rsi_start = [], []
    for p in (7, 14):
        for side, change in (("g", "greatest(c.close - s.close, 0)"), ("l", "greatest(s.close - c.close, 0)")):
            rsi_start.append(f"CAST(0 AS DOUBLE) AS {side}{p}")
            # Up to row p the sum of changes grows; at row p it becomes their mean.
            rsi_items.append(
                f"CASE WHEN c.idx < {p} THEN s.{side}{p} + {change} WHEN c.idx = {p} THEN (s.{side}{p} + {change}) / {p}"
                f" ELSE (s.{side}{p} * {p - 1} + {change}) / {p} END"
            )
    spans = (5, 12, 20, 26, 60)
    shown = lambda n, i: f"CASE WHEN {i} >= {n - 1} THEN {{}} ELSE 0 END"
    line = f"({shown(12, 'c.idx').format(step(12))}) - ({shown(26, 'c.idx').format(step(26))})"
    rsi = lambda p: (
        f"CASE WHEN idx < {p} THEN 50 WHEN l{p} > 0 THEN 100 - 100 / (1 + g{p} / l{p}) WHEN g{p} > 0 THEN 100 ELSE 50 END"
    )
    slope = lambda n, w: (
        f"CASE WHEN idx >= {n + w - 1} THEN regr_slope(e{n} , idx) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / e{n} ELSE 0 END"
    )
    return f"""
WITH RECURSIVE canon AS MATERIALIZED (SELECT symbol, idx, close FROM ({canonical_sql})),
s AS (
  SELECT symbol, idx, close, {", ".join(f"close AS e{n}" for n in spans)}, CAST(0 AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS sig, {", ".join(rsi_start)}
  FROM canon WHERE idx = 0
  UNION ALL
  SELECT c.symbol, c.idx, c.close, {", ".join(step(n) for n in spans)}, {line}, 0.2 * ({line}) + 0.8 * s.sig, {", ".join(rsi_items)}
  FROM s JOIN canon AS c ON c.symbol = s.symbol AND c.idx = s.idx + 1
),
f AS (
  SELECT symbol, idx,
    CASE WHEN idx >= 11 THEN close / e12 - 1 ELSE 0 END AS close_ema_12_ratio, CASE WHEN idx >= 25 THEN close / e26 - 1 ELSE 0 END AS close_ema_26_ratio,
    line / close AS ema_12_26_spread, {slope(5, 5)} AS ema_5_slope, {slope(20, 10)} AS ema_20_slope, {slope(60, 10)} AS ema_60_slope,
    {rsi(7)} AS rsi_7, {rsi(14)} AS rsi_14, line AS macd_line, CASE WHEN idx >= 8 THEN sig ELSE 0 END AS macd_signal,
    line - CASE WHEN idx >= 8 THEN sig ELSE 0 END AS macd_hist
  FROM s
)
SELECT * FROM f"""
