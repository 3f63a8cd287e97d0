"""An event-ordered backtest with one position at a time.

A row with a signal may open a position at its close; it ends at the first of the next rows that touches a
barrier, else at the horizon. When it ends depends on the row alone; only whether it is opened depends on the
trades before. That is a walk along pointers whose only memory is for how many more rows a position (or the
pause after it) blocks the next, a number below horizon + pause + 2; so chunks are walked from every such start
and composed like other scans (see scan).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.operators.scan import start_states
from quartzbar.operators.timeline import in_chunks

TRADES = "symbol string, entry_idx long, exit_idx long, side int, entry double, exit double, reason string, gross double, net double"


def outcomes(p: pd.DataFrame, horizon: int, tp: float, sl: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows until the exit, exit price, reason code) of a position opened at each row; 0 tp, 1 sl, 2 horizon, 3 end."""
    o, h, lo, c = (p[k].to_numpy("float64") for k in ("open", "high", "low", "close"))
    side = p["signal"].to_numpy()
    n = len(p)
    wait, price, why = np.zeros(n, int), np.zeros(n), np.full(n, -1)
    up, down = c * (1 + np.where(side > 0, tp, sl)), c * (1 - np.where(side > 0, sl, tp))
    for k in range(1, horizon + 1):
        m = n - k
        if m <= 0:
            break
        hit_up, hit_down = h[k:] >= up[:m], lo[k:] <= down[:m]
        new = (why[:m] < 0) & (hit_up | hit_down)
        # Both in one row: the row's own direction says which came first, against the position if there is none.
        rising, falling = c[k:] > o[k:], c[k:] < o[k:]
        long = side[:m] > 0
        takes_up = np.where(hit_up & hit_down, np.where(long, rising, ~falling), hit_up)
        i = np.flatnonzero(new)
        wait[i], price[i] = k, np.where(takes_up, up[:m], down[:m])[i]
        why[i] = np.where(takes_up == long, 0, 1)[i]
    last = np.minimum(np.arange(n) + horizon, n - 1)
    late = why < 0
    wait[late], price[late] = (last - np.arange(n))[late], c[last][late]
    why[late] = np.where(np.arange(n) + horizon < n, 2, 3)[late]
    return wait, price, why


def backtest(rows: DataFrame, horizon: int = 30, tp: float = 0.004, sl: float = 0.002, pause: int = 2, cost: float = 0.0008) -> DataFrame:
    """Trades from rows (symbol, idx, open, high, low, close, signal: 1 long, -1 short, 0 none)."""
    chunks = in_chunks(rows, before=0, after=horizon)
    reach = horizon + pause + 2
    names = np.array(["take_profit", "stop_loss", "horizon", "end"], dtype=object)

    def prepare(p: pd.DataFrame):
        p = p.sort_values("idx", kind="stable")
        core = int(p["core"].sum())
        wait, price, why = outcomes(p, horizon, tp, sl)
        signal = p["signal"].to_numpy()[:core]
        # Without a pause the row of the exit may open the next position; a position lasts one row at least.
        free = np.arange(core) + np.maximum(wait[:core] + (pause + 1 if pause else 0), 1)
        return p, core, signal, free, wait, price, why

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        p, core, signal, free, *_ = prepare(p)
        end = np.zeros(core + reach, dtype=int)
        end[core:] = np.arange(reach)
        for i in range(core - 1, -1, -1):
            end[i] = end[min(free[i], core + reach - 1)] if signal[i] else end[i + 1]
        starts = np.minimum(np.arange(reach), core + reach - 1)
        return pd.DataFrame({"symbol": p["symbol"].astype(object).iloc[:1].to_numpy(), "chunk": p["chunk"].iloc[:1].to_numpy(), "ends": [end[starts].tolist()]})

    def write(p: pd.DataFrame) -> pd.DataFrame:
        start = int(p["start"].iloc[0])
        p, core, signal, free, wait, price, why = prepare(p)
        at, i = [], start
        while i < core:
            if signal[i]:
                at.append(i)
                i = int(free[i])
            else:
                i += 1
        at = np.array(at, dtype=int)
        idx, close, side = p["idx"].to_numpy(), p["close"].to_numpy("float64"), p["signal"].to_numpy()
        gross = side[at] * (price[at] / close[at] - 1)
        return pd.DataFrame(
            {
                "symbol": pd.Series(np.full(len(at), p["symbol"].iloc[0], dtype=object), dtype=object), "entry_idx": idx[at], "exit_idx": idx[at] + wait[at],
                "side": side[at].astype("int32"), "entry": close[at], "exit": price[at], "reason": pd.Series(names[why[at]], dtype=object),
                "gross": gross, "net": gross - cost,
            }
        )

    maps = chunks.groupBy("symbol", "chunk").applyInPandas(ends, "symbol string, chunk long, ends array<int>")
    return chunks.join(start_states(maps, reach), ["symbol", "chunk"]).groupBy("symbol", "chunk").applyInPandas(write, TRADES)


def breakdown(trades: DataFrame) -> DataFrame:
    """Trades by symbol, by side, by reason, by side and reason, and all together: one pass with grouping sets."""
    keys = [F.col(c) for c in ("symbol", "side", "reason")]
    s, sd, r = keys
    win, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") <= 0, -F.col("net"))
    out = trades.groupingSets([[s], [sd], [r], [sd, r], []], *keys).agg(
        F.count(F.lit(1)).alias("trades"), F.coalesce(F.avg((F.col("net") > 0).cast("int")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(win) / F.nullif(F.sum(loss), F.lit(0.0)), F.lit(0.0)).alias("profit_factor"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("compounded"), F.avg("net").alias("mean_net"),
    )
    return out.select(
        F.coalesce("symbol", F.lit("all")).alias("symbol"), F.coalesce(F.col("side").cast("string"), F.lit("all")).alias("side"), F.coalesce("reason", F.lit("all")).alias("reason"),
        "trades", "win_rate", "profit_factor", "compounded", "mean_net",
    )
