"""Irregular readings onto a regular grid by compact-kernel local polynomial regression.

Each grid minute is estimated from the readings within the bandwidth around it: a local polynomial of degree
one, weighted by the Epanechnikov kernel, whose readings are looked up by index (binary search) in the sorted
readings of its block. The effective support (sum of weights squared by sum of squared weights) says how many
full readings an estimate rests on; where it is below the least support the minute stays empty and marked.

The grid itself is never shuffled: coverage windows are cut into spans per entity and block of time, readings
go to their block and, if they lie within the bandwidth of its border, to the neighbour too. An entity with a
third of all readings is spread over as many tasks as it has blocks; a block holds a bounded span of time.

Defined results: readings with null or NaN values or no time are no readings; several readings of one minute
count as one, the last delivered (then the largest id); windows without readings give empty marked minutes;
readings outside all windows only help their neighbours; empty windows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
SCHEMA = (
    "symbol string, minute_ms long, missing boolean, status string, close double, volume double, "
    "close_fit double, volume_fit double, support double, readings int"
)


def local_linear(grid: np.ndarray, t: np.ndarray, y: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits of the columns of y at each grid time, the effective support, the number of readings in reach.

    t must be sorted. Where the readings in reach span no time, the weighted mean stands for the line.
    """
    n, k = len(grid), y.shape[1]
    lo, hi = np.searchsorted(t, grid - bandwidth, "right"), np.searchsorted(t, grid + bandwidth, "left")
    s0, s1, s2, w2 = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    b0, b1 = np.zeros((n, k)), np.zeros((n, k))
    for j in range(int((hi - lo).max(initial=0))):
        at = np.minimum(lo + j, len(t) - 1)
        d = (t[at] - grid) / bandwidth
        w = np.where(lo + j < hi, 1 - d * d, 0.0)
        s0, s1, s2, w2 = s0 + w, s1 + w * d, s2 + w * d * d, w2 + w * w
        b0 += w[:, None] * y[at]
        b1 += (w * d)[:, None] * y[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        det = s0 * s2 - s1 * s1
        line = (s2[:, None] * b0 - s1[:, None] * b1) / det[:, None]
        mean = b0 / s0[:, None]
        fit = np.where((det > 1e-9 * np.maximum(s0 * s0, 1e-300))[:, None], line, mean)
        support = np.where(w2 > 0, s0 * s0 / w2, 0.0)
    return fit, support, hi - lo


def regular_grid(
    bars: DataFrame, windows: DataFrame, bandwidth_min: float = 6.0, least_support: float = 2.0, block_min: int = 1440
) -> DataFrame:
    """One row per symbol and minute of its coverage windows.

    close and volume are the reading of the minute or, where it is missing, the fit if its support suffices;
    status says which: read, filled or missing. Fits of volume are not below zero.
    """
    block_us, reach_us = block_min * MINUTE_US, int(bandwidth_min * MINUTE_US)
    assert block_us >= reach_us + MINUTE_US
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    whole = windows.select("symbol", us("start_time").alias("a"), us("end_time").alias("b")).where("symbol IS NOT NULL AND a < b")
    spans = (
        whole.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_us), F.floor((F.col("b") - 1) / block_us))))
        .select("symbol", "block", F.greatest("a", F.col("block") * block_us).alias("t"), F.least("b", (F.col("block") + 1) * block_us).alias("until"))
        .select("symbol", "block", F.lit(0).alias("kind"), "t", "until", F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"), F.lit(None).cast("long").alias("came"), F.lit(None).cast("long").alias("id"))
    )
    t = us("open_time")
    minute = F.floor((t + MINUTE_US // 2) / MINUTE_US) * MINUTE_US
    # A minute's readings go together, so that each block picks the same one of them.
    margin = reach_us + MINUTE_US
    reached = F.array_distinct(F.array(*(F.floor(x / block_us) for x in (minute, t - margin, t + margin))))
    readings = (
        bars.where("symbol IS NOT NULL AND open_time IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL AND NOT isnan(close) AND NOT isnan(volume)")
        .select("symbol", F.explode(reached).alias("block"), F.lit(1).alias("kind"), t.alias("t"), minute.alias("until"), "close", "volume", us("ingested_at").alias("came"), F.col("bar_id").alias("id"))
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        spans_, got = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        if not len(spans_):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in SCHEMA.split(", ")})
        # Window borders are whole minutes; others are rounded up to the first minute inside.
        grid = np.unique(np.concatenate([np.arange(-(-a // MINUTE_US), -(-b // MINUTE_US)) for a, b in zip(spans_["t"], spans_["until"])])) * MINUTE_US
        got = got.assign(came=got["came"].fillna(-1)).sort_values(["until", "came", "id"], kind="stable").drop_duplicates("until", keep="last").sort_values("t", kind="stable")
        rt, ry, rm = got["t"].to_numpy("int64"), got[["close", "volume"]].to_numpy("float64"), got["until"].to_numpy("int64")
        if len(rt):
            zero = grid[0] if len(grid) else 0
            fit, support, n = local_linear((grid - zero).astype("float64"), (rt - zero).astype("float64"), ry, float(reach_us))
            by_minute = np.argsort(rm, kind="stable")
            at = np.minimum(np.searchsorted(rm[by_minute], grid), len(rm) - 1)
            row = by_minute[at]
            missing = rm[row] != grid
            own = np.where(missing[:, None], np.nan, ry[row])
        else:
            fit, support, n = np.full((len(grid), 2), np.nan), np.zeros(len(grid)), np.zeros(len(grid), "int64")
            missing, own = np.ones(len(grid), bool), np.full((len(grid), 2), np.nan)
        fit[:, 1] = np.maximum(fit[:, 1], 0.0)
        enough = support >= least_support
        fit[~enough] = np.nan
        best = np.where(missing[:, None], fit, own)
        # Object columns: pandas' own strings may reach Arrow in chunks, which it refuses here.
        status = np.array(["missing", "filled", "read"], dtype=object)[np.where(~missing, 2, enough.astype(int))]
        symbol = np.full(len(grid), pdf["symbol"].iloc[0], dtype=object)
        return pd.DataFrame(
            {
                "symbol": pd.Series(symbol, dtype=object), "minute_ms": grid // 1000, "missing": missing, "status": pd.Series(status, dtype=object),
                "close": best[:, 0], "volume": best[:, 1], "close_fit": fit[:, 0], "volume_fit": fit[:, 1],
                "support": support, "readings": n.astype("int32"),
            }
        )

    out = spans.unionByName(readings).groupBy("symbol", "block").applyInPandas(fill, SCHEMA)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "volume", "close_fit", "volume_fit")})
