"""Forward-looking labels: triple barriers, direction, returns, by chunks with a halo of the horizon.

Each step into the future is one vectorised comparison of a whole chunk, so the cost is the horizon times the
rows and nothing is joined. Rows whose horizon is not whole, or whose close is 0, give no label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.operators.timeline import in_chunks

# Reasons of a label.
REASONS = (
    "tp_first", "sl_first", "timeout_no_tp", "ambiguous_path", "no_fill", "partial_fill", "post_only_blocked",
    "gap_cross_timeout", "gap_cross_sl", "funding_force_close", "funding_cross", "liquidation",
)
SCHEMA = (
    "symbol string, idx long, label int, label_reason string, long_success int, long_reason string, "
    "short_success int, short_reason string, direction int, target_return double"
)


def of_chunk(horizon: int, tp: float, sl: float, threshold: float, p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("idx", kind="stable")
    o, h, lo, c = (p[k].to_numpy("float64") for k in ("open", "high", "low", "close"))
    gap = p["gap_flag"].to_numpy() == 1
    n = max(len(p) - horizon, 0)
    keep = p["core"].to_numpy(bool)[:n] & (c[:n] != 0)
    rise, fall = c > o, c < o
    # Which step touched first, and what it was: for both-sided, long and short barriers.
    entry = c[:n]
    long_hit, short_hit = np.zeros(n, "int8"), np.zeros(n, "int8")  # 1 profit, 2 loss
    both_hit, reason = np.zeros(n, "int8"), np.full(n, "", dtype=object)
    seen_gap = np.zeros(n, bool)
    for k in range(1, horizon + 1):
        hk, lk, up, down, gk = (x[k : n + k] for x in (h, lo, rise, fall, gap))
        above, below = hk >= entry * (1 + tp), lk <= entry * (1 - sl)
        seen_gap |= gk & (both_hit == 0)
        new = (both_hit == 0) & (above | below)
        if new.any():
            tie = above & below
            win = np.where(tie, up, above)
            why = np.where(tie, np.where(up, "tp_first", np.where(down, "sl_first", "ambiguous_path")), np.where(above, "tp_first", np.where(gk, "gap_cross_sl", "sl_first")))
            both_hit[new] = np.where(win, 1, 2)[new]
            reason[new] = why[new]
            long_hit[new] = np.where(tie, np.where(up, 1, 2), np.where(above, 1, 2))[new]
        under, over = lk <= entry * (1 - tp), hk >= entry * (1 + sl)
        new = (short_hit == 0) & (under | over)
        short_hit[new] = np.where(under & over, np.where(down, 1, 2), np.where(under, 1, 2))[new]
    ret = (c[horizon : n + horizon] - entry) / np.where(entry != 0, entry, 1)
    late = both_hit == 0
    reason[late] = np.where(seen_gap, "gap_cross_timeout", "timeout_no_tp")[late]
    label = np.where(late, ret > threshold, both_hit == 1)
    name = lambda side, hit: np.array([f"{side}_timeout", f"{side}_tp_first", f"{side}_sl_first"], dtype=object)[hit]
    return pd.DataFrame(
        {
            "symbol": p["symbol"].astype(object).to_numpy()[:n], "idx": p["idx"].to_numpy()[:n], "label": label.astype("int32"), "label_reason": reason,
            "long_success": (long_hit == 1).astype("int32"), "long_reason": name("long", long_hit),
            "short_success": (short_hit == 1).astype("int32"), "short_reason": name("short", short_hit),
            "direction": (ret > 0).astype("int32"), "target_return": ret,
        }
    )[keep]


def triple_barriers(timeline: DataFrame, horizon: int = 60, tp: float = 0.01, sl: float = 0.005, threshold: float = 0.001) -> DataFrame:
    """Label, reason, success of long and short, direction and return of every row with a whole horizon."""
    if horizon <= 0 or tp <= 0 or sl <= 0:
        raise ValueError("horizon and barriers must be positive")
    rows = in_chunks(timeline.select("symbol", "idx", "open", "high", "low", "close", "gap_flag"), before=0, after=horizon)
    return rows.groupBy("symbol", "chunk").applyInPandas(lambda p: of_chunk(horizon, tp, sl, threshold, p), SCHEMA)


def reason_counts(labels: DataFrame) -> DataFrame:
    """label_reason, n for all reasons, those that never occur too."""
    spark = labels.sparkSession
    every = spark.createDataFrame([(r,) for r in REASONS], "label_reason string")
    counts = labels.groupBy("label_reason").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "label_reason", "left").select("label_reason", F.coalesce("n", F.lit(0)).alias("n"))


def external_labels(labels: DataFrame, events: DataFrame, threshold: float = 0.001) -> DataFrame:
    """labels (symbol, idx, open_time, label, label_reason, target_return, ...) with those of events (symbol, idx or open_time,
    label_reason, label or null) put over them.

    An event is looked up by row number, then by time; of several the least label and reason count. A known reason
    settles the label where the event gives none: take profit 1, a loss 0, else the return decides. Unknown reasons
    and labels other than 0 and 1 are refused.
    """
    ok = F.col("label_reason").isin(*REASONS) & (F.col("label").isNull() | F.col("label").isin(0, 1))
    refused = F.raise_error(F.concat(F.lit("unknown label or reason: "), F.coalesce("label_reason", F.lit("null")))).cast("string")
    checked = events.withColumn("label_reason", F.when(F.coalesce(ok, F.lit(False)), F.col("label_reason")).otherwise(refused))
    pick = F.min(F.struct("label_reason", "label"))
    by_idx = checked.where("idx IS NOT NULL").groupBy("symbol", "idx").agg(pick.alias("_i"))
    by_time = checked.where("idx IS NULL AND open_time IS NOT NULL").groupBy("symbol", "open_time").agg(pick.alias("_t"))
    j = labels.join(by_idx, ["symbol", "idx"], "left").join(by_time, ["symbol", "open_time"], "left").withColumn("_e", F.coalesce("_i", "_t"))
    reason = F.col("_e.label_reason")
    given = F.coalesce(
        F.col("_e.label"), F.when(reason == "tp_first", 1).when(~reason.isin("timeout_no_tp", "gap_cross_timeout"), 0).when(reason.isNotNull(), (F.col("target_return") > threshold).cast("int"))
    )
    return j.withColumn("label", F.coalesce(given, F.col("label"))).withColumn("label_reason", F.coalesce(reason, F.col("label_reason"))).drop("_i", "_t", "_e")


def with_target(labels: DataFrame, target: str) -> DataFrame:
    """labels whose label is that of a target: profitability (as it is), long_success or short_success."""
    if target == "profitability":
        return labels
    if target not in ("long_success", "short_success"):
        raise ValueError(f"unknown target {target}")
    return labels.withColumn("label", F.col(target).cast("int"))
