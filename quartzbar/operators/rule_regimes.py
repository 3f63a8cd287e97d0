"""Regimes by weighted scores with hysteresis, minimum hold and a bypass for breakouts.

What a row proposes depends on its scores and on the regime in force, of which there are three (or none yet); so
a row is one code, made of its four proposals and whether it is a breakout, and the order-dependent part is a
machine with a few hundred states, run like every other scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzbar.operators.scan import Machine, scan, transition_table
from quartzbar.session import checkpointed, with_row_per_key

CLASSES = ("range", "up", "down")
# Weights of the scores over z-scores of features, and the limits of the decisions.
TREND = {"trend_slope_1h": 0.25, "trend_slope_4h": 0.30, "return_4h": 0.15, "ema_gap_4h": 0.15, "trend_slope_24h": 0.15}
FAST = {"return_5": 0.20, "trend_slope_15m": 0.35, "trend_slope_30": 0.45}
VOLATILITY = {"atr_pct_1h": 0.40, "atr_pct_4h": 0.30, "bb_width_1h": 0.30}
QUIET = {"adx_1h": 0.35, "adx_4h": 0.20, "bb_width_1h": 0.30}
CENTER = 0.15
BREAKOUT_VOLUME = 1.5
TREND_ENTER, TREND_EXIT, RANGE_ENTER, FLAT, LEAST_VOLATILITY = 0.70, 0.40, 0.65, 0.45, 0.20
CONFLICT, FAST_EXIT = 0.60, 0.80
HOLD = 60
FEATURES = sorted({*TREND, *FAST, *VOLATILITY, *QUIET})
FLAGS = ("rolling_high_breakout_24h", "rolling_low_breakdown_24h", "volume_z_1h", "distance_from_24h_low", "drawdown_from_24h_high")


def scores(rows: DataFrame) -> DataFrame:
    """symbol, idx, trend, fast, vol, rng, breaks (1 up, 2 down, 0) from rows with FEATURES and FLAGS."""
    fit = rows.groupBy("symbol").agg(*(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.greatest(F.stddev_pop(f), F.lit(1e-9)).alias(f"s_{f}") for f in FEATURES))
    z = {f: (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in FEATURES}

    def total(weights: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for f, w in weights.items():
            out = out + w * z[f]
        return out

    low, high = F.abs("distance_from_24h_low"), F.abs("drawdown_from_24h_high")
    center = F.when(low + high > 0, 1 - 2 * F.abs(low / F.nullif(low + high, F.lit(0.0)) - 0.5)).otherwise(0.0)
    loud = F.col("volume_z_1h") > BREAKOUT_VOLUME
    breaks = F.when((F.col(FLAGS[0]) > 0.5) & loud, 1).when((F.col(FLAGS[1]) > 0.5) & loud, 2).otherwise(0)
    r = lambda c: F.round(c, 9)
    return with_row_per_key(rows, fit, "symbol").select(
        "symbol", "idx", r(total(TREND)).alias("trend"), r(total(FAST) / sum(FAST.values())).alias("fast"), r(total(VOLATILITY)).alias("vol"),
        r(CENTER * center - total(QUIET)).alias("rng"), breaks.alias("breaks"),
    )


def proposals(reversal: bool = True) -> list[Column]:
    """What a row proposes (0 range, 1 up, 2 down) while no regime, range, up or down is in force.

    Without reversal up and down only follow each other by way of range (or a breakout).
    """
    trend, fast, vol, rng = (F.col(c) for c in ("trend", "fast", "vol", "rng"))
    lively = vol > LEAST_VOLATILITY
    rise, fall = (trend > TREND_ENTER) & lively, (trend < -TREND_ENTER) & lively
    agrees_up, agrees_down = fast > -CONFLICT, fast < CONFLICT
    from_range = F.when(rise & agrees_up, 1).when(fall & agrees_down, 2).otherwise(0)
    first = F.when((rng > RANGE_ENTER) & (F.abs(trend) < FLAT), 0).otherwise(from_range)
    held_up = F.when(fast < -FAST_EXIT, 0).when(trend > TREND_EXIT, 1).when(fall & F.lit(reversal), 2).otherwise(0)
    held_down = F.when(fast > FAST_EXIT, 0).when(trend < -TREND_EXIT, 2).when(rise & F.lit(reversal), 1).otherwise(0)
    return [F.when(F.col("breaks") > 0, F.col("breaks")).otherwise(c) for c in (first, from_range, held_up, held_down)]


def machine(hold: int = HOLD, confirm: int = 1):
    """(table, states): a code holds four proposals and the bypass; a state is (regime, rows held, at most hold, pending
    regime, rows in a row it was proposed, at most confirm).

    A switch needs a breakout, or the hold served and the same proposal for ``confirm`` rows in a row.
    """

    def step(state, code):
        bypass, code = divmod(code, 81)
        proposed = [code // 27, code // 9 % 3, code // 3 % 3, code % 3]
        if state is None:
            return (proposed[0], 0, None, 0)
        regime, held, pending, count = state
        new = proposed[1 + regime]
        if new == regime:
            return (regime, min(held + 1, hold), None, 0)
        count = min(count + 1, confirm) if new == pending else 1
        if bypass or (held >= hold and count >= confirm):
            return (new, 0, None, 0)
        return (regime, min(held + 1, hold), new, count) if confirm > 1 else (regime, min(held + 1, hold), None, 0)

    return transition_table(162, None, step)


def with_rule_regimes(rows: DataFrame, hold: int = HOLD, confirm: int = 1, reversal: bool = True) -> DataFrame:
    """symbol, idx, regime from rows (symbol, idx, FEATURES, FLAGS)."""
    p = proposals(reversal)
    code = (F.col("breaks") > 0).cast("int") * 81 + p[0] * 27 + p[1] * 9 + p[2] * 3 + p[3]
    table, states = machine(hold, confirm)
    coded = scores(checkpointed(rows.select("symbol", "idx", *FEATURES, *FLAGS))).select("symbol", "idx", code.cast("int").alias("code"))
    return scan(checkpointed(coded), [Machine("code", table, [CLASSES[s[0]] if s else "" for s in states], "regime")])
