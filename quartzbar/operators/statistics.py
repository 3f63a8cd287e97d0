"""Evaluation of predictions and features: metrics, calibration, thresholds, rank correlation, half-life.

All of it is one or two map-side combined aggregations, or works in blocks (see asof).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import mean_ranks, prefix_sums
from quartzbar.session import checkpointed, with_row_per_key

_BLOCK = 8192
# Thresholds are k / 10000; those of one shard are folded in one task, rows of one block in another.
_STEPS, _SHARD, _THRESHOLD_BLOCK = 10_000, 512, 32_768


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per symbol from scored (symbol, p, y): accuracy, precision, recall, F1, Brier score and skill, log-loss."""
    hit, y, p = (F.col("p") >= threshold).cast("int"), F.col("y"), F.col("p")
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    s = scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"),
        F.sum((1 - hit) * (1 - y)).alias("tn"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("base"),
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"),
    )
    precision, recall = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    naive = F.col("base") * (1 - F.col("base"))
    return s.select(
        "symbol", "n", _div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _div(2 * precision * recall, precision + recall).alias("f1"), "brier", F.coalesce(F.when(naive != 0, 1 - F.col("brier") / naive), F.lit(0.0)).alias("brier_skill"), "log_loss",
    )


def reliability_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, observed for all bins of equal width; the last is closed; empty ones have nulls."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed")


def calibration_errors(scored: DataFrame, bins: int = 10, least: int = 20) -> DataFrame:
    """One row: expected error over all bins, over bins of at least so many rows, and the greatest error."""
    c = reliability_curve(scored, bins).where("n > 0").withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))
    big = F.when(F.col("n") >= least, F.col("n"))
    return c.agg(
        F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(0.0)).alias("ece"),
        (F.sum(big * F.col("gap")) / F.sum(big)).alias("ece_large_bins"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"),
    )


def _curves(key: np.ndarray, win: np.ndarray, gain: float, loss: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending, states): wins, losses and of their running sum peak, low and greatest fall, over the rows of at least a key.

    A state holds down to the next smaller key; beyond the last key it is all 0 (the last column).
    """
    if len(key) > 64:
        half = len(key) // 2
        (ka, a), (kb, b) = _curves(key[:half], win[:half], gain, loss), _curves(key[half:], win[half:], gain, loss)
        keys = np.union1d(ka, kb)
        at = lambda k, x: x[:, np.append(np.searchsorted(k, keys), len(k))]
        return keys, _after(at(ka, a), at(kb, b), gain, loss)
    keys = np.unique(key)
    taken = key >= keys[:, None]
    run = np.cumsum(np.where(taken, np.where(win, gain, -loss), 0.0), axis=1)
    top = np.maximum.accumulate(np.maximum(run, 0.0), axis=1)
    wins = (taken & win).sum(axis=1)
    states = np.array([wins, taken.sum(axis=1) - wins, top[:, -1], np.minimum(run, 0.0).min(axis=1), (top - run).max(axis=1)], dtype=float)
    return keys, np.hstack([states, np.zeros((5, 1))])


def _after(a: np.ndarray, b: np.ndarray, gain: float, loss: float) -> np.ndarray:
    """States of rows (see _curves) that go on with further rows."""
    total = a[0] * gain - a[1] * loss
    fall = np.maximum(np.maximum(a[4], b[4]), a[2] - total - b[3])
    return np.array([a[0] + b[0], a[1] + b[1], np.maximum(a[2], total + b[2]), np.minimum(a[3], total + b[3]), fall])


def threshold_ranking(scored: DataFrame, gain: float, loss: float, size: int = _THRESHOLD_BLOCK) -> DataFrame:
    """Per symbol from scored (symbol, idx, p, y) the threshold that ranks first, with trades, calmar, sharpe, f1.

    Candidates are 0.05 to 0.95 in steps of 0.05 and every p rounded to four digits; a candidate needs trades in a
    twentieth of the rows (one at least). They rank by total per greatest fall (calmar), ratio of mean and deviation
    (sharpe), f1, nearness to 0.5; ties: the smaller. Without any candidate it is 0.5. Figures are compared to nine digits.

    Each block of rows makes one state per threshold; those of a range of thresholds are folded in the order of blocks.
    """
    rows = scored.where(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull()).select(
        "symbol", "idx", F.floor(F.col("idx") / size).alias("block"), F.col("p").cast("double").alias("p"), (F.col("y") == 1).alias("win")
    )
    shards = range(0, _STEPS + 1, _SHARD)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", kind="stable")
        p, win = part["p"].to_numpy(), part["win"].to_numpy(dtype=bool)
        key = np.floor(p * _STEPS)
        key = key + ((key + 1) / _STEPS <= p) - (key / _STEPS > p)
        keys, states = _curves(key, win, gain, loss)
        states = states[:, np.searchsorted(keys, np.arange(_STEPS + 1))]
        candidates = np.zeros(_STEPS + 1, dtype=bool)
        candidates[[round(round(x, 4) * _STEPS) for x in set(p.tolist())]] = True
        out = {"symbol": pd.Series([part["symbol"].iloc[0]] * len(shards), dtype=object), "block": [part["block"].iloc[0]] * len(shards), "shard": list(shards), "n": [len(p)] * len(shards), "hits": [int(win.sum())] * len(shards)}
        out["states"] = [states[:, a : a + _SHARD].ravel().tolist() for a in shards]
        out["candidates"] = [candidates[a : a + _SHARD].tolist() for a in shards]
        return pd.DataFrame(out)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", kind="stable")
        first = int(part["shard"].iloc[0])
        n, hits = int(part["n"].sum()), int(part["hits"].sum())
        k = np.arange(first, min(first + _SHARD, _STEPS + 1))
        state, candidates = np.zeros((5, len(k))), (k % 500 == 0) & (k > 0) & (k < _STEPS)
        for states, some in zip(part["states"], part["candidates"]):
            state = _after(state, np.reshape(states, (5, len(k))), gain, loss)
            candidates = candidates | np.asarray(some, dtype=bool)
        wins, losses, _, _, fall = state
        trades, total = wins + losses, wins * gain - losses * loss
        mean = total / n
        # Rows without a trade are the rest of the n rows.
        deviation = np.sqrt((wins * (gain - mean) ** 2 + losses * (loss + mean) ** 2 + (n - trades) * mean**2) / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            calmar = np.where(fall > 1e-12, total / fall, 0.0).round(9) + 0.0
            sharpe = np.where(deviation > 1e-12, mean / deviation * np.sqrt(n), 0.0).round(9) + 0.0
            f1 = np.where(wins > 0, 2 * wins / (trades + hits), 0.0).round(9)
        enough = candidates & (trades >= max(1, n // 20))
        best = [i for i in range(len(k)) if enough[i] or k[i] == _STEPS // 2]
        if not best:
            return pd.DataFrame()
        i = max(best, key=lambda i: (enough[i], calmar[i], sharpe[i], f1[i], -abs(k[i] - _STEPS // 2), -k[i]))
        return pd.DataFrame({"symbol": pd.Series([part["symbol"].iloc[0]], dtype=object), "enough": [bool(enough[i])], "k": [int(k[i])], "trades": [int(trades[i])], "calmar": [calmar[i]], "sharpe": [sharpe[i]], "f1": [f1[i]]})

    blocks = rows.groupBy("symbol", "block").applyInPandas(block, "symbol string, block long, shard int, n long, hits long, states array<double>, candidates array<boolean>")
    bests = blocks.groupBy("symbol", "shard").applyInPandas(fold, "symbol string, enough boolean, k int, trades long, calmar double, sharpe double, f1 double")
    order = F.struct("enough", "calmar", "sharpe", "f1", (-F.abs(F.col("k") - _STEPS // 2)).alias("_near"), (-F.col("k")).alias("_small"), "k", "trades")
    best = bests.groupBy("symbol").agg(F.max(order).alias("b"))
    return best.select("symbol", (F.col("b.k") / _STEPS).alias("threshold"), *(F.col(f"b.{c}").alias(c) for c in ("trades", "calmar", "sharpe", "f1")))


def decision_band(scored: DataFrame, threshold: float, break_even: float) -> DataFrame:
    """One row: rows at or above a threshold, their share, their hit rate and its distance from break-even."""
    band = F.when(F.col("p") >= threshold, 1)
    hits = F.coalesce(F.sum(band * F.col("y")) / F.nullif(F.sum(band), F.lit(0)), F.lit(0.0))
    return scored.agg(F.coalesce(F.sum(band), F.lit(0)).alias("rows"), F.coalesce(F.sum(band) / F.count(F.lit(1)), F.lit(0.0)).alias("share"), hits.alias("hit_rate"), (hits - break_even).alias("edge"))


def drawdown(rows: DataFrame, pnl: str) -> DataFrame:
    """Per symbol from rows (symbol, idx, pnl): total, mean, deviation, ratio per row, greatest fall of the sum."""
    run = prefix_sums(rows, "symbol", "idx", {"equity": F.col(pnl)}, _BLOCK).withColumn("_block", F.floor(F.col("idx") / _BLOCK))
    peaks = run.groupBy("symbol", "_block").agg(F.max("equity").alias("_p"))
    before = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    peaks = peaks.select("symbol", "_block", F.coalesce(F.max("_p").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy("symbol", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    top = F.greatest(F.lit(0.0), F.col("_before"), F.max("equity").over(inside))
    fallen = run.join(peaks, ["symbol", "_block"]).withColumn("_fall", top - F.col("equity"))
    s = fallen.groupBy("symbol").agg(F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.stddev_pop(pnl).alias("deviation"), F.max("_fall").alias("max_drawdown"))
    return s.withColumn("ratio", F.coalesce(F.when(F.col("deviation") > 1e-12, F.col("mean") / F.col("deviation")), F.lit(0.0)))


def rank_correlation(rows: DataFrame, features: list[str], target: str, least: int = 30) -> DataFrame:
    """symbol, feature, n, ic: Spearman's correlation of each feature with the target (0 below so many rows)."""
    names = [*features, target]
    kept = rows.where(F.col(target).isNotNull() & ~F.isnan(target))
    # Ranks read their rows several times: what made them is computed once.
    wide = checkpointed(kept.select("symbol", "idx", *(F.col(n).cast("double").alias(n) for n in names)))
    long = wide.unpivot(["symbol", "idx"], names, "name", "value").withColumn("key", F.concat_ws("/", "symbol", "name"))
    ranks = mean_ranks(long, "key", "value", "rank")
    per_row = ranks.groupBy("symbol", "idx").agg(*(F.max(F.when(F.col("name") == n, F.col("rank"))).alias(n) for n in names))
    # corr() refuses a column without variance.
    corr = lambda f: F.covar_pop(f, target) / F.nullif(F.stddev_pop(f) * F.stddev_pop(target), F.lit(0.0))
    s = per_row.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *(corr(f).alias(f"ic_{f}") for f in features))
    out = s.select("symbol", "n", *(F.col(f"ic_{f}").alias(f) for f in features)).unpivot(["symbol", "n"], features, "feature", "ic")
    return out.withColumn("ic", F.when((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"), F.col("ic")).otherwise(0.0))


def half_life(rows: DataFrame, value: str) -> DataFrame:
    """Per symbol: slope of the change on the demeaned level before, and the half-life in rows (inf if it grows)."""
    from quartzbar.operators.timeline import in_chunks

    means = rows.groupBy("symbol").agg(F.avg(value).alias("_m"))
    z = with_row_per_key(in_chunks(rows, before=1), means, "symbol").withColumn("z", F.col(value) - F.col("_m"))
    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    pairs = z.withColumn("prev", F.lag("z").over(w)).where("core AND prev IS NOT NULL")
    s = pairs.groupBy("symbol").agg(F.regr_slope(F.col("z") - F.col("prev"), F.col("prev")).alias("slope"))
    return s.select("symbol", "slope", F.when((F.col("slope") < 0) & (F.col("slope") > -1), -F.log(F.lit(2.0)) / F.log1p("slope")).otherwise(float("inf")).alias("half_life"))


def variance_filter(rows: DataFrame, features: list[str], drop_share: float = 0.2) -> DataFrame:
    """feature, variance, kept: the share of features with the least variance (ties by name) is dropped, one at least."""
    v = rows.agg(*(F.var_pop(f).alias(f) for f in features)).unpivot([], features, "feature", "variance")
    # As many rows as features.
    order = F.row_number().over(Window.orderBy("variance", "feature"))
    return v.withColumn("_k", order).select("feature", "variance", (F.col("_k") > max(1, int(len(features) * drop_share))).alias("kept"))


def bootstrap_interval(rows: DataFrame, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """n, mean, lower, upper (2.5 and 97.5 %) by a Poisson bootstrap.

    Every partition adds up its rows under draws sets of Poisson weights, so only draws sums leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, weights = np.zeros(draws + 1), np.zeros(draws + 1)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            x = x[np.isfinite(x)]
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                w = rng.poisson(1.0, (draws + 1, len(part)))
                w[0] = 1  # the rows themselves
                sums += w @ part
                weights += w.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(draws + 1), pa.int32()), pa.array(sums), pa.array(weights)], names=["draw", "s", "w"])

    parts = rows.select(F.col(value).cast("double").alias(value)).mapInArrow(run, "draw int, s double, w double")
    means = parts.groupBy("draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0").withColumn("mean", F.col("s") / F.col("w"))
    drawn = F.when(F.col("draw") > 0, F.col("mean"))
    return means.agg(
        F.max(F.when(F.col("draw") == 0, F.col("w"))).cast("long").alias("n"), F.max(F.when(F.col("draw") == 0, F.col("mean"))).alias("mean"),
        F.percentile(drawn, 0.025).alias("lower"), F.percentile(drawn, 0.975).alias("upper"),
    )
