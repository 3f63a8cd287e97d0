"""Queries on predictions, rank correlation, regimes, the backtest and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.windows import rounded
from quartzbar.operators import backtest, bar_features, labels, models, regimes, splits, statistics
from quartzbar.plans import feature_oracles
from quartzbar.plans.bars import CANONICAL_SQL, canonical
from quartzbar.plans.learning_data import _LABELS, HORIZON, SL, THRESHOLD, TP
from quartzbar.session import with_row_per_key

COST = 0.0008
BREAK_EVEN = (SL + COST) / (TP + SL)
_CLIPPED_RETURNS = "greatest(-0.2, least(0.2, {}))"
_P = f"1 / (1 + exp(-(60 * {_CLIPPED_RETURNS.format('return_5')} - 25 * {_CLIPPED_RETURNS.format('return_30')})))"
IC_FEATURES = ("return_5", "return_30", "return_60")
MODEL_FEATURES = ("return_1", "return_5", "return_30", "rolling_return_max_20")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """symbol, idx, p, y, target_return: a fixed logistic of returns as the prediction, the barrier label as truth."""
    base = canonical(spark, d)
    f = bar_features.with_features(base, "returns")
    y = labels.triple_barriers(base, HORIZON, TP, SL, THRESHOLD)
    return f.join(y, ["symbol", "idx"]).select("symbol", "idx", F.expr(_P).alias("p"), F.col("label").alias("y"), "target_return", *bar_features.family_columns("returns"))


def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.classification_metrics(scored(spark, d), 0.5)
    return s.selectExpr("symbol", "n", *rounded([c for c in s.columns if c not in ("symbol", "n")]))


def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    return statistics.reliability_curve(scored(spark, d)).selectExpr("bin", "n", *rounded(["mean_p", "observed"]))


def calibration_errors(spark: SparkSession, d: str) -> DataFrame:
    return statistics.calibration_errors(scored(spark, d)).selectExpr(*rounded(["ece", "ece_large_bins", "mce"]))


def decision_band(spark: SparkSession, d: str) -> DataFrame:
    return statistics.decision_band(scored(spark, d), 0.52, BREAK_EVEN).selectExpr("CAST(rows AS BIGINT) AS rows", *rounded(["share", "hit_rate", "edge"]))


def threshold_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.threshold_ranking(scored(spark, d).select("symbol", "idx", "p", "y"), TP - COST, SL + COST)
    return s.selectExpr("symbol", "threshold", "trades", *rounded(["calmar", "sharpe", "f1"]))


def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    pnl = F.when(F.col("p") >= 0.5, F.when(F.col("y") == 1, TP - COST).otherwise(-(SL + COST))).otherwise(0.0)
    s = statistics.drawdown(scored(spark, d).select("symbol", "idx", pnl.alias("pnl")), "pnl")
    return s.selectExpr("symbol", *rounded(["total", "mean", "deviation", "max_drawdown", "ratio"]))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return statistics.rank_correlation(scored(spark, d), list(IC_FEATURES), "target_return").selectExpr("symbol", "n", "feature", *rounded(["ic"]))


def half_life(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.half_life(canonical(spark, d).select("symbol", "idx", F.log("close").alias("x")), "x")
    return s.selectExpr("symbol", *rounded(["slope"]), "CASE WHEN half_life = double('Infinity') THEN NULL ELSE round(half_life, 3) END AS half_life")


def variance_filter(spark: SparkSession, d: str) -> DataFrame:
    names = list(bar_features.family_columns("returns"))
    s = bar_features.clip(bar_features.with_features(canonical(spark, d), "returns"), names)
    return statistics.variance_filter(s, names).selectExpr("feature", *rounded(["variance"], 8), "kept")


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return statistics.bootstrap_interval(scored(spark, d), "target_return")


def _regime_rows(spark: SparkSession, d: str) -> DataFrame:
    base = canonical(spark, d)
    rows = bar_features.with_features(base, "volatility", "trend").selectExpr("symbol", "idx", "round(rv_15, 8) AS rv_15", "round(trend_slope_30, 8) AS trend_slope_30")
    return rows


def regime_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return regimes.fit_thresholds(_regime_rows(spark, d)).selectExpr("symbol", *rounded(["rv", "trend", "direction"], 7))


def market_regimes(spark: SparkSession, d: str) -> DataFrame:
    return regimes.with_regimes(_regime_rows(spark, d))


def regime_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return regimes.diagnostics(regimes.with_regimes(_regime_rows(spark, d)), "strength")


def regime_transition_weights(spark: SparkSession, d: str) -> DataFrame:
    """A lower weight within a day of a change of the direction regime."""
    return splits.transition_weights(regimes.with_regimes(_regime_rows(spark, d)).select("symbol", "idx", "direction"), "direction", 1440)


def regime_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Direction regime against the sign of the next hour's return: all nine cells."""
    r = regimes.with_regimes(_regime_rows(spark, d))
    y = labels.triple_barriers(canonical(spark, d), HORIZON, TP, SL, THRESHOLD).select("symbol", "idx", "target_return")
    truth = F.when(F.col("target_return") > THRESHOLD, "up").when(F.col("target_return") < -THRESHOLD, "down").otherwise("range")
    n = r.join(y, ["symbol", "idx"]).groupBy(F.col("direction").alias("predicted"), truth.alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(a, b) for a in regimes.DIRECTIONS for b in regimes.DIRECTIONS], "predicted string, actual string")
    return every.join(n, ["predicted", "actual"], "left").select("predicted", "actual", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed probabilities with the regime assigned by confidence and persistence."""
    rows = bar_features.with_features(canonical(spark, d), "returns").selectExpr(
        "symbol", "idx", f"round({_P}, 9) AS up", f"round(0.9 - {_P}, 9) AS down", "CAST(0.1 AS DOUBLE) AS range"
    )
    s = regimes.assigned(rows, ["down", "range", "up"], "range")
    return s.selectExpr("symbol", "idx", *rounded(["up_smooth", "range_smooth", "down_smooth"]), "assigned")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    base = canonical(spark, d)
    p = bar_features.with_features(base, "returns").select("symbol", "idx", F.expr(f"round({_P}, 9)").alias("p"))
    signal = F.when(F.col("gap_flag") == 1, 0).when(F.col("p") > 0.54, 1).when(F.col("p") < 0.46, -1).otherwise(0)
    return base.join(p, ["symbol", "idx"]).select("symbol", "idx", "open", "high", "low", "close", signal.alias("signal"))


def backtest_trades(spark: SparkSession, d: str) -> DataFrame:
    t = backtest.backtest(_signals(spark, d))
    return t.selectExpr("symbol", "entry_idx", "exit_idx", "side", "reason", *rounded(["gross", "net"], 8))


def backtest_breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = backtest.breakdown(backtest.backtest(_signals(spark, d)))
    return b.selectExpr("symbol", "side", "reason", "trades", *rounded(["win_rate", "profit_factor", "compounded", "mean_net"]))


def centroid_model(spark: SparkSession, d: str) -> DataFrame:
    """The centroid classifier's mean prediction and hits by symbol."""
    rows = scored(spark, d)
    model = models.fit_centroids(rows, list(MODEL_FEATURES), "y")
    p = rows.withColumn("q", models.centroid_probability(model))
    return p.groupBy("symbol").agg(F.avg("q").alias("mean_q"), F.avg((F.col("q") - F.col("y")) * (F.col("q") - F.col("y"))).alias("brier")).selectExpr("symbol", *rounded(["mean_q", "brier"], 5))


def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("symbol", "p", "y")
    slope, intercept = models.fit_platt(rows, "p", "y")
    q = rows.withColumn("q", models.platt_probability("p", slope, intercept)).withColumn("blend", models.weighted_average({"p": 1.0, "q": 3.0}))
    return q.groupBy("symbol").agg(*(F.avg((F.col(x) - F.col("y")) * (F.col(x) - F.col("y"))).alias(f"brier_{x}") for x in ("p", "q", "blend")))


def rolling_drift(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of the last 240 rows of a symbol against that of all before."""
    rows = scored(spark, d)
    n = rows.groupBy("symbol").agg((F.max("idx") - 240).alias("cut"))
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    s = with_row_per_key(rows, n, "symbol").groupBy("symbol").agg(F.avg(F.when(F.col("idx") > F.col("cut"), e)).alias("recent"), F.avg(F.when(F.col("idx") <= F.col("cut"), e)).alias("baseline"))
    return s.selectExpr("symbol", *rounded(["recent", "baseline"]))


QUERIES = {
    f.__name__: f
    for f in (
        classification_metrics, reliability_curve, calibration_errors, decision_band, threshold_ranking, equity_drawdown, rank_correlation,
        half_life, variance_filter, bootstrap_interval, regime_thresholds, market_regimes, regime_diagnostics, regime_confusion,
        regime_transition_weights, smoothed_regimes, backtest_trades, backtest_breakdown, centroid_model, platt_calibration, rolling_drift,
    )
}

_RETURNS = feature_oracles.sql(CANONICAL_SQL, "returns", digits=15, clipped=False)
_SCORED = f"SELECT f.*, {_P} AS p, l.label AS y, l.ret AS target_return FROM ({_RETURNS}) AS f JOIN (SELECT symbol, idx, label, ret FROM ({_LABELS.replace('FROM f' + chr(10), ', ret FROM f' + chr(10))})) AS l USING (symbol, idx)"


def _with_scored(body: str) -> str:
    return f"WITH scored AS MATERIALIZED ({_SCORED}) {body}"


def _one(e: str, name: str, digits: int = 6) -> str:
    return rounded([name], digits, of=lambda _: f"CAST({e} AS DOUBLE)")[0]


_REGIME_ROWS = f"""
WITH a AS ({feature_oracles.sql(CANONICAL_SQL, "volatility", "trend", digits=15, clipped=False)})
SELECT symbol, idx, round(rv_15, 8) AS rv_15, round(trend_slope_30, 8) AS trend_slope_30 FROM a
"""
_THRESHOLDS = """
SELECT symbol, quantile_cont(rv_15, 0.75) AS rv, greatest(1e-5, quantile_cont(abs(trend_slope_30), 0.9)) AS trend, greatest(1e-5, quantile_cont(abs(trend_slope_30), 0.55)) AS direction
FROM r GROUP BY symbol
"""


def _stable(code: str, name: str) -> str:
    """Hysteresis as a recursive step: stable code, candidate, count."""
    return f"""
{name} AS (
  SELECT symbol, idx, {code} AS stable, NULL::INTEGER AS cand, 0 AS cnt FROM coded WHERE idx = 0
  UNION ALL
  SELECT c.symbol, c.idx,
    CASE WHEN c.{code} <> s.stable AND CASE WHEN c.{code} = s.cand THEN s.cnt + 1 ELSE 1 END >= 3 THEN c.{code} ELSE s.stable END,
    CASE WHEN c.{code} = s.stable OR CASE WHEN c.{code} = s.cand THEN s.cnt + 1 ELSE 1 END >= 3 THEN NULL ELSE c.{code} END,
    CASE WHEN c.{code} = s.stable OR CASE WHEN c.{code} = s.cand THEN s.cnt + 1 ELSE 1 END >= 3 THEN 0 WHEN c.{code} = s.cand THEN s.cnt + 1 ELSE 1 END
  FROM {name} AS s JOIN coded AS c ON c.symbol = s.symbol AND c.idx = s.idx + 1
)"""


_REGIMES = f"""
WITH RECURSIVE r AS MATERIALIZED ({_REGIME_ROWS}), t AS ({_THRESHOLDS}),
coded AS MATERIALIZED (
  SELECT symbol, idx, CASE WHEN rv_15 > rv THEN 2 WHEN abs(trend_slope_30) > trend THEN 1 ELSE 0 END AS s,
         CASE WHEN trend_slope_30 > direction THEN 1 WHEN trend_slope_30 < -direction THEN 2 ELSE 0 END AS d
  FROM r JOIN t USING (symbol)
), {_stable("s", "hs")}, {_stable("d", "hd")}
SELECT hs.symbol, hs.idx, ['ranging', 'trending', 'high_volatility'][hs.stable + 1] AS strength, ['range', 'up', 'down'][hd.stable + 1] AS direction
FROM hs JOIN hd USING (symbol, idx)
"""
_TRADES = f"""
WITH RECURSIVE c AS MATERIALIZED ({CANONICAL_SQL}), f AS MATERIALIZED ({_RETURNS}),
sig AS MATERIALIZED (
  SELECT c.symbol, c.idx, c.close, CASE WHEN gap_flag = 1 THEN 0 WHEN round({_P}, 9) > 0.54 THEN 1 WHEN round({_P}, 9) < 0.46 THEN -1 ELSE 0 END AS side
  FROM c JOIN f USING (symbol, idx)
),
last AS (SELECT symbol, max(idx) AS n FROM c GROUP BY symbol),
hit AS (
  SELECT a.symbol, a.idx, a.close, a.side, arg_min({{'k': b.idx, 'u': b.high >= a.close * (1 + CASE WHEN a.side > 0 THEN 0.004 ELSE 0.002 END), 'd': b.low <= a.close * (1 - CASE WHEN a.side > 0 THEN 0.002 ELSE 0.004 END),
         'rise': b.close > b.open, 'fall': b.close < b.open}}, b.idx)
         FILTER (b.high >= a.close * (1 + CASE WHEN a.side > 0 THEN 0.004 ELSE 0.002 END) OR b.low <= a.close * (1 - CASE WHEN a.side > 0 THEN 0.002 ELSE 0.004 END)) AS x
  FROM sig AS a LEFT JOIN c AS b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + 30 WHERE a.side <> 0 GROUP BY a.symbol, a.idx, a.close, a.side
),
o AS (
  SELECT h.*, least(h.idx + 30, n) AS late, n, CASE WHEN x.u AND x.d THEN CASE WHEN side > 0 THEN x.rise ELSE NOT x.fall END ELSE x.u END AS takes_up FROM hit AS h JOIN last USING (symbol)
),
done AS MATERIALIZED (
  SELECT o.symbol, o.idx AS entry_idx, o.side, CASE WHEN x IS NULL THEN late ELSE x.k END AS exit_idx,
    CASE WHEN x IS NULL THEN CASE WHEN o.idx + 30 <= n THEN 'horizon' ELSE 'end' END WHEN takes_up = (side > 0) THEN 'take_profit' ELSE 'stop_loss' END AS reason,
    side * (CASE WHEN x IS NULL THEN e.close WHEN takes_up THEN o.close * (1 + CASE WHEN side > 0 THEN 0.004 ELSE 0.002 END) ELSE o.close * (1 - CASE WHEN side > 0 THEN 0.002 ELSE 0.004 END) END / o.close - 1) AS gross
  FROM o JOIN c AS e ON e.symbol = o.symbol AND e.idx = o.late
),
walk AS (
  SELECT symbol, min(entry_idx) AS entry_idx FROM done GROUP BY symbol
  UNION ALL
  SELECT w.symbol, min(nx.entry_idx) FROM walk AS w JOIN done AS t ON t.symbol = w.symbol AND t.entry_idx = w.entry_idx
    JOIN done AS nx ON nx.symbol = w.symbol AND nx.entry_idx >= t.exit_idx + 3 GROUP BY w.symbol
),
trades AS (SELECT d.*, gross - {COST} AS net FROM walk JOIN done AS d USING (symbol, entry_idx))
"""
SQL = {
    "classification_metrics": _with_scored(f"""
, h AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS hit, least(greatest(p, 1e-15), 1 - 1e-15) AS s FROM scored),
g AS (SELECT symbol, count(*) AS n, sum(hit * y) AS tp, sum(hit * (1 - y)) AS fp, sum((1 - hit) * y) AS fn, sum((1 - hit) * (1 - y)) AS tn, avg((p - y) * (p - y)) AS b, avg(y) AS base,
      avg(-(y * ln(s) + (1 - y) * ln(1 - s))) AS ll FROM h GROUP BY symbol),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM g)
SELECT symbol, n, {_one("(tp + tn) / n", "accuracy")}, {_one("pr", "precision")}, {_one("re", "recall")}, {_one("coalesce(2 * pr * re / nullif(pr + re, 0), 0)", "f1")}, {_one("b", "brier")},
       {_one("coalesce(1 - b / nullif(base * (1 - base), 0), 0)", "brier_skill")}, {_one("ll", "log_loss")} FROM q
""").replace(") \n,", "),"),
    "reliability_curve": _with_scored(f"""
SELECT CAST(k AS INTEGER) AS bin, count(p) AS n, {_one("avg(p)", "mean_p")}, {_one("avg(y)", "observed")}
FROM range(10) AS b(k) LEFT JOIN scored ON least(CAST(floor(p * 10) AS INTEGER), 9) = k GROUP BY k
"""),
    "calibration_errors": _with_scored(f"""
, g AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY ALL)
SELECT {_one("sum(n * gap) / sum(n)", "ece")}, {_one("sum(n * gap) FILTER (n >= 20) / sum(n) FILTER (n >= 20)", "ece_large_bins")}, {_one("max(gap)", "mce")} FROM g
""").replace(") \n,", "),"),
    "decision_band": _with_scored(f"""
SELECT count(*) FILTER (p >= 0.52) AS rows, {_one("count(*) FILTER (p >= 0.52) / count(*)", "share")}, {_one("coalesce(avg(y) FILTER (p >= 0.52), 0)", "hit_rate")},
       {_one(f"coalesce(avg(y) FILTER (p >= 0.52), 0) - {BREAK_EVEN!r}", "edge")} FROM scored
"""),
    "equity_drawdown": _with_scored(f"""
, w AS (SELECT symbol, idx, CASE WHEN p >= 0.5 THEN CASE WHEN y = 1 THEN {TP - COST!r} ELSE -{SL + COST!r} END ELSE 0 END AS pnl FROM scored),
e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY idx) AS eq FROM w),
d AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY symbol ORDER BY idx)) - eq AS fall FROM e)
SELECT symbol, {_one("sum(pnl)", "total")}, {_one("avg(pnl)", "mean")}, {_one("stddev_pop(pnl)", "deviation")}, {_one("max(fall)", "max_drawdown")},
       {_one("CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END", "ratio")} FROM d GROUP BY symbol
""").replace(") \n,", "),"),
    "rank_correlation": _with_scored(", r AS (SELECT symbol, " + ", ".join(
        f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2 AS r_{x}" for x in (*IC_FEATURES, "target_return")
    ) + " FROM scored), " + "u AS (" + " UNION ALL ".join(f"SELECT symbol, count(*) AS n, '{x}' AS feature, corr(r_{x}, r_target_return) AS ic FROM r GROUP BY symbol" for x in IC_FEATURES)
    + f") SELECT symbol, n, feature, {_one('CASE WHEN n >= 30 AND isfinite(ic) THEN ic ELSE 0 END', 'ic')} FROM u").replace(") , r AS", "), r AS"),
    "half_life": f"""
WITH c AS (SELECT symbol, idx, ln(close) - avg(ln(close)) OVER (PARTITION BY symbol) AS z FROM ({CANONICAL_SQL})),
p AS (SELECT symbol, z, lag(z) OVER (PARTITION BY symbol ORDER BY idx) AS prev FROM c),
s AS (SELECT symbol, regr_slope(z - prev, prev) AS slope FROM p WHERE prev IS NOT NULL GROUP BY symbol)
SELECT symbol, {_one("slope", "slope")}, CASE WHEN slope < 0 AND slope > -1 THEN round(-ln(2) / ln(1 + slope), 3) END AS half_life FROM s
""",
    "variance_filter": (lambda names: f"""
WITH f AS ({feature_oracles.sql(CANONICAL_SQL, "returns", digits=15)}),
v AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, var_pop({n}) AS variance FROM f" for n in names)})
SELECT feature, {_one("variance", "variance", 8)}, row_number() OVER (ORDER BY round(variance, 14), feature) > {max(1, int(len(names) * 0.2))} AS kept FROM v
""")(bar_features.family_columns("returns")),
    "regime_thresholds": f"WITH r AS ({_REGIME_ROWS}), t AS ({_THRESHOLDS}) SELECT symbol, {_one('rv', 'rv', 7)}, {_one('trend', 'trend', 7)}, {_one('direction', 'direction', 7)} FROM t",
    "market_regimes": _REGIMES,
    "regime_diagnostics": f"""
WITH r AS ({_REGIMES}), g AS (SELECT *, idx - row_number() OVER (PARTITION BY symbol, strength ORDER BY idx) AS k FROM r), n AS (SELECT symbol, strength, k, count(*) AS n FROM g GROUP BY ALL)
SELECT symbol, strength, CAST(sum(n) AS BIGINT) AS rows, count(*) AS entries, max(n) AS longest_run FROM n GROUP BY ALL
""",
    "regime_confusion": f"""
WITH r AS ({_REGIMES}), l AS ({_LABELS.replace('FROM f' + chr(10), ', ret FROM f' + chr(10))}), e AS (SELECT * FROM (VALUES ('range'), ('up'), ('down')) AS a(predicted), (VALUES ('range'), ('up'), ('down')) AS b(actual)),
j AS (SELECT r.direction AS predicted, CASE WHEN ret > {THRESHOLD} THEN 'up' WHEN ret < -{THRESHOLD} THEN 'down' ELSE 'range' END AS actual FROM r JOIN l ON l.symbol = r.symbol AND l.idx = r.idx)
SELECT e.predicted, e.actual, count(j.predicted) AS n FROM e LEFT JOIN j ON j.predicted = e.predicted AND j.actual = e.actual GROUP BY ALL
""",
    "backtest_trades": _TRADES + f"SELECT symbol, entry_idx, exit_idx, side, reason, {_one('gross', 'gross', 8)}, {_one('net', 'net', 8)} FROM trades",
    "backtest_breakdown": _TRADES + f"""
SELECT coalesce(symbol, 'all') AS symbol, coalesce(CAST(side AS VARCHAR), 'all') AS side, coalesce(reason, 'all') AS reason, count(*) AS trades,
       {_one("avg(CASE WHEN net > 0 THEN 1 ELSE 0 END)", "win_rate")}, {_one("coalesce(sum(net) FILTER (net > 0) / nullif(sum(-net) FILTER (net <= 0), 0), 0)", "profit_factor")},
       {_one("exp(sum(ln(1 + net))) - 1", "compounded")}, {_one("avg(net)", "mean_net")}
FROM trades GROUP BY GROUPING SETS ((symbol), (side), (reason), (side, reason), ())
""",
    "centroid_model": _with_scored(", m AS (SELECT " + ", ".join(
        f"avg({x}) FILTER (y = 1) AS a_{x}, avg({x}) FILTER (y = 0) AS b_{x}, stddev_pop({x}) AS s_{x}" for x in MODEL_FEATURES
    ) + " FROM scored), q AS (SELECT symbol, y, 1 / (1 + exp(-greatest(-60, least(60, " + " + ".join(
        f"CASE WHEN s_{x} > 1e-9 * greatest(1, abs(a_{x}), abs(b_{x})) THEN (a_{x} - b_{x}) / (s_{x} * s_{x}) * ({x} - (a_{x} + b_{x}) / 2) ELSE 0 END" for x in MODEL_FEATURES
    ) + f")))) AS q FROM scored, m) SELECT symbol, {_one('avg(q)', 'mean_q', 5)}, {_one('avg((q - y) * (q - y))', 'brier', 5)} FROM q GROUP BY symbol").replace(") , m AS", "), m AS"),
    "rolling_drift": _with_scored(f"""
, n AS (SELECT symbol, max(idx) - 240 AS cut FROM scored GROUP BY symbol)
SELECT symbol, {_one("avg((p - y) * (p - y)) FILTER (idx > cut)", "recent")}, {_one("avg((p - y) * (p - y)) FILTER (idx <= cut)", "baseline")} FROM scored JOIN n USING (symbol) GROUP BY symbol
""").replace(") \n,", "),"),
}
SQL["regime_transition_weights"] = f"""
WITH r AS ({_REGIMES}), h AS (SELECT symbol, idx, direction, CASE WHEN lag(direction) OVER (PARTITION BY symbol ORDER BY idx) <> direction THEN 1 ELSE 0 END AS ch FROM r)
SELECT symbol, idx, direction, CASE WHEN max(ch) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1440 PRECEDING AND 1440 FOLLOWING) = 1 THEN CAST(0.1 AS DOUBLE) ELSE 1 END AS weight FROM h
"""
# Persistence as a recursive step: current, pending, count.
SQL["smoothed_regimes"] = f"""
WITH RECURSIVE f AS ({_RETURNS}), p AS (SELECT symbol, idx, round({_P}, 9) AS up, round(0.9 - {_P}, 9) AS down FROM f),
s AS MATERIALIZED (SELECT symbol, idx, avg(up) OVER w AS u, avg(down) OVER w AS d FROM p WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
c AS MATERIALIZED (SELECT symbol, idx, u, d, CASE WHEN d >= greatest(0.1, u) THEN 'down' WHEN 0.1 >= u THEN 'range' ELSE 'up' END AS best, greatest(u, d, 0.1) >= 0.45 AS sure FROM s),
r AS (
  SELECT symbol, idx, CASE WHEN sure THEN best ELSE 'range' END AS now, NULL::VARCHAR AS next, 0 AS n FROM c WHERE idx = 0
  UNION ALL
  SELECT c.symbol, c.idx, CASE WHEN c.sure AND c.best <> r.now AND CASE WHEN c.best = r.next THEN r.n + 1 ELSE 1 END >= 60 THEN c.best ELSE r.now END,
    CASE WHEN NOT c.sure OR c.best = r.now OR CASE WHEN c.best = r.next THEN r.n + 1 ELSE 1 END >= 60 THEN NULL ELSE c.best END,
    CASE WHEN NOT c.sure OR c.best = r.now OR CASE WHEN c.best = r.next THEN r.n + 1 ELSE 1 END >= 60 THEN 0 WHEN c.best = r.next THEN r.n + 1 ELSE 1 END
  FROM r JOIN c ON c.symbol = r.symbol AND c.idx = r.idx + 1
)
SELECT symbol, idx, {_one("u", "up_smooth")}, {_one("0.1", "range_smooth")}, {_one("d", "down_smooth")}, now AS assigned FROM r JOIN c USING (symbol, idx)
"""
SQL["threshold_ranking"] = _with_scored(f"""
, n AS (SELECT symbol, count(*) AS n, sum(y) AS hits FROM scored GROUP BY symbol),
k AS (SELECT symbol, CAST(round(round(p, 4) * 10000) AS INTEGER) AS k FROM scored UNION SELECT symbol, CAST(500 * i AS INTEGER) FROM n, range(1, 20) AS r(i)),
e AS (SELECT k.symbol, k.k, s.idx, CASE WHEN p < k.k / 10000 THEN 0 WHEN y = 1 THEN {TP - COST!r} ELSE -{SL + COST!r} END AS pnl, p >= k.k / 10000 AS taken, y FROM k JOIN scored AS s ON s.symbol = k.symbol),
c AS (SELECT *, sum(pnl) OVER w AS run FROM e WINDOW w AS (PARTITION BY symbol, k ORDER BY idx)),
g AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY symbol, k ORDER BY idx)) - run AS fall FROM c),
m AS (SELECT symbol, k, count(*) FILTER (taken) AS trades, count(*) FILTER (taken AND y = 1) AS wins, sum(pnl) AS total, max(fall) AS fall, avg(pnl) AS mean, stddev_pop(pnl) AS sd FROM g GROUP BY ALL),
t AS (
  SELECT m.symbol, k, trades, CASE WHEN fall > 1e-12 THEN round(total / fall, 9) ELSE 0 END AS calmar, CASE WHEN sd > 1e-12 THEN round(mean / sd * sqrt(n), 9) ELSE 0 END AS sharpe,
         CASE WHEN wins > 0 THEN round(2 * wins / (trades + hits), 9) ELSE 0 END AS f1, trades >= greatest(1, n // 20) AS enough
  FROM m JOIN n ON n.symbol = m.symbol
), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY enough DESC, calmar DESC, sharpe DESC, f1 DESC, abs(k - 5000), k) AS place FROM t WHERE enough OR k = 5000)
SELECT symbol, k / 10000 AS threshold, trades, {_one("calmar", "calmar")}, {_one("sharpe", "sharpe")}, {_one("f1", "f1")} FROM b WHERE place = 1
""").replace(") \n,", "),")
