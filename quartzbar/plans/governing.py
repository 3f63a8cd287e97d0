"""Queries on rule regimes, gap policy, causes of missing values, importance, folds, funding of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.keys import entity_key, epoch_us
from quartzbar.functions.windows import rounded
from quartzbar.operators import backtest, bar_features, models, quality, rule_regimes, timeframes, timeline
from quartzbar.plans import bars, feature_oracles
from quartzbar.plans.bars import CANONICAL_SQL, canonical
from quartzbar.plans.evaluation import _TRADES, MODEL_FEATURES, _one, _signals, _with_scored, scored
from quartzbar.session import table

_TF = ("trend_slope_15m", "trend_slope_1h", "trend_slope_4h", "return_4h", "ema_gap_4h", "trend_slope_24h", "atr_pct_1h", "atr_pct_4h", "bb_width_1h", "adx_1h", "adx_4h")


def rule_regime_rows(spark: SparkSession, d: str) -> DataFrame:
    base = canonical(spark, d)
    one = bar_features.with_features(base, "returns", "trend").select("symbol", "idx", "return_5", "trend_slope_30")
    frames = timeframes.all_onto_minutes(base, timeline.spans(table(spark, d, "bars")))
    names = [*_TF, *rule_regimes.FLAGS]
    rows = one.join(frames, ["symbol", "idx"])
    return rows.selectExpr("symbol", "idx", *(f"round(CAST({n} AS DOUBLE), 9) AS {n}" for n in ("return_5", "trend_slope_30", *names)))


def rule_regimes_by_row(spark: SparkSession, d: str) -> DataFrame:
    return rule_regimes.with_rule_regimes(rule_regime_rows(spark, d))


def gap_policy(spark: SparkSession, d: str) -> DataFrame:
    """Minutes by group of features, live or not, and action."""
    ratio = bar_features.with_features(canonical(spark, d), "gaps").selectExpr("symbol", "idx", "round(gap_ratio_60, 9) AS r")
    rows = ratio.join(bars.max_gap_run(spark, d).select("symbol", "idx", F.col("max_gap_run_120").alias("run")), ["symbol", "idx"])
    ways = [(g, live) for g in quality.GAP_LIMITS for live in (False, True)]
    options = F.array(*(F.struct(F.lit(g).alias("feature_group"), F.lit(v).alias("live"), quality.gap_action(g, F.col("r"), F.col("run"), v).alias("action")) for g, v in ways))
    return rows.select(F.explode(options).alias("o")).groupBy("o.feature_group", "o.live", "o.action").agg(F.count(F.lit(1)).alias("n"))


_WARM_UP = {"return_60": 60, "rv_120": 120, "close_zscore_20": 19}


def missing_causes(spark: SparkSession, d: str) -> DataFrame:
    """Minutes by feature and the cause a missing value would have."""
    cases = F.array(*(F.struct(F.lit(f).alias("feature"), quality.missing_cause(F.col("gap_flag") == 1, F.col("idx") < n, F.lit(f == "rv_120")).alias("cause")) for f, n in _WARM_UP.items()))
    return canonical(spark, d).select(F.explode(cases).alias("c")).groupBy("c.feature", "c.cause").agg(F.count(F.lit(1)).alias("n"))


def _model(rows: DataFrame):
    fitted = models.fit_centroids(rows, list(MODEL_FEATURES), "y")

    def probability(columns: dict):
        return models.centroid_probability(fitted, columns)

    return probability


def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate of the centroid model, and with one feature's values in reverse order of a symbol's rows."""
    rows = scored(spark, d).select("symbol", F.col("idx").alias("start"), "y", *MODEL_FEATURES)
    turned = quality.reversed_columns(rows, list(MODEL_FEATURES))
    got = quality.accuracy_changes(turned, _model(rows), list(MODEL_FEATURES), "y", {f: F.col(f"rev_{f}") for f in MODEL_FEATURES})
    return got.selectExpr("feature", *rounded(["baseline", "changed"], 4))


def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate of the centroid model, and with one feature at its mean."""
    rows = scored(spark, d).select("symbol", "y", *MODEL_FEATURES)
    means = rows.agg(*(F.avg(f).alias(f) for f in MODEL_FEATURES)).first()
    got = quality.accuracy_changes(rows, _model(rows), list(MODEL_FEATURES), "y", {f: F.lit(means[f]) for f in MODEL_FEATURES})
    return got.selectExpr("feature", *rounded(["baseline", "changed"], 4))


def correlated_features(spark: SparkSession, d: str) -> DataFrame:
    names = bar_features.family_columns("returns")
    return quality.correlated_features(bar_features.with_features(canonical(spark, d), "returns"), names)


def regime_folds(spark: SparkSession, d: str) -> DataFrame:
    counts = canonical(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return quality.walk_forward_folds(counts, 5, 60)


def funding_of_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the funding of the events while they were open."""
    t = backtest.backtest(_signals(spark, d)).select("symbol", "entry_idx", "exit_idx", "side")
    lo = canonical(spark, d).where("idx = 0").select("symbol", F.col("m").alias("lo"))
    f = table(spark, d, "funding_rates").where("next_funding_time <> 0 AND current_rate IS NOT NULL").select(
        entity_key(F.col("symbol")).alias("symbol"), F.floor(epoch_us(F.col("next_funding_time")) / 60_000_000).alias("m"), F.col("current_rate").alias("rate")
    )
    events = f.join(lo, "symbol").select("symbol", (F.col("m") - F.col("lo")).alias("at"), "rate")
    return quality.paid_in(t, events).selectExpr("symbol", "entry_idx", "exit_idx", "side", *rounded(["paid"], 9))


QUERIES = {
    f.__name__: f
    for f in (rule_regimes_by_row, gap_policy, missing_causes, permutation_importance, feature_ablation, correlated_features, regime_folds, funding_of_trades)
}


def _centroid_sql(columns: dict[str, str]) -> str:
    z = " + ".join(
        f"CASE WHEN s_{x} > 1e-9 * greatest(1, abs(a_{x}), abs(b_{x})) THEN (a_{x} - b_{x}) / (s_{x} * s_{x}) * ({columns[x]} - (a_{x} + b_{x}) / 2) ELSE 0 END" for x in MODEL_FEATURES
    )
    return f"avg(CASE WHEN (CASE WHEN 1 / (1 + exp(-greatest(-60, least(60, {z})))) >= 0.5 THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END)"


_FIT = "m AS (SELECT " + ", ".join(f"avg({x}) FILTER (y = 1) AS a_{x}, avg({x}) FILTER (y = 0) AS b_{x}, stddev_pop({x}) AS s_{x}, avg({x}) AS u_{x}" for x in MODEL_FEATURES) + " FROM scored)"


def _changes_sql(body: str, other: str) -> str:
    base = {x: x for x in MODEL_FEATURES}
    parts = " UNION ALL ".join(f"SELECT '{x}' AS feature, {_one(_centroid_sql(base), 'baseline', 4)}, {_one(_centroid_sql(base | {x: other.format(x)}), 'changed', 4)} FROM k, m" for x in MODEL_FEATURES)
    return _with_scored(f", {_FIT}, k AS MATERIALIZED ({body}) {parts}").replace(") , m AS", "), m AS")


_NORM = "regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g')"
_GAP_CASES = " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, {'true' if live else 'false'} AS live, "
    + ("'keep_as_state'" if g == "safety_features" else "CASE WHEN run >= 3 OR r >= 0.2 THEN 'block_new_entries' WHEN r >= 0.1 THEN 'warn' ELSE 'allow' END" if live else f"CASE WHEN run >= 3 OR r >= {limit} THEN 'drop_sample' ELSE 'allow' END")
    + " AS action FROM x"
    for g, limit in quality.GAP_LIMITS.items() for live in (False, True)
)
_RETURN_NAMES = bar_features.family_columns("returns")
_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS a, {j} AS b, abs(corr(r_{x}, r_{y})) AS rho FROM r" for i, x in enumerate(_RETURN_NAMES) for j, y in enumerate(_RETURN_NAMES) if i < j
)
_RULE_SCORES = {
    "trend": (1.0, {"trend_slope_1h": 0.25, "trend_slope_4h": 0.30, "return_4h": 0.15, "ema_gap_4h": 0.15, "trend_slope_24h": 0.15}),
    "fast": (1.0, {"return_5": 0.20, "trend_slope_15m": 0.35, "trend_slope_30": 0.45}),
    "vol": (1.0, {"atr_pct_1h": 0.40, "atr_pct_4h": 0.30, "bb_width_1h": 0.30}),
    "quiet": (1.0, {"adx_1h": 0.35, "adx_4h": 0.20, "bb_width_1h": 0.30}),
}
_RULE_FEATURES = sorted({f for _, w in _RULE_SCORES.values() for f in w})


def _rule_sql(confirm: int, reversal: bool) -> str:
    """The rule detector as a recursive step per row: regime, rows held, pending regime, its count."""
    frames = " JOIN ".join(
        f"({feature_oracles.frame_sql(CANONICAL_SQL, minutes, tf, 12)}) AS f{tf}" + ("" if i == 0 else " USING (symbol, idx)") for i, (tf, minutes) in enumerate(timeframes.FRAMES.items())
    )
    total = lambda name: " + ".join(f"{w} * z_{f}" for f, w in _RULE_SCORES[name][1].items())
    turn_up, turn_down = ("WHEN trend > 0.7 AND vol > 0.2 THEN 1", "WHEN trend < -0.7 AND vol > 0.2 THEN 2") if reversal else ("", "")
    new = "CASE s.regime WHEN 0 THEN c.p0 WHEN 1 THEN c.p1 ELSE c.p2 END"
    count = f"CASE WHEN {new} = s.pending THEN s.cnt + 1 ELSE 1 END"
    go = f"({new} <> s.regime AND (c.breaks > 0 OR (s.held >= 60 AND {count} >= {confirm})))"
    return f"""
WITH RECURSIVE one AS ({feature_oracles.sql(CANONICAL_SQL, "returns", "trend", digits=12, clipped=False)}), tf AS (SELECT * FROM {frames}),
x AS MATERIALIZED (
  SELECT one.symbol, one.idx, round(one.return_5, 9) AS return_5, round(one.trend_slope_30, 9) AS trend_slope_30,
    {", ".join(f"round(tf.{f}, 9) AS {f}" for f in [*(f for f in _RULE_FEATURES if f not in ("return_5", "trend_slope_30")), *rule_regimes.FLAGS])}
  FROM one JOIN tf ON tf.symbol = one.symbol AND tf.idx = one.idx
), fit AS (SELECT symbol, {", ".join(f"avg({f}) AS m_{f}, greatest(stddev_pop({f}), 1e-9) AS s_{f}" for f in _RULE_FEATURES)} FROM x GROUP BY symbol),
z AS (SELECT x.*, {", ".join(f"({f} - m_{f}) / s_{f} AS z_{f}" for f in _RULE_FEATURES)}, abs(distance_from_24h_low) AS lo, abs(drawdown_from_24h_high) AS hi FROM x JOIN fit USING (symbol)),
sc AS (
  SELECT symbol, idx, round({total("trend")}, 9) AS trend, round(({total("fast")}) / 1.0, 9) AS fast, round({total("vol")}, 9) AS vol,
    round(0.15 * CASE WHEN lo + hi > 0 THEN 1 - 2 * abs(lo / (lo + hi) - 0.5) ELSE 0 END - ({total("quiet")}), 9) AS calm,
    CASE WHEN volume_z_1h > 1.5 AND rolling_high_breakout_24h = 1 THEN 1 WHEN volume_z_1h > 1.5 AND rolling_low_breakdown_24h = 1 THEN 2 ELSE 0 END AS breaks
  FROM z
), pr AS (
  SELECT *, CASE WHEN trend > 0.7 AND vol > 0.2 AND fast > -0.6 THEN 1 WHEN trend < -0.7 AND vol > 0.2 AND fast < 0.6 THEN 2 ELSE 0 END AS leave FROM sc
), c AS MATERIALIZED (
  SELECT symbol, idx, breaks, CASE WHEN breaks > 0 THEN breaks WHEN calm > 0.65 AND abs(trend) < 0.45 THEN 0 ELSE leave END AS first, CASE WHEN breaks > 0 THEN breaks ELSE leave END AS p0,
    CASE WHEN breaks > 0 THEN breaks WHEN fast < -0.8 THEN 0 WHEN trend > 0.4 THEN 1 {turn_down} ELSE 0 END AS p1,
    CASE WHEN breaks > 0 THEN breaks WHEN fast > 0.8 THEN 0 WHEN trend < -0.4 THEN 2 {turn_up} ELSE 0 END AS p2
  FROM pr
), s AS (
  SELECT symbol, idx, first AS regime, 0 AS held, -1 AS pending, 0 AS cnt FROM c WHERE idx = 0
  UNION ALL
  SELECT c.symbol, c.idx, CASE WHEN {go} THEN {new} ELSE s.regime END, CASE WHEN {go} THEN 0 ELSE s.held + 1 END,
    CASE WHEN {new} = s.regime OR {go} THEN -1 ELSE {new} END, CASE WHEN {new} = s.regime OR {go} THEN 0 ELSE {count} END
  FROM s JOIN c ON c.symbol = s.symbol AND c.idx = s.idx + 1
)
SELECT symbol, idx, ['range', 'up', 'down'][regime + 1] AS regime FROM s
"""


SQL = {
    "rule_regimes_by_row": _rule_sql(1, True),
    "confirmed_rule_regimes": _rule_sql(3, False),
    "correlated_features": f"""
WITH RECURSIVE f AS MATERIALIZED ({feature_oracles.sql(CANONICAL_SQL, "returns", digits=15, clipped=False)}),
r AS MATERIALIZED (SELECT {", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS r_{x}" for x in _RETURN_NAMES)} FROM f),
p AS MATERIALIZED ({_PAIRS}), t AS MATERIALIZED (SELECT b, list(a) FILTER (rho >= 0.9) AS near FROM p GROUP BY b),
k AS (
  SELECT 0 AS i, [0] AS kept
  UNION ALL
  SELECT k.i + 1, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, k.i + 1) END FROM k JOIN t ON t.b = k.i + 1
)
SELECT [{", ".join(f"'{x}'" for x in _RETURN_NAMES)}][j + 1] AS feature FROM range({len(_RETURN_NAMES)}) AS n(j) WHERE j NOT IN (SELECT unnest(kept) FROM k WHERE i = {len(_RETURN_NAMES) - 1})
""",
    "gap_policy": f"""
WITH x AS MATERIALIZED (
  SELECT r.symbol, r.idx, r.max_gap_run_120 AS run, round(avg(gap_flag) OVER (PARTITION BY c.symbol ORDER BY c.idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9) AS r
  FROM ({CANONICAL_SQL}) AS c JOIN ({bars.SQL["max_gap_run"]}) AS r ON r.symbol = c.symbol AND r.idx = c.idx
)
SELECT feature_group, live, action, count(*) AS n FROM ({_GAP_CASES}) GROUP BY ALL
""",
    "missing_causes": "WITH c AS (" + CANONICAL_SQL + ") SELECT feature, cause, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN gap_flag = 1 THEN 'outage_nan' WHEN idx < {n} THEN 'warmup_nan' ELSE '{'structural_nan' if f == 'rv_120' else 'isolated_feature_nan'}' END AS cause FROM c" for f, n in _WARM_UP.items()
    ) + ") GROUP BY ALL",
    "permutation_importance": _changes_sql(
        "SELECT a.*, " + ", ".join(f"b.{x} AS rev_{x}" for x in MODEL_FEATURES)
        + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS i FROM scored) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS i FROM scored) AS b ON a.symbol = b.symbol AND a.i = b.i",
        "rev_{}",
    ),
    "feature_ablation": _changes_sql("SELECT * FROM scored", "u_{}"),
    "regime_folds": f"""
WITH n AS (SELECT symbol, count(*) AS n FROM ({CANONICAL_SQL}) GROUP BY symbol),
f AS (SELECT symbol, CAST(k AS INTEGER) AS fold, least(n, k * greatest(n // 5, 1)) AS start, CASE WHEN k = 4 THEN n ELSE least(n, (k + 1) * greatest(n // 5, 1)) END AS stop FROM n, range(1, 5) AS r(k))
SELECT symbol, fold, greatest(start - 60, 0) AS train_end, start, stop FROM f WHERE start < stop
""",
    "funding_of_trades": _TRADES + f""",
ev AS (
  SELECT e.symbol, e.m - c.m AS at, e.rate FROM (
    SELECT {_NORM} AS symbol, CAST(floor(CASE WHEN next_funding_time < 10000000000 THEN next_funding_time * 1000000 ELSE next_funding_time * 1000 END / 60000000) AS BIGINT) AS m, current_rate AS rate
    FROM funding_rates WHERE next_funding_time <> 0 AND current_rate IS NOT NULL) AS e JOIN c ON c.symbol = e.symbol AND c.idx = 0
), p AS (
  SELECT t.symbol, t.entry_idx, t.exit_idx, t.side, coalesce(-t.side * sum(ev.rate), 0) AS paid
  FROM trades AS t LEFT JOIN ev ON ev.symbol = t.symbol AND ev.at > t.entry_idx AND ev.at <= t.exit_idx GROUP BY t.symbol, t.entry_idx, t.exit_idx, t.side
)
SELECT symbol, entry_idx, exit_idx, side, {_one("paid", "paid", 9)} FROM p
""",
}
