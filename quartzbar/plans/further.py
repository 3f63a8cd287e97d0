"""Queries on offsets, ratios, fold and regime correlations, leaks, comparisons of runs, policies, monitors, further sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzbar.functions.keys import epoch_us
from quartzbar.functions.windows import rounded
from quartzbar.operators import backtest, bar_features, external_features, labels, models, monitors, recursive_features, regimes, rule_regimes, statistics, validation
from quartzbar.plans import bars, checks, evaluation, feature_oracles, governing, learning_data
from quartzbar.plans.bars import CANONICAL_SQL, canonical
from quartzbar.plans.evaluation import _P, _REGIMES, _RETURNS, _TRADES, COST, IC_FEATURES, _one, _regime_rows, _signals, _with_scored, scored
from quartzbar.plans.learning_data import _LABELS, HORIZON, SL, THRESHOLD, TP, barrier_labels
from quartzbar.session import checkpointed, table

_LEAKS = ("return_5", "return_30")


def calibration_offset(spark: SparkSession, d: str) -> DataFrame:
    s = validation.calibration_offset(scored(spark, d)).withColumnRenamed("offset", "shift")
    return s.selectExpr("symbol", *rounded(["shift"]))


def risk_ratios(spark: SparkSession, d: str) -> DataFrame:
    pnl = F.when(F.col("p") >= 0.5, F.when(F.col("y") == 1, TP - COST).otherwise(-(SL + COST))).otherwise(0.0)
    return validation.risk_ratios(scored(spark, d).select("symbol", "idx", pnl.alias("pnl")), "pnl").selectExpr("symbol", "n", *rounded(["sharpe", "calmar"]))


def return_interval(spark: SparkSession, d: str) -> DataFrame:
    return validation.order_interval(scored(spark, d).select("symbol", F.round("target_return", 9).alias("x")), "x").selectExpr("symbol", "n", *rounded(["lower", "upper"]))


def return_variance(spark: SparkSession, d: str) -> DataFrame:
    return validation.return_variance(canonical(spark, d)).selectExpr("symbol", "idx", *rounded(["variance"], 9))


def shuffled_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    trades = backtest.backtest(_signals(spark, d)).select("symbol", F.col("entry_idx").alias("idx"), "net")
    return validation.shuffled_drawdowns(trades, "net").selectExpr("symbol", *rounded(["own", "shuffled"]))


def fold_correlation(spark: SparkSession, d: str) -> DataFrame:
    s = validation.fold_correlation(scored(spark, d).select("symbol", "idx", *IC_FEATURES, "target_return"), list(IC_FEATURES), "target_return")
    return s.selectExpr("symbol", "feature", "folds", *rounded(["mean", "deviation"]))


def regime_correlation(spark: SparkSession, d: str) -> DataFrame:
    r = regimes.with_regimes(_regime_rows(spark, d)).select("symbol", "idx", "direction")
    rows = scored(spark, d).select("symbol", "idx", *IC_FEATURES, "target_return").join(r, ["symbol", "idx"])
    return validation.regime_correlation(rows, "direction", list(IC_FEATURES), "target_return").selectExpr("symbol", "regime", "feature", "n", *rounded(["ic"]))


def leak_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(scored(spark, d).select("symbol", "idx", *_LEAKS, "return_60", "target_return"))
    behind = bar_features.with_features(canonical(spark, d), "returns").select("symbol", (F.col("idx") + 1).alias("idx"), *_LEAKS)
    late = rows.select("symbol", "idx", "target_return").join(behind, ["symbol", "idx"])
    ic = lambda r, target: statistics.rank_correlation(r, list(_LEAKS), target)
    return validation.leak_flags(ic(rows, "target_return"), ic(late, "target_return"), ic(rows, "return_60"))


def _placed_trades(spark: SparkSession, d: str) -> DataFrame:
    base = canonical(spark, d)
    r = regimes.with_regimes(_regime_rows(spark, d)).select("symbol", F.col("idx").alias("entry_idx"), F.col("direction").alias("regime"))
    month = base.select("symbol", F.col("idx").alias("entry_idx"), F.date_format(F.timestamp_micros(F.col("m") * 60_000_000), "yyyy-MM").alias("month"))
    t = backtest.backtest(_signals(spark, d)).select("symbol", "entry_idx", "side", "net")
    return t.join(r, ["symbol", "entry_idx"]).join(month, ["symbol", "entry_idx"])


def trade_groups(spark: SparkSession, d: str) -> DataFrame:
    g = validation.trade_groups(_placed_trades(spark, d))
    return g.selectExpr("month", "regime", "side", "trades", *rounded(["total", "compounded", "win_rate", "sharpe", "profit_factor"]))


def reconciled_trades(spark: SparkSession, d: str) -> DataFrame:
    t = checkpointed(backtest.backtest(_signals(spark, d)))
    told = backtest.breakdown(t).where("side = 'all' AND reason = 'all' AND symbol <> 'all'").select("symbol", F.col("compounded").alias("reported"))
    return validation.reconcile(t, told).selectExpr("symbol", *rounded(["compounded", "reported"]), "agrees")


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """The backtest against one whose take profit is half as far."""
    s = checkpointed(_signals(spark, d))
    h = validation.head_to_head(backtest.backtest(s), backtest.backtest(s, tp=0.002))
    return h.selectExpr("side", "common", "only_a", "only_b", *rounded(["common_a", "common_b", "net_only_a", "net_only_b"]))


def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """Barrier labels under events: at order blocks fills that failed or were partial by their side."""
    base = canonical(spark, d)
    times = base.select("symbol", "idx", F.timestamp_micros(F.col("m") * 60_000_000).alias("open_time"))
    y = labels.triple_barriers(base, HORIZON, TP, SL, THRESHOLD).join(times, ["symbol", "idx"])
    blocks = checkpointed(checks.order_blocks(spark, d).join(times, ["symbol", "idx"]))
    bullish = F.col("side") == "bullish"
    events = blocks.select(
        "symbol", F.when(bullish, F.col("idx")).alias("idx"), F.when(~bullish, F.col("open_time")).alias("open_time"),
        F.when(bullish, "tp_first").otherwise("partial_fill").alias("label_reason"), F.lit(None).cast("int").alias("label"),
    )
    return labels.external_labels(y, events, THRESHOLD).select("symbol", "idx", "label", "label_reason")


def short_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.with_target(barrier_labels(spark, d), "short_success").groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))


def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    return regimes.transitions(regimes.with_regimes(_regime_rows(spark, d)), "direction")


def direction_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Rows after which the direction, each row judged by itself, changed too often."""
    rows = checkpointed(_regime_rows(spark, d))
    coded = rows.join(regimes.fit_thresholds(rows), "symbol").select("symbol", "idx", regimes.direction_code().alias("code"))
    return regimes.jitter(coded, "code")


def regime_sides(spark: SparkSession, d: str) -> DataFrame:
    """Rows and successes of each side that a regime admits."""
    r = regimes.with_regimes(_regime_rows(spark, d)).select("symbol", "idx", "direction")
    y = labels.triple_barriers(canonical(spark, d), HORIZON, TP, SL, THRESHOLD).select("symbol", "idx", "long_success", "short_success")
    return regimes.by_policy(r.join(y, ["symbol", "idx"]), "direction").groupBy("direction", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("successes"))


def regime_holdouts(spark: SparkSession, d: str) -> DataFrame:
    return regimes.holdouts(regimes.with_regimes(_regime_rows(spark, d)).select("symbol", "direction"), "direction", HORIZON)


def weekly_strength(spark: SparkSession, d: str) -> DataFrame:
    w = bars.features_weekly(spark, d)
    return regimes.with_weekly_strength(_regime_rows(spark, d).join(w, ["symbol", "idx"]))


def expanding_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Each row by thresholds of the rows up to it."""
    return regimes.expanding_strength(_regime_rows(spark, d))


def features_mark(spark: SparkSession, d: str) -> DataFrame:
    marks = external_features.mark_prices(table(spark, d, "exchange_responses"))
    return external_features.mark_features(canonical(spark, d), marks).selectExpr("symbol", "idx", *rounded(["mark_price_basis", "premium_index"], 8))


def features_funding_backward(spark: SparkSession, d: str) -> DataFrame:
    rows = external_features.funding_features(canonical(spark, d), table(spark, d, "funding_rates"), nearest=False)
    return rows.selectExpr("symbol", "idx", *rounded(list(learning_data.FUNDING), 8))


def features_ema_vol_adj(spark: SparkSession, d: str) -> DataFrame:
    """The spread of the exponential means in units of the hour's deviation."""
    base = canonical(spark, d)
    e = recursive_features.with_recursive_features(base).select("symbol", "idx", "ema_12_26_spread")
    v = bar_features.with_features(base, "volatility").select("symbol", "idx", "rv_60")
    x = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("ema_12_26_spread") / F.greatest(F.col("rv_60"), F.lit(1e-12))))
    return e.join(v, ["symbol", "idx"]).select("symbol", "idx", x.alias("ema_spread_vol_adj")).selectExpr("symbol", "idx", *rounded(["ema_spread_vol_adj"], 5))


def features_regime_prob(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed probabilities of the regimes as features of the minutes."""
    rows = bar_features.with_features(canonical(spark, d), "returns").selectExpr(
        "symbol", "idx", f"round({_P}, 9) AS up", f"round(0.9 - {_P}, 9) AS down", "CAST(0.1 AS DOUBLE) AS range"
    )
    s = regimes.smoothed(rows, ["down", "range", "up"])
    return s.selectExpr("symbol", "idx", "up_smooth AS regime_prob_up", "range_smooth AS regime_prob_range", "down_smooth AS regime_prob_down").selectExpr(
        "symbol", "idx", *rounded(["regime_prob_up", "regime_prob_range", "regime_prob_down"])
    )


def clock_actions(spark: SparkSession, d: str) -> DataFrame:
    """Responses by what the distance of their server time from the local clock asks for."""
    r = table(spark, d, "exchange_responses").where("status_code = 200")
    server = epoch_us(F.try_variant_get(F.try_parse_json("payload"), "$.time", "bigint"))
    drift = F.round(F.abs(server - F.unix_micros(F.col("received_at").cast("timestamp"))) / 1000)
    known = r.select(drift.alias("drift")).where("drift IS NOT NULL")
    return known.groupBy(monitors.clock_action(F.col("drift")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.max("drift").cast("long").alias("greatest_ms"))


def confirmed_rule_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Rule regimes that need a proposal three rows in a row and reverse by way of range only."""
    return rule_regimes.with_rule_regimes(governing.rule_regime_rows(spark, d), confirm=3, reversal=False)


def calibrated_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores by symbol before and after the calibration that the number of positives asks for."""
    rows = checkpointed(scored(spark, d).select("symbol", "p", "y"))
    method, q = models.fit_calibration(rows, "p", "y")
    s = rows.withColumn("q", q)
    return s.groupBy("symbol").agg(F.lit(method).alias("method"), *(F.avg((F.col(x) - F.col("y")) * (F.col(x) - F.col("y"))).alias(f"brier_{x}") for x in ("p", "q")))


QUERIES = {
    f.__name__: f
    for f in (
        calibration_offset, risk_ratios, return_interval, return_variance, shuffled_drawdowns, fold_correlation, regime_correlation, leak_flags, trade_groups, reconciled_trades, head_to_head,
        event_labels, short_labels, regime_transitions, direction_jitter, regime_sides, regime_holdouts, weekly_strength, expanding_regimes, features_mark, features_funding_backward, features_ema_vol_adj,
        features_regime_prob, clock_actions, confirmed_rule_regimes, calibrated_probabilities,
    )
}


def _after(body: str) -> str:
    """A further table behind those of _with_scored."""
    return _with_scored("@" + body).replace(") @,", "),").replace(")@,", "),")


def _ranks(features: tuple[str, ...], keys: str) -> str:
    return ", ".join(f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2 AS r_{x}" for x in features)


def _ics(features: tuple[str, ...], keys: str, target: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{x}' AS feature, count(*) AS n, corr(r_{x}, r_{target}) AS ic FROM {source} GROUP BY ALL" for x in features)


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"
_FINITE = "CASE WHEN n >= 30 AND isfinite(ic) THEN ic ELSE 0 END"
_WEEKLY_SQL = bars.SQL["features_weekly"]
SQL = {
    "calibration_offset": _with_scored(f"SELECT symbol, {_one(_LOGIT.format('avg(y)') + ' - ' + _LOGIT.format('avg(p)'), 'shift')} FROM scored GROUP BY symbol"),
    "risk_ratios": _after(f""", w AS (SELECT symbol, idx, CASE WHEN p < 0.5 THEN 0 WHEN y = 1 THEN {TP - COST!r} ELSE -{SL + COST!r} END AS pnl FROM scored),
e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY idx) AS eq FROM w), f AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY symbol ORDER BY idx)) - eq AS fall FROM e)
SELECT symbol, count(*) AS n, {_one("CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) ELSE 0 END", "sharpe")},
       {_one("CASE WHEN max(fall) > 1e-12 THEN sum(pnl) / max(fall) ELSE 0 END", "calmar")} FROM f GROUP BY symbol"""),
    "return_interval": _after(f""", s AS (SELECT symbol, list_sort(list(round(target_return, 9))) AS x FROM scored GROUP BY symbol)
SELECT symbol, len(x) AS n, {_one("x[CAST(floor((len(x) - 1) * 0.025) AS BIGINT) + 1]", "lower")}, {_one("x[CAST(floor((len(x) - 1) * 0.975) AS BIGINT) + 1]", "upper")} FROM s"""),
    "return_variance": f"""
WITH c AS (SELECT symbol, idx, CASE WHEN gap_flag = 0 AND idx > 0 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY idx) - 1 END AS r FROM ({CANONICAL_SQL})),
v AS (SELECT symbol, idx, count(r) OVER w AS n, var_pop(r) OVER w AS v FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW))
SELECT symbol, idx, {_one("CASE WHEN n < 2 THEN 0 ELSE v END", "variance", 9)} FROM v
""",
    "shuffled_drawdowns": _TRADES + f""",
sx AS (SELECT symbol, entry_idx, net, draw, CASE WHEN draw = 0 THEN CAST(entry_idx AS BIGINT) ELSE CAST('0x' || substr(md5(symbol || '/' || entry_idx || '/' || draw), 1, 15) AS BIGINT) END AS at_ FROM trades, range(101) AS r(draw)),
se AS (SELECT *, 1 + sum(net) OVER (PARTITION BY symbol, draw ORDER BY at_) AS eq FROM sx),
sf AS (SELECT symbol, draw, greatest(1, max(eq) OVER (PARTITION BY symbol, draw ORDER BY at_)) AS peak, eq FROM se),
sg AS (SELECT symbol, draw, max((peak - eq) / peak) AS fall FROM sf GROUP BY ALL)
SELECT symbol, {_one("max(fall) FILTER (draw = 0)", "own")}, {_one("list_sort(list(fall) FILTER (draw > 0))[90]", "shuffled")} FROM sg GROUP BY symbol
""",
    "fold_correlation": _after(f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k, count(*) OVER (PARTITION BY symbol) AS all_ FROM scored),
f AS (SELECT *, (k * 5 - 1) // all_ AS fold FROM k WHERE all_ >= 150), r AS (SELECT symbol, fold, {_ranks((*IC_FEATURES, "target_return"), "symbol, fold")} FROM f),
u AS ({_ics(IC_FEATURES, "symbol, fold", "target_return", "r")}), v AS (SELECT symbol, feature, {_FINITE} AS ic FROM u WHERE n >= 30)
SELECT symbol, feature, count(*) AS folds, {_one("avg(ic)", "mean")}, {_one("stddev_pop(ic)", "deviation")} FROM v GROUP BY ALL"""),
    "regime_correlation": _after(f""", g AS MATERIALIZED ({_REGIMES}), j AS (SELECT s.*, g.direction AS regime FROM scored AS s JOIN g ON g.symbol = s.symbol AND g.idx = s.idx),
r AS (SELECT symbol, regime, {_ranks((*IC_FEATURES, "target_return"), "symbol, regime")} FROM j), u AS ({_ics(IC_FEATURES, "symbol, regime", "target_return", "r")})
SELECT symbol, regime, feature, n, {_one(_FINITE, "ic")} FROM u"""),
    "leak_flags": _after(f""", b AS MATERIALIZED ({_RETURNS}), l AS (SELECT s.symbol, s.target_return, b.return_5, b.return_30 FROM scored AS s JOIN b ON b.symbol = s.symbol AND b.idx + 1 = s.idx),
rn AS (SELECT symbol, {_ranks((*_LEAKS, "target_return", "return_60"), "symbol")} FROM scored), rl AS (SELECT symbol, {_ranks((*_LEAKS, "target_return"), "symbol")} FROM l),
a AS (SELECT symbol, feature, {_FINITE} AS ic FROM ({_ics(_LEAKS, "symbol", "target_return", "rn")})), z AS (SELECT symbol, feature, {_FINITE} AS ic FROM ({_ics(_LEAKS, "symbol", "target_return", "rl")})),
c AS (SELECT symbol, feature, {_FINITE} AS ic FROM ({_ics(_LEAKS, "symbol", "return_60", "rn")}))
SELECT symbol, feature, abs(a.ic) > 0.1 AND abs(a.ic) > abs(c.ic) AS fwd_past, abs(a.ic) >= 0.05 AND abs(z.ic) < 0.5 * abs(a.ic) AS lag1_collapse FROM a JOIN z USING (symbol, feature) JOIN c USING (symbol, feature)"""),
    "trade_groups": _TRADES + f""",
g AS MATERIALIZED ({_REGIMES}), t AS (
  SELECT strftime(make_timestamp(CAST(c.m AS BIGINT) * 60000000), '%Y-%m') AS month, g.direction AS regime, CAST(t.side AS VARCHAR) AS side, t.net
  FROM trades AS t JOIN g ON g.symbol = t.symbol AND g.idx = t.entry_idx JOIN c ON c.symbol = t.symbol AND c.idx = t.entry_idx
)
SELECT coalesce(month, 'all') AS month, coalesce(regime, 'all') AS regime, coalesce(side, 'all') AS side, count(*) AS trades, {_one("sum(net)", "total")}, {_one("product(1 + net) - 1", "compounded")},
       {_one("avg(CAST(net > 0 AS INTEGER))", "win_rate")}, {_one("CASE WHEN count(*) >= 2 AND stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) END", "sharpe")},
       {_one("coalesce(sum(net) FILTER (net > 0), 0) / nullif(-coalesce(sum(net) FILTER (net < 0), 0), 0)", "profit_factor")}
FROM t GROUP BY GROUPING SETS ((month), (regime), (side), (regime, side), ())
""",
    "reconciled_trades": _TRADES + f"SELECT symbol, {_one('product(1 + net) - 1', 'compounded')}, {_one('product(1 + net) - 1', 'reported')}, true AS agrees FROM trades GROUP BY symbol",
    "head_to_head": f"""
WITH a AS MATERIALIZED ({_TRADES} SELECT * FROM trades), b AS MATERIALIZED ({_TRADES.replace("0.004", "0.002")} SELECT * FROM trades),
j AS (SELECT coalesce(a.side, b.side) AS side, a.net AS x, b.net AS y FROM a FULL JOIN b ON a.symbol = b.symbol AND a.entry_idx = b.entry_idx AND a.side = b.side)
SELECT side, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b,
       {_one("coalesce(sum(x) FILTER (y IS NOT NULL), 0)", "common_a")}, {_one("coalesce(sum(y) FILTER (x IS NOT NULL), 0)", "common_b")},
       {_one("coalesce(sum(x) FILTER (y IS NULL), 0)", "net_only_a")}, {_one("coalesce(sum(y) FILTER (x IS NULL), 0)", "net_only_b")} FROM j GROUP BY side
""",
    "event_labels": f"""
SELECT l.symbol, l.idx, CASE b.side WHEN 'bullish' THEN 1 WHEN 'bearish' THEN 0 ELSE l.label END AS label, CASE b.side WHEN 'bullish' THEN 'tp_first' WHEN 'bearish' THEN 'partial_fill' ELSE l.label_reason END AS label_reason
FROM ({_LABELS}) AS l LEFT JOIN ({checks.SQL["order_blocks"]}) AS b ON b.symbol = l.symbol AND b.idx = l.idx
""",
    "short_labels": f"SELECT symbol, short_success AS label, count(*) AS n FROM ({_LABELS}) GROUP BY ALL",
    "regime_transitions": f"""
WITH r AS ({_REGIMES}), s AS (SELECT symbol, lag(direction) OVER (PARTITION BY symbol ORDER BY idx) AS before, direction AS after FROM r)
SELECT symbol, before, after, count(*) AS n FROM s WHERE before <> after GROUP BY ALL
""",
    "direction_jitter": f"""
WITH r AS MATERIALIZED ({evaluation._REGIME_ROWS}), t AS ({evaluation._THRESHOLDS}),
s AS (SELECT symbol, idx, CASE WHEN trend_slope_30 > direction THEN 1 WHEN trend_slope_30 < -direction THEN 2 ELSE 0 END AS code FROM r JOIN t USING (symbol)),
k AS (SELECT symbol, idx, CASE WHEN lag(code) OVER (PARTITION BY symbol ORDER BY idx) <> code THEN 1 ELSE 0 END AS c FROM s),
n AS (SELECT symbol, idx, CAST(sum(c) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM k)
SELECT * FROM n WHERE changes > 3
""",
    "regime_sides": f"""
WITH r AS ({_REGIMES}), l AS ({_LABELS}), p AS (SELECT * FROM (VALUES ('up', 'long'), ('down', 'short'), ('range', 'long'), ('range', 'short')) AS p(direction, side))
SELECT r.direction, p.side, count(*) AS n, CAST(sum(CASE p.side WHEN 'long' THEN l.long_success ELSE l.short_success END) AS BIGINT) AS successes
FROM r JOIN l ON l.symbol = r.symbol AND l.idx = r.idx JOIN p ON p.direction = r.direction GROUP BY ALL
""",
    "regime_holdouts": f"""
WITH n AS (SELECT symbol, direction AS regime, count(*) AS n FROM ({_REGIMES}) GROUP BY ALL), s AS (SELECT *, greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS train_end FROM n),
h AS (SELECT *, train_end + least({HORIZON}, greatest(0, (n - train_end) // 4)) AS holdout_start FROM s)
SELECT symbol, regime, n, train_end, holdout_start, holdout_start < n - 10 AND train_end >= 10 AS viable FROM h
""",
    "weekly_strength": f"""
WITH r AS MATERIALIZED ({evaluation._REGIME_ROWS}), t AS ({evaluation._THRESHOLDS}), w AS ({_WEEKLY_SQL}),
j AS (SELECT r.symbol, r.idx, rv_15 > rv OR weekly_drawdown < -0.2 AS high, rv_15, rv, abs(trend_slope_30) > trend AND rv_15 <= rv AS steep, w.* EXCLUDE (symbol, idx)
      FROM r JOIN t ON t.symbol = r.symbol JOIN w ON w.symbol = r.symbol AND w.idx = r.idx)
SELECT symbol, idx, CASE WHEN high THEN 'high_volatility' WHEN weekly_vol_contraction < 0.5 THEN 'ranging'
  WHEN steep OR (weekly_drawdown > -0.05 AND (abs(weekly_ma20_slope_closed) > 0.02 OR (weekly_ma20_above_ma50 = 1 AND weekly_ma20_slope_closed > 0 AND weekly_ma50_slope_closed > 0))) THEN 'trending' ELSE 'ranging' END AS strength FROM j
""",
    "expanding_regimes": f"""
WITH r AS MATERIALIZED ({evaluation._REGIME_ROWS}),
t AS (SELECT *, quantile_cont(rv_15, 0.75) OVER w AS rv, greatest(1e-5, quantile_cont(abs(trend_slope_30), 0.9) OVER w) AS trend FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT symbol, idx, CASE WHEN rv_15 > rv THEN 'high_volatility' WHEN abs(trend_slope_30) > trend THEN 'trending' ELSE 'ranging' END AS strength FROM t
""",
    "features_mark": f"""
WITH p AS (SELECT response_id, CAST(payload AS JSON) AS j FROM exchange_responses WHERE status_code = 200 AND json_valid(payload)),
m AS (SELECT regexp_replace(upper(j->>'symbol'), '[^A-Z0-9]', '', 'g') AS e, TRY_CAST(j->>'time' AS BIGINT) AS t, TRY_CAST(j->>'markPrice' AS DOUBLE) AS price, TRY_CAST(j->>'premium' AS DOUBLE) AS premium, response_id FROM p WHERE json_type(j) = 'OBJECT'),
k AS (SELECT e, CASE WHEN t < 10000000000 THEN t * 1000000 ELSE t * 1000 END AS t, arg_max(price, response_id) AS price, arg_max(coalesce(premium, 0), response_id) AS premium FROM m WHERE price IS NOT NULL AND t IS NOT NULL AND e <> '' GROUP BY ALL)
SELECT c.symbol, c.idx, {_one("(coalesce(k.price, c.close * 1.0002) - c.close) / c.close", "mark_price_basis", 8)}, {_one("CASE WHEN k.price IS NULL THEN 0.0002 ELSE k.premium END", "premium_index", 8)}
FROM ({CANONICAL_SQL}) AS c LEFT JOIN k ON k.e = c.symbol AND k.t = c.m * 60000000
""",
    "features_ema_vol_adj": f"""
WITH e AS ({recursive_features.sql_text(CANONICAL_SQL)}), v AS ({feature_oracles.sql(CANONICAL_SQL, "volatility", digits=15, clipped=False)})
SELECT e.symbol, e.idx, {_one("greatest(-10, least(10, e.ema_12_26_spread / greatest(v.rv_60, 1e-12)))", "ema_spread_vol_adj", 5)} FROM e JOIN v ON v.symbol = e.symbol AND v.idx = e.idx
""",
    "features_regime_prob": f"""
WITH f AS ({_RETURNS}), p AS (SELECT symbol, idx, round({_P}, 9) AS up, round(0.9 - {_P}, 9) AS down FROM f),
s AS (SELECT symbol, idx, list_avg(list(up) OVER w) AS u, list_avg(list(down) OVER w) AS d FROM p WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT symbol, idx, {_one("u", "regime_prob_up")}, {_one("0.1", "regime_prob_range")}, {_one("d", "regime_prob_down")} FROM s
""",
    "clock_actions": """
WITH p AS (SELECT CAST(payload AS JSON) AS j, epoch_us(received_at) AS here FROM exchange_responses WHERE status_code = 200 AND json_valid(payload)),
t AS (SELECT TRY_CAST(j->>'time' AS BIGINT) AS t, here FROM p WHERE json_type(j) = 'OBJECT'),
d AS (SELECT round(abs(CASE WHEN t < 10000000000 THEN t * 1000000 ELSE t * 1000 END - here) / 1000) AS drift FROM t WHERE t IS NOT NULL AND here IS NOT NULL)
SELECT CASE WHEN drift >= 1000 THEN 'hard_kill' WHEN drift >= 500 THEN 'block_new_entries' WHEN drift >= 100 THEN 'warn_only' ELSE 'allow' END AS action, count(*) AS n, CAST(max(drift) AS BIGINT) AS greatest_ms FROM d GROUP BY ALL
""",
}
_NORM = "regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g')"
_FUNDING_SQL = f"""
WITH d AS (
  SELECT {_NORM} AS symbol, CASE WHEN next_funding_time < 10000000000 THEN next_funding_time * 1000000 ELSE next_funding_time * 1000 END AS t,
         arg_max({{'c': current_rate, 'n': next_rate, 'm': minutes_to_next}}, funding_id) AS v
  FROM funding_rates WHERE next_funding_time <> 0 GROUP BY ALL
), c AS MATERIALIZED ({CANONICAL_SQL}),
b AS (SELECT c.symbol, c.idx, c.m, d.t, d.v FROM c ASOF LEFT JOIN d ON d.symbol = c.symbol AND c.m * 60000000 >= d.t),
a AS (SELECT c.symbol, c.idx, d.t, d.v FROM c ASOF LEFT JOIN d ON d.symbol = c.symbol AND c.m * 60000000 <= d.t),
j AS (SELECT b.symbol, b.idx, {{pick}} AS v FROM b JOIN a ON a.symbol = b.symbol AND a.idx = b.idx)
SELECT symbol, idx, {", ".join(_one(e, n, 8) for e, n in (("coalesce(v.c, 0)", "funding_rate"), ("coalesce(v.n, 0)", "next_funding_rate"), ("coalesce(v.m, 480)", "minutes_to_next_funding"), ("CASE WHEN coalesce(v.m, 480) <= 60 THEN 1 ELSE 0 END", "funding_blackout_active")))} FROM j
"""
SQL["features_funding_backward"] = _FUNDING_SQL.replace("{pick}", "b.v")
#: The nearest of both directions: at equal distance the earlier.
NEAREST_FUNDING_SQL = _FUNDING_SQL.replace("{pick}", "CASE WHEN b.t IS NULL OR a.t - b.m * 60000000 < b.m * 60000000 - b.t THEN a.v ELSE b.v END")
