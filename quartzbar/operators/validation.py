"""Validation of signals and trades: offsets, ratios, order intervals, variances, shuffled drawdowns, fold and regime correlations, leaks.

Rows are keyed and worked in blocks (see asof and statistics); what is looked at in one task is a few rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import _ordered_counts, prefix_sums
from quartzbar.operators.splits import sample_numbers
from quartzbar.operators.statistics import drawdown, rank_correlation
from quartzbar.operators.timeline import in_chunks
from quartzbar.session import checkpointed

#: Width of a block of hash values: 60 bits in 1024 blocks.
_HASH_BLOCK = 1 << 50
#: Spread and fall at or below this are rounding noise.
NOISE = 1e-12


def logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def calibration_offset(scored: DataFrame) -> DataFrame:
    """Per symbol from (symbol, p, y): the logit of the observed rate less that of the mean prediction."""
    s = scored.groupBy("symbol").agg(F.avg("y").alias("observed"), F.avg("p").alias("mean_p"))
    return s.select("symbol", (logit(F.col("observed")) - logit(F.col("mean_p"))).alias("offset"))


def risk_ratios(rows: DataFrame, pnl: str) -> DataFrame:
    """Per symbol from rows (symbol, idx, pnl): sharpe (mean by deviation times the root of n) and calmar (total by greatest fall); 0 where that is noise."""
    n = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    s = drawdown(rows, pnl).join(n, "symbol")
    safe = lambda a, b: F.coalesce(F.when(F.col(b) > NOISE, F.col(a) / F.col(b)), F.lit(0.0))
    return s.select("symbol", "n", (safe("mean", "deviation") * F.sqrt("n")).alias("sharpe"), safe("total", "max_drawdown").alias("calmar"))


def order_interval(rows: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per symbol the values at the places int((n - 1) * low) and int((n - 1) * high) of their order."""
    placed = _ordered_counts(rows, "symbol", value)
    at = lambda q: F.floor((F.col("_all") - 1) * F.lit(q))
    pick = lambda q: F.max(F.when((F.col("_upto") > at(q)) & (F.col("_upto") - F.col("_n") <= at(q)), F.col(value)))
    return placed.groupBy("symbol").agg(F.max("_all").alias("n"), pick(low).alias("lower"), pick(high).alias("upper"))


def return_variance(timeline: DataFrame, lookback: int = 1440) -> DataFrame:
    """symbol, idx, variance of the minute returns of the last lookback minutes; repaired minutes inside count for nothing; 0 below two returns."""
    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    rows = in_chunks(timeline.select("symbol", "idx", "close", "gap_flag"), before=lookback + 1)
    change = F.col("close") / F.lag("close").over(w) - 1
    rows = rows.withColumn("r", F.when((F.col("gap_flag") == 0) & (F.col("idx") > 0), change))
    last = w.rowsBetween(-(lookback - 1), 0)
    rows = rows.withColumns({"n": F.count("r").over(last), "v": F.var_pop("r").over(last)})
    return rows.where("core").select("symbol", "idx", F.when(F.col("n") >= 2, F.col("v")).otherwise(0.0).alias("variance"))


def shuffled_drawdowns(rows: DataFrame, pnl: str, draws: int = 100, share: float = 0.9) -> DataFrame:
    """Per symbol from rows (symbol, idx, pnl): greatest relative fall of the equity (from 1), and that fall at a place of
    the order of so many shuffles.

    A shuffle is an order drawn by a hash of row and draw; draw 0 is the order of time. Each is worked in blocks.
    """
    every = rows.select("symbol", "idx", F.col(pnl).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", "symbol", F.col("idx").cast("string"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    keyed = every.select(F.concat_ws("/", "symbol", F.col("draw").cast("string")).alias("key"), "symbol", "draw", F.when(F.col("draw") == 0, F.col("idx").cast("long")).otherwise(drawn).alias("at"), "x")
    run = prefix_sums(checkpointed(keyed), "key", "at", {"sum": F.col("x")}, _HASH_BLOCK).withColumn("equity", F.col("sum") + 1).withColumn("b", F.floor(F.col("at") / _HASH_BLOCK))
    tops = run.groupBy("key", "b").agg(F.max("equity").alias("t"))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("key", "b", F.greatest(F.lit(1.0), F.max("t").over(before)).alias("carried"))
    inside = Window.partitionBy("key", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest("carried", F.max("equity").over(inside))
    falls = run.join(tops, ["key", "b"]).withColumn("peak", peak).groupBy("symbol", "draw").agg(F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak"))).alias("fall"))
    shuffles = F.array_sort(F.collect_list(F.when(F.col("draw") > 0, F.coalesce("fall", F.lit(0.0)))))
    return falls.groupBy("symbol").agg(F.max(F.when(F.col("draw") == 0, F.coalesce("fall", F.lit(0.0)))).alias("own"), F.get(shuffles, F.lit(int((draws - 1) * share))).alias("shuffled"))


def _within(rows: DataFrame, part: Column, features: list[str], target: str, least: int) -> DataFrame:
    """symbol, part, feature, n, ic: rank correlations inside parts of the symbols' rows."""
    keyed = rows.withColumn("symbol", F.concat_ws("\u0001", "symbol", part.cast("string")))
    found = rank_correlation(keyed, features, target, least)
    return found.select(F.split_part("symbol", F.lit("\u0001"), F.lit(1)).alias("symbol"), F.split_part("symbol", F.lit("\u0001"), F.lit(2)).alias("part"), "feature", "n", "ic")


def fold_correlation(rows: DataFrame, features: list[str], target: str, folds: int = 5, least: int = 30) -> DataFrame:
    """symbol, feature, mean, deviation, folds of the rank correlations in consecutive folds of rows (symbol, idx, ...).

    Folds of fewer rows than least are left out; symbols with fewer than that times the folds have none.
    """
    numbered = checkpointed(sample_numbers(rows.withColumn("start", F.col("idx")))).where(F.col("n") >= folds * least)
    fold = F.floor(((F.col("k") + 1) * folds - 1) / F.col("n"))
    found = _within(numbered.drop("start"), fold, features, target, least).where(F.col("n") >= least)
    return found.groupBy("symbol", "feature").agg(F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("deviation"), F.count(F.lit(1)).alias("folds"))


def regime_correlation(rows: DataFrame, regime: str, features: list[str], target: str, least: int = 30) -> DataFrame:
    """symbol, regime, feature, n, ic: the rank correlations inside each regime."""
    return _within(rows, F.col(regime), features, target, least).withColumnRenamed("part", "regime")


def leak_flags(now: DataFrame, late: DataFrame, past: DataFrame) -> DataFrame:
    """symbol, feature, fwd_past, lag1_collapse from three correlations (symbol, feature, ic): with the return ahead, of the feature
    a row late, with the return behind."""
    ic = lambda d, n: d.select("symbol", "feature", F.col("ic").alias(n))
    j = ic(now, "a").join(ic(late, "b"), ["symbol", "feature"]).join(ic(past, "c"), ["symbol", "feature"])
    return j.select(
        "symbol", "feature", ((F.abs("a") > 0.10) & (F.abs("a") > F.abs("c"))).alias("fwd_past"), ((F.abs("a") >= 0.05) & (F.abs("b") < 0.5 * F.abs("a"))).alias("lag1_collapse")
    )


def trade_groups(trades: DataFrame) -> DataFrame:
    """Trades (net, side, month, regime) by month, regime, side, regime and side, and all: one pass with grouping sets.

    The sharpe is null below two trades or without dispersion, the profit factor without a loss.
    """
    m, r, s = F.col("month"), F.col("regime"), F.col("side")
    win, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, -F.col("net"))
    deviation = F.stddev_pop("net")
    g = trades.groupingSets([[m], [r], [s], [r, s], []], m, r, s).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net").alias("total"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("compounded"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"),
        F.when((F.count(F.lit(1)) >= 2) & (deviation > NOISE), F.avg("net") / deviation).alias("sharpe"), F.when(F.sum(loss) > 0, F.coalesce(F.sum(win), F.lit(0.0)) / F.sum(loss)).alias("profit_factor"),
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return g.select(text("month"), text("regime"), text("side"), "trades", "total", "compounded", "win_rate", "sharpe", "profit_factor")


def reconcile(trades: DataFrame, reported: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """symbol, compounded, reported, agrees: whether the trades (symbol, net) compound to the returns that are reported (symbol, reported)."""
    made = trades.groupBy("symbol").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("compounded"))
    j = made.join(reported, "symbol", "full_outer").select("symbol", F.coalesce("compounded", F.lit(0.0)).alias("compounded"), F.coalesce("reported", F.lit(0.0)).alias("reported"))
    near = F.abs(F.col("compounded") - F.col("reported")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("compounded"), F.abs("reported")))
    return j.withColumn("agrees", near)


def head_to_head(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, common, only_a, only_b entries of two runs (symbol, entry_idx, side, net), and the sums of net of each part."""
    x = a.select("symbol", "entry_idx", "side", F.col("net").alias("net_a"), F.lit(1).alias("in_a"))
    y = b.select("symbol", "entry_idx", "side", F.col("net").alias("net_b"), F.lit(1).alias("in_b"))
    j = x.join(y, ["symbol", "entry_idx", "side"], "full_outer")
    both, mine, other = F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), F.col("in_b").isNull(), F.col("in_a").isNull()
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0))
    return j.groupBy("side").agg(
        n(both).alias("common"), n(mine).alias("only_a"), n(other).alias("only_b"), total(both, "net_a").alias("common_a"), total(both, "net_b").alias("common_b"),
        total(mine, "net_a").alias("net_only_a"), total(other, "net_b").alias("net_only_b"),
    )
