"""Decisions on the quality of rows and features: gap policy, causes of missing values, importance, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzbar.operators.asof import mean_ranks
from quartzbar.operators.splits import sample_numbers
from quartzbar.session import checkpointed, with_row_per_key

# The greatest gap ratio by group of features, the run that is too long, the limits of live data.
GAP_LIMITS = {
    "price_return_features": 0.10, "volatility_features": 0.05, "volume_trade_flow_features": 0.02,
    "mark_premium_features": 0.05, "safety_features": 1.00,
}
LONG_RUN, LIVE_BLOCK, LIVE_WARN = 3, 0.20, 0.10


def gap_action(group: str, ratio: Column, run: Column, live: bool) -> Column:
    """keep_as_state, drop_sample, block_new_entries, warn or allow."""
    if group == "safety_features":
        return F.lit("keep_as_state")
    if live:
        return F.when((run >= LONG_RUN) | (ratio >= LIVE_BLOCK), "block_new_entries").when(ratio >= LIVE_WARN, "warn").otherwise("allow")
    return F.when((run >= LONG_RUN) | (ratio >= GAP_LIMITS.get(group, 0.10)), "drop_sample").otherwise("allow")


def missing_cause(outage: Column, warm_up: Column, optional: Column) -> Column:
    """Why a value is missing; an outage explains it before the warm-up, that before a source that need not be there."""
    return F.when(outage, "outage_nan").when(warm_up, "warmup_nan").when(optional, "structural_nan").otherwise("isolated_feature_nan")


def reversed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (symbol, start, ...) with each column's values in reverse order of the symbol's rows, as rev_<column>."""
    numbered = checkpointed(sample_numbers(rows))
    back = numbered.select("symbol", (F.col("n") - 1 - F.col("k")).alias("k"), *(F.col(c).alias(f"rev_{c}") for c in columns))
    return numbered.join(back, ["symbol", "k"])


def accuracy_changes(rows: DataFrame, probability, columns: list[str], label: str, other: dict[str, Column]) -> DataFrame:
    """feature, baseline, changed: the hit rate of a probability, and with one column replaced by another at a time.

    probability: a function from a mapping of column names to columns, so one pass evaluates all variants.
    """
    base = {c: F.col(c) for c in columns}
    hits = lambda p: F.avg(((p >= 0.5).cast("int") == F.col(label)).cast("int"))
    s = rows.agg(hits(probability(base)).alias("_base"), *(hits(probability(base | {c: other[c]})).alias(c) for c in columns))
    return s.unpivot(["_base"], columns, "feature", "changed").select("feature", F.col("_base").alias("baseline"), "changed")


def correlated_features(rows: DataFrame, features: list[str], limit: float = 0.9) -> DataFrame:
    """dropped features, in the order of the list: those whose rank correlation with one kept before reaches the limit.

    The matrix of correlations (features squared numbers) comes from one aggregation; the greedy choice over it is
    the driver's.
    """
    wide = checkpointed(rows.select("symbol", "idx", *(F.col(f).cast("double").alias(f) for f in features)))
    long = wide.unpivot(["symbol", "idx"], features, "name", "value")
    ranks = mean_ranks(long, "name", "value", "rank").groupBy("symbol", "idx").agg(*(F.max(F.when(F.col("name") == f, F.col("rank"))).alias(f) for f in features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    rho = lambda a, b: F.abs(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    row = ranks.agg(*(rho(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs))).first()
    strong = {p: (row[f"p{k}"] or 0.0) >= limit for k, p in enumerate(pairs)}
    dropped: list[str] = []
    for a, b in pairs:
        if a not in dropped and b not in dropped and strong[a, b]:
            dropped.append(b)
    return rows.sparkSession.createDataFrame([(d,) for d in sorted(dropped)], "feature string")


def walk_forward_folds(counts: DataFrame, folds: int, purge: int) -> DataFrame:
    """symbol, fold, train rows [0, train_end), predicted rows [start, stop); the first fold has no past and no row."""
    size = F.greatest(F.floor(F.col("n") / folds), F.lit(1))
    rows = counts.select("symbol", "n", F.explode(F.sequence(F.lit(1), F.lit(folds - 1))).alias("fold"))
    start = F.least(F.col("n"), F.col("fold") * size)
    stop = F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(F.least(F.col("n"), start + size))
    return rows.select("symbol", "fold", F.greatest(start - purge, F.lit(0)).alias("train_end"), start.alias("start"), stop.alias("stop")).where("start < stop")


def paid_in(trades: DataFrame, events: DataFrame, bucket: int = 64) -> DataFrame:
    """trades (symbol, entry_idx, exit_idx, side, ...) with paid: minus side times the sum of the rates (symbol, at,
    rate) of events in (entry, exit].

    A range join by buckets of time: a trade goes to each bucket it covers, an event to its own.
    """
    cut = lambda c: F.floor(F.col(c) / bucket)
    spread = trades.select("symbol", "entry_idx", "exit_idx", F.explode(F.sequence(cut("entry_idx"), cut("exit_idx"))).alias("b"))
    found = spread.join(events.select("symbol", "at", "rate", cut("at").alias("b")), ["symbol", "b"]).where("at > entry_idx AND at <= exit_idx")
    sums = found.groupBy("symbol", "entry_idx", "exit_idx").agg(F.sum("rate").alias("_r"))
    joined = trades.join(sums, ["symbol", "entry_idx", "exit_idx"], "left")
    return joined.withColumn("paid", F.coalesce(-F.col("side") * F.col("_r"), F.lit(0.0))).drop("_r")


def in_time(rows: DataFrame, column: str, start: str | None, end: str | None, end_included: bool = False) -> DataFrame:
    """rows from start up to an end; an end that is a mere date means that whole day either way."""
    if start:
        rows = rows.where(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end:
        until = F.to_timestamp(F.lit(end))
        if len(end.strip()) == 10:
            return rows.where(F.col(column) < until + F.expr("INTERVAL 1 DAY"))
        return rows.where(F.col(column) <= until if end_included else F.col(column) < until)
    return rows


# Rows that features need before they hold, from the shortest to the weekly ones, and the rows beyond
# that make those count.
WARM_UPS = (1, 2, 4, 5, 6, 8, 10, 11, 12, 15, 16, 20, 21, 26, 30, 31, 35, 39, 60, 61, 65, 70, 75, 121, 150, 165, 225, 300, 600, 660, 900, 1200, 1440, 2400, 2640, 3600, 4800, 504_000)
WEEKLY_ROWS, WEEKLY_MARGIN = 504_000, 80


def warm_up(rows: int | None = None, needs: tuple[int, ...] = WARM_UPS) -> int:
    """The rows that the features of a series need; those that need more than it has do not count."""
    return max((n for n in needs if rows is None or n <= rows), default=1)


def warm_rows(timeline: DataFrame, needs: tuple[int, ...] = WARM_UPS) -> DataFrame:
    """symbol, idx, warming: whether a row comes before the last row of its symbol's warm-up."""
    n = timeline.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    known = F.array(*map(F.lit, needs))
    need = n.select("symbol", F.coalesce(F.array_max(F.filter(known, lambda x: x <= F.col("n"))), F.lit(1)).alias("need"))
    return with_row_per_key(timeline.select("symbol", "idx"), need, "symbol").select("symbol", "idx", (F.col("idx") < F.col("need") - 1).alias("warming"))


def after_weekly_warm_up(labels: DataFrame, timeline: DataFrame) -> DataFrame:
    """labels without the rows before a series' weekly features hold, where it is long enough to do without them."""
    n = timeline.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    long = with_row_per_key(labels, n, "symbol")
    return long.where((F.col("_n") < WEEKLY_ROWS + WEEKLY_MARGIN) | (F.col("idx") >= WEEKLY_ROWS)).drop("_n")


def without_fallbacks(features: list[str], fallbacks: set[str], least: int = 10) -> list[str]:
    """features whose source is there; all of them if fewer than least would remain."""
    kept = [f for f in features if f not in fallbacks]
    return kept if len(kept) >= least else list(features)
