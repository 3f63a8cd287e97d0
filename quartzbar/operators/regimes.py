"""Regimes of the market: strength and direction by thresholds, with hysteresis; their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import percentiles
from quartzbar.operators.scan import Machine, scan, transition_table
from quartzbar.operators.timeline import CHUNK
from quartzbar.session import checkpointed, with_row_per_key

STRENGTHS = ("ranging", "trending", "high_volatility")
DIRECTIONS = ("range", "up", "down")
# Percentiles of the thresholds, the least slope that is a trend, the run that makes a switch.
RV_PERCENTILE, TREND_PERCENTILE, DIRECTION_PERCENTILE = 0.75, 0.90, 0.55
LEAST_TREND, SWITCH_AFTER = 1e-5, 3
# The least mean probability that counts, the run of rows after which it makes a switch.
CONFIDENCE, PERSISTENCE = 0.45, 60


def fit_thresholds(rows: DataFrame) -> DataFrame:
    """symbol, rv, trend, direction thresholds from rows (symbol, rv_15, trend_slope_30)."""
    both = rows.select("symbol", "rv_15", F.abs("trend_slope_30").alias("_s"))
    fit = percentiles(both, "symbol", {"rv": ("rv_15", RV_PERCENTILE), "trend": ("_s", TREND_PERCENTILE), "direction": ("_s", DIRECTION_PERCENTILE)})
    return fit.select("symbol", "rv", *(F.greatest(c, F.lit(LEAST_TREND)).alias(c) for c in ("trend", "direction")))


def strength_code() -> Column:
    """0 ranging, 1 trending, 2 high volatility, from rv_15, trend_slope_30, rv, trend."""
    return F.when(F.col("rv_15") > F.col("rv"), 2).when(F.abs("trend_slope_30") > F.col("trend"), 1).otherwise(0)


def direction_code() -> Column:
    """0 range, 1 up, 2 down, from trend_slope_30, direction."""
    slope, bar = F.col("trend_slope_30"), F.col("direction")
    return F.when(slope > bar, 1).when(slope < -bar, 2).otherwise(0)


def hysteresis(codes: int, after: int = SWITCH_AFTER):
    """(table, states): the stable code changes once another came ``after`` times in a row; the first row sets it."""

    def step(state, code):
        if state is None:
            return (code, None, 0)
        stable, candidate, count = state
        if code == stable:
            return (stable, None, 0)
        count = count + 1 if code == candidate else 1
        return (code, None, 0) if count >= after else (stable, code, count)

    return transition_table(codes, None, step)


def with_regimes(rows: DataFrame) -> DataFrame:
    """symbol, idx, strength, direction: stable regimes from rows (symbol, idx, rv_15, trend_slope_30)."""
    rows = checkpointed(rows.select("symbol", "idx", "rv_15", "trend_slope_30"))
    coded = with_row_per_key(rows, fit_thresholds(rows), "symbol").select("symbol", "idx", strength_code().alias("s"), direction_code().alias("d"))
    table, states = hysteresis(3)
    shown = lambda names: [names[s[0]] if s else "" for s in states]
    return scan(coded, [Machine("s", table, shown(STRENGTHS), "strength"), Machine("d", table, shown(DIRECTIONS), "direction")])


def diagnostics(rows: DataFrame, label: str) -> DataFrame:
    """Per symbol and label: rows, entries (runs), longest run. Runs are cut nowhere: blocks are joined by their ends."""
    blocked = rows.withColumn("chunk", F.floor(F.col("idx") / CHUNK))
    inside = Window.partitionBy("symbol", "chunk").orderBy("idx")
    edge = F.coalesce((F.lag(label).over(inside) != F.col(label)).cast("int"), F.lit(1))
    numbered = blocked.withColumn("_e", edge).withColumn("_run", F.sum("_e").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("symbol", "chunk", "_run", label).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("a"))
    # Only a chunk's first and last run can go on in its neighbours: two rows per chunk are looked at in order.
    ends = Window.partitionBy("symbol", "chunk")
    runs = runs.withColumn("_edge", (F.col("_run") == F.min("_run").over(ends)) | (F.col("_run") == F.max("_run").over(ends)))
    ordered = Window.partitionBy("symbol").orderBy("a")
    goes_on = (F.lag(label).over(ordered) == F.col(label)) & (F.lag(F.col("a") + F.col("n")).over(ordered) == F.col("a"))
    edges = runs.where("_edge").withColumn("_new", F.when(goes_on, 0).otherwise(1))
    edges = edges.withColumn("_g", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy("symbol", "_g", label).agg(F.sum("n").alias("n")).select("symbol", label, "n")
    every = whole.unionByName(runs.where("NOT _edge").select("symbol", label, "n"))
    return every.groupBy("symbol", label).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entries"), F.max("n").alias("longest_run"))


def smoothed(rows: DataFrame, names: list[str], n: int = 30) -> DataFrame:
    """Means of probabilities over at most n rows, and the name of the greatest (ties: the first name)."""
    from quartzbar.operators.timeline import in_chunks

    w = Window.partitionBy("symbol", "chunk").orderBy("idx").rowsBetween(-(n - 1), 0)
    out = in_chunks(rows).withColumns({f"{x}_smooth": F.avg(x).over(w) for x in names})
    best = F.greatest(*(F.col(f"{x}_smooth") for x in names))
    pick = F.lit(None).cast("string")
    for x in reversed(names):
        pick = F.when(F.col(f"{x}_smooth") == best, x).otherwise(pick)
    return out.withColumn("smoothed", pick).where("core").drop("core", "chunk")


def persistence(codes: int, start: int, after: int = PERSISTENCE):
    """(table, states) over codes 2 * candidate + confident; states (current, pending, count).

    The first row's candidate holds at once if confident, else start; later another one must be confident
    and the same for ``after`` rows in a row.
    """

    def step(state, code):
        candidate, confident = code // 2, code % 2
        if state is None:
            return (candidate if confident else start, None, 0)
        current, pending, count = state
        if candidate == current or not confident:
            return (current, None, 0)
        count = count + 1 if candidate == pending else 1
        return (candidate, None, 0) if count >= after else (current, candidate, count)

    return transition_table(2 * codes, None, step)


def assigned(rows: DataFrame, names: list[str], unsure: str, n: int = 30, confidence: float = CONFIDENCE, after: int = PERSISTENCE) -> DataFrame:
    """The rows of ``smoothed`` with the regime assigned to each: the greatest mean, if confident and persistent.

    Rows without any probability are not confident.
    """
    means = smoothed(rows, names, n)
    best = F.greatest(*(F.col(f"{x}_smooth") for x in names))
    candidate = F.array_position(F.array(*map(F.lit, names)), F.col("smoothed")) - 1
    means = means.withColumn("_code", F.coalesce(2 * candidate + (best >= confidence).cast("int"), F.lit(0)).cast("int"))
    means = checkpointed(means)
    table, states = persistence(len(names), names.index(unsure), after)
    shown = [names[s[0]] if s else "" for s in states]
    return means.drop("_code").join(scan(means, [Machine("_code", table, shown, "assigned")]), ["symbol", "idx"])


def transitions(rows: DataFrame, label: str) -> DataFrame:
    """symbol, before, after, n: changes of a label from one row to the next of dense rows (symbol, idx)."""
    from quartzbar.operators.timeline import in_chunks

    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    steps = in_chunks(rows.select("symbol", "idx", label), before=1).withColumn("before", F.lag(label).over(w))
    changed = steps.where(F.col("core") & (F.col("before") != F.col(label)))
    return changed.groupBy("symbol", "before", F.col(label).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def jitter(rows: DataFrame, label: str, window: int = 10, most: int = 3) -> DataFrame:
    """symbol, idx, changes of dense rows where a label changed more often than ``most`` within the last ``window`` rows."""
    from quartzbar.operators.timeline import in_chunks

    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    steps = in_chunks(rows.select("symbol", "idx", label), before=window + 1).withColumn("c", F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0)))
    steps = steps.withColumn("changes", F.sum("c").over(w.rowsBetween(-(window - 1), 0)))
    return steps.where(F.col("core") & (F.col("changes") > most)).select("symbol", "idx", "changes")


#: The sides that may be held in each direction regime, with the target of each.
SIDES = {"up": (("long", "long_success"),), "down": (("short", "short_success"),), "range": (("long", "long_success"), ("short", "short_success"))}


def by_policy(rows: DataFrame, regime: str) -> DataFrame:
    """rows (long_success, short_success, ...) once for each side that their regime admits, with side and target; unknown regimes are refused."""
    side = lambda name: F.array(*(F.struct(F.lit(s).alias("side"), F.col(t).alias("target")) for s, t in SIDES[name]))
    choice = F.raise_error(F.concat(F.lit("no policy for regime "), F.coalesce(F.col(regime), F.lit("null")))).cast("array<struct<side:string,target:int>>")
    for name in SIDES:
        choice = F.when(F.col(regime) == name, side(name)).otherwise(choice)
    return rows.withColumn("_s", F.explode(choice)).select(*rows.columns, F.col("_s.side").alias("side"), F.col("_s.target").alias("target"))


def holdouts(rows: DataFrame, regime: str, horizon: int) -> DataFrame:
    """symbol, regime, n, train_end, holdout_start, viable: the first four fifths of a regime's rows, a gap, the rest."""
    n = rows.groupBy("symbol", F.col(regime).alias("regime")).agg(F.count(F.lit(1)).alias("n"))
    split = F.greatest(F.lit(1), F.floor(F.col("n") * 0.8)).cast("long")
    s = n.withColumn("train_end", split)
    gap = F.least(F.lit(max(0, horizon)), F.greatest(F.lit(0), F.floor((F.col("n") - F.col("train_end")) / 4)))
    s = s.withColumn("holdout_start", (F.col("train_end") + gap).cast("long"))
    return s.withColumn("viable", (F.col("holdout_start") < F.col("n") - 10) & (F.col("train_end") >= 10))


# The share of the volatility threshold up to which a slope is a trend; weekly slope and drawdown of a
# strong trend, the deep drawdown, the contraction that ends a trend.
CALM, STRONG_SLOPE, SHALLOW, DEEP, CONTRACTED = 1.0, 0.02, -0.05, -0.20, 0.5


def weekly_strength() -> Column:
    """The strength regime from rv_15, trend_slope_30, rv, trend and the weekly features, high volatility first."""
    high = F.col("rv_15") > F.col("rv")
    slope, slope50, fall = F.col("weekly_ma20_slope_closed"), F.col("weekly_ma50_slope_closed"), F.col("weekly_drawdown")
    strong = (F.abs(slope) > STRONG_SLOPE) & (fall > SHALLOW)
    crossed = (F.col("weekly_ma20_above_ma50") > 0.5) & (slope > 0) & (slope50 > 0) & (fall > SHALLOW)
    trend = ((F.abs("trend_slope_30") > F.col("trend")) & (F.col("rv_15") <= F.col("rv") * CALM)) | strong | crossed
    high = high | (fall < DEEP)
    trend = trend & ~(fall < DEEP) & ~((F.col("weekly_vol_contraction") < CONTRACTED) & ~high)
    return F.when(high, "high_volatility").when(trend, "trending").otherwise("ranging")


def with_weekly_strength(rows: DataFrame) -> DataFrame:
    """symbol, idx, strength of each row by itself, from rows (symbol, idx, rv_15, trend_slope_30, weekly features)."""
    rows = checkpointed(rows)
    return with_row_per_key(rows, fit_thresholds(rows), "symbol").select("symbol", "idx", weekly_strength().alias("strength"))


def expanding_strength(rows: DataFrame) -> DataFrame:
    """symbol, idx, strength of each row by itself, by thresholds fitted to the rows up to it, from rows (symbol, idx, rv_15, trend_slope_30)."""
    from quartzbar.operators.expanding import expanding_percentiles

    rows = checkpointed(rows.select("symbol", "idx", "rv_15", "trend_slope_30"))
    rv = expanding_percentiles(rows, "symbol", "rv_15", {"rv": RV_PERCENTILE})
    trend = expanding_percentiles(rows.withColumn("_s", F.abs("trend_slope_30")), "symbol", "_s", {"trend": TREND_PERCENTILE})
    j = rows.join(rv, ["symbol", "idx"]).join(trend, ["symbol", "idx"]).withColumn("trend", F.greatest("trend", F.lit(LEAST_TREND)))
    steep = (F.abs("trend_slope_30") > F.col("trend")) & (F.col("rv_15") <= F.col("rv") * CALM)
    return j.select("symbol", "idx", F.when(F.col("rv_15") > F.col("rv"), "high_volatility").when(steep, "trending").otherwise("ranging").alias("strength"))
