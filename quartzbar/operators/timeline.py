"""The canonical one-minute timeline: validation, last-wins duplicates, gap repair, chunks with halos.

Work is never bound to one task per symbol. Gap repair needs only each bar's next bar: it is found inside the
day, and for a day's last bar from a table of first bars per day, which is bounded by the span of time.
Window features run per chunk of consecutive minutes with a halo of the minutes before (and after) it.

Defined results: bars that break the OHLCV predicate, have no symbol or no time are left out; missing volumes
count 0; of several bars of one minute the last delivered wins (then the largest id); a missing minute repeats
the last close with volumes 0; further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
VOLUMES = ("volume", "quote_volume", "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume")
#: Minutes of a chunk, and of the halo that covers the longest nested look-back of the window features.
CHUNK, HALO = 8192, 256
DAY = 1440


def ohlcv_ok() -> Column:
    """Finite values, prices above zero, volume not negative, low <= open, close <= high."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*PRICES, "volume")]
    ok = finite[0]
    for x in finite[1:]:
        ok = ok & x
    for c in PRICES:
        ok = ok & (F.col(c) > 0)
    for c in ("open", "close"):
        ok = ok & (F.col("low") <= F.col(c)) & (F.col(c) <= F.col("high"))
    return ok & (F.col("volume") >= 0)


def validation_counts(bars: DataFrame) -> DataFrame:
    """One row: how many rows there are, how many break which rule."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    absent = lambda *cs: F.expr(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in cs))
    return bars.select(*PRICES, "volume").agg(
        F.count(F.lit(1)).alias("rows"),
        n(ohlcv_ok()).alias("valid"),
        n(absent(*PRICES, "volume")).alias("not_finite"),
        n(F.expr("least(open, high, low, close) <= 0")).alias("not_positive"),
        n(F.col("volume") < 0).alias("negative_volume"),
        n(F.expr("NOT isnan(close) AND (low > least(open, close) OR high < greatest(open, close))")).alias("not_ordered"),
    )


def valid_bars(bars: DataFrame) -> DataFrame:
    """symbol, day, m (days and minutes since 1970), prices and volumes: one valid bar per symbol and minute.

    Rows are shuffled once, by symbol and day; what needs a minute, a day or its neighbours finds them there.
    """
    picked = _valid(bars).select(
        "symbol", "m",
        F.struct(
            F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-1)).alias("came"),
            F.coalesce("bar_id", F.lit(-1)).alias("id"),
            *PRICES,
            *(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in VOLUMES),
        ).alias("b"),
    )
    placed = picked.withColumn("day", F.floor(F.col("m") / DAY)).repartition("symbol", "day")
    # The greatest struct is the last delivered.
    return placed.groupBy("symbol", "day", "m").agg(F.max("b").alias("b")).select("symbol", "day", "m", *(f"b.{c}" for c in (*PRICES, *VOLUMES)))


def _valid(bars: DataFrame) -> DataFrame:
    t = F.unix_micros(F.col("open_time").cast("timestamp"))
    ok = bars.where(ohlcv_ok() & F.col("symbol").isNotNull() & F.col("open_time").isNotNull())
    return ok.withColumn("m", F.floor((t + 30_000_000) / 60_000_000))


def first_minutes(bars: DataFrame) -> DataFrame:
    """symbol, day, first: the first valid minute of each day; folded where the bars are read, so a row per day is shuffled."""
    return _valid(bars).groupBy("symbol", F.floor(F.col("m") / DAY).alias("day")).agg(F.min("m").alias("first"))


def spans(bars: DataFrame) -> DataFrame:
    """symbol, lo, hi: the first and last valid minute of each symbol."""
    return _valid(bars).groupBy("symbol").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))


def canonical(valid: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """Dense minutes per symbol: idx, m, prices, volumes, gap_flag, gap_length, repaired.

    firsts: the first minute of each symbol and day, where it can be had more cheaply than from the valid bars.
    """
    v = valid if "day" in valid.columns else valid.withColumn("day", F.floor(F.col("m") / DAY))
    if firsts is None:
        firsts = v.groupBy("symbol", "day").agg(F.min("m").alias("first"))
    by_symbol = Window.partitionBy("symbol").orderBy("day")
    days = firsts.select(
        "symbol", "day", F.lead("first").over(by_symbol).alias("next_first"),
        F.first("first").over(by_symbol.rowsBetween(Window.unboundedPreceding, 0)).alias("lo"),
    )
    in_day = Window.partitionBy("symbol", "day").orderBy("m")
    filled = (
        v.join(days, ["symbol", "day"])
        .withColumn("following", F.coalesce(F.lead("m").over(in_day), F.col("next_first")))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("following") - F.col("m") - 1, F.lit(0)).cast("int"))))
        .withColumn("repaired", F.col("k") > 0)
    )
    return filled.select(
        "symbol", (F.col("m") + F.col("k") - F.col("lo")).alias("idx"), (F.col("m") + F.col("k")).alias("m"),
        *(F.when(F.col("repaired"), F.col("close")).otherwise(F.col(c)).alias(c) for c in PRICES),
        *(F.when(F.col("repaired"), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in VOLUMES),
        F.col("repaired").cast("int").alias("gap_flag"), F.col("k").cast("int").alias("gap_length"), "repaired",
    )


def in_chunks(rows: DataFrame, before: int = HALO, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Adds chunk and core: each row in its own chunk, and in the neighbours whose halo it is in."""
    assert 0 <= before <= size and 0 <= after <= size
    own, at = F.floor(F.col("idx") / size), F.col("idx") % size
    others = []
    if before:
        others.append(F.when(at >= size - before, own + 1))
    if after:
        others.append(F.when((at < after) & (own > 0), own - 1))
    return rows.withColumn("chunk", F.explode(F.array_compact(F.array(own, *others)))).withColumn("core", F.floor(F.col("idx") / size) == F.col("chunk"))


def gap_summary(timeline: DataFrame) -> DataFrame:
    """Per symbol: minutes, repaired minutes, their ratio, the longest run of repaired minutes."""
    return timeline.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("minutes"), F.sum("gap_flag").alias("repaired_minutes"),
        F.round(F.avg("gap_flag"), 6).alias("gap_ratio"), F.max("gap_length").alias("longest_run"),
    )


def missing_days(valid: DataFrame) -> DataFrame:
    """Days between a symbol's first and last bar that have no bar."""
    days = valid.select("symbol", F.floor(F.col("m") / DAY).alias("day")).distinct()
    span = days.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(days, ["symbol", "day"], "left_anti")
