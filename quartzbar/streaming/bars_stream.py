"""Streams of bars: closed klines, last-wins upserts, gap events, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quartzbar.sources.bar_files import parse_kline_messages

# How many missing minutes are a desync, and how many a gap that a timeout could cross.
DESYNC, CROSSING = 3, 2
#: Bars that a stream keeps per symbol.
KEPT = 500


def read_kline_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Closed bars of text files with one kline message per line, as they arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_kline_messages(lines, "value")


def gap_kind(missing: int) -> str:
    return "stream_desync" if missing >= DESYNC else "gap_cross_timeout" if missing == CROSSING else "gap"


_EVENT = "symbol string, minute long, missing long, kind string"


def gap_events(bars: DataFrame, silence_s: int = 0) -> DataFrame:
    """Events of missing minutes per symbol of a stream of bars (symbol, open_time).

    The state is the next minute expected; late and repeated bars never move it back. With silence_s > 0 a
    symbol that sends nothing for so long gives an event of kind silence.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (expected,) = state.get
            out.append((key[0], expected, 0, "silence"))
            state.remove()
        else:
            expected = state.get[0] if state.exists else None
            minutes = sorted({int(m) for b in batches for m in b["minute"]})
            for m in minutes:
                if expected is not None and m > expected:
                    out.append((key[0], expected, m - expected, gap_kind(m - expected)))
                expected = m + 1 if expected is None else max(expected, m + 1)
            state.update((expected,))
            if silence_s:
                state.setTimeoutDuration(silence_s * 1000)
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pd.DataFrame({"symbol": pd.Series(cols[0], dtype=object), "minute": pd.Series(cols[1], dtype="int64"), "missing": pd.Series(cols[2], dtype="int64"), "kind": pd.Series(cols[3], dtype=object)})

    minutes = bars.select("symbol", F.floor(F.unix_micros("open_time") / 60_000_000).alias("minute"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_s else GroupStateTimeout.NoTimeout
    return minutes.groupBy("symbol").applyInPandasWithState(run, _EVENT, "expected long", "append", timeout)


def batch_gap_events(valid: DataFrame) -> DataFrame:
    """The same events of bars at rest (symbol, m), in blocks of a day."""
    from quartzbar.operators.splits import _following

    j = _following(valid.select("symbol", "m").distinct(), "symbol", "m")
    missing = F.col("following") - F.col("m") - 1
    kind = F.when(missing >= DESYNC, "stream_desync").when(missing == CROSSING, "gap_cross_timeout").otherwise("gap")
    return j.where(missing > 0).select("symbol", (F.col("m") + 1).alias("minute"), missing.alias("missing"), kind.alias("kind"))


def unique_bars(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first delivery of every bar; state is bounded by the watermark."""
    return bars.withWatermark("open_time", late).dropDuplicatesWithinWatermark(["symbol", "open_time"])


def windowed_bars(bars: DataFrame, length: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of longer windows with their count, final once the watermark has passed."""
    w = bars.withWatermark("open_time", late).groupBy("symbol", F.window("open_time", length))
    b = w.agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return b.select("symbol", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume", "n")


_BAR = "symbol string, minute long, open double, high double, low double, close double, volume double"


def latest_bars(bars: DataFrame, kept: int = KEPT) -> DataFrame:
    """On every batch the rows that changed in a per-symbol buffer of the last bars: by time, the last write wins."""
    names = ["minute", "open", "high", "low", "close", "volume"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        fresh: dict = {}
        for b in batches:
            for row in b[names].itertuples(index=False, name=None):
                fresh[int(row[0])] = tuple(float(x) for x in row[1:])
        changed = {m: v for m, v in fresh.items() if held.get(m) != v}
        held = dict(sorted((held | fresh).items())[-kept:])
        state.update((list(held), *(list(c) for c in zip(*held.values()))))
        out = [(key[0], m, *v) for m, v in sorted(changed.items()) if m in held]
        cols = list(zip(*out)) or [()] * 7
        yield pd.DataFrame({n: pd.Series(c, dtype=object if n == "symbol" else "int64" if n == "minute" else "float64") for n, c in zip(["symbol", *names], cols)})

    rows = bars.select("symbol", F.floor(F.unix_micros("open_time") / 60_000_000).alias("minute"), "open", "high", "low", "close", "volume")
    held = "minutes array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"
    return rows.groupBy("symbol").applyInPandasWithState(run, _BAR, held, "update", GroupStateTimeout.NoTimeout)


# Thresholds of the built-in alerts.
ALERTS = {"desync": "kind = 'stream_desync'", "long_gap": "missing >= 10", "silence": "kind = 'silence'"}


def alerts(events: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """rule, symbol, minute of every event that a rule (name to condition) holds for; works on streams and tables."""
    rules = ALERTS if rules is None else rules
    hit = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in rules.items())))
    return events.select(F.explode(hit).alias("rule"), "symbol", "minute")
