"""Controls and small joins around predictions: shuffled labels, score bins, flips, detrending, zones of order blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import prefix_sums
from quartzbar.operators.scan import Machine, scan, transition_table
from quartzbar.operators.splits import sample_numbers
from quartzbar.operators.timeline import in_chunks
from quartzbar.session import checkpointed

#: Width of a block of hash values: 60 bits in 1024 blocks.
_HASH_BLOCK = 1 << 50


def shuffled(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """symbol, start and the column's values of the symbol's rows in an order drawn by a hash: a negative control.

    The k-th row by start takes the value of the k-th row by hash; both numberings work in blocks.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", "symbol", F.col("start").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    rows = checkpointed(rows.select("symbol", "start", column))
    placed = sample_numbers(rows).select("symbol", "k", "start")
    order = prefix_sums(rows.withColumn("_h", drawn), "symbol", "_h", {"upto": F.lit(1)}, _HASH_BLOCK)
    return placed.join(order.select("symbol", (F.col("upto") - 1).alias("k"), column), ["symbol", "k"]).select("symbol", "start", column)


def score_bins(scored: DataFrame, bins: int = 20) -> DataFrame:
    """bin, n, hit rate and its 95 % interval within [0, 1] (normal approximation) of predictions by equal bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    s = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return s.select("bin", "n", "rate", F.greatest(F.lit(0.0), F.col("rate") - half).alias("lower"), F.least(F.lit(1.0), F.col("rate") + half).alias("upper"))


def flip_rate(scored: DataFrame, threshold: float) -> DataFrame:
    """Per symbol from dense rows (symbol, idx, p): rows, crossings of the threshold, their share of the steps."""
    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    side = (F.col("p") >= threshold).cast("int")
    steps = in_chunks(scored.select("symbol", "idx", side.alias("side")), before=1).withColumn("flip", (F.lag("side").over(w) != F.col("side")).cast("int"))
    s = steps.where("core").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))
    return s.select("symbol", "rows", "flips", (F.col("flips") / F.greatest(F.col("rows") - 1, F.lit(1))).alias("rate"))


def detrended(timeline: DataFrame, n: int) -> DataFrame:
    """symbol, idx, level: the log of the close less its mean over the minutes of the last n that were read."""
    w = Window.partitionBy("symbol", "chunk").orderBy("idx").rowsBetween(-(n - 1), 0)
    x = F.log("close")
    rows = in_chunks(timeline.select("symbol", "idx", "close", "gap_flag")).withColumn("level", x - F.avg(F.when(F.col("gap_flag") == 0, x)).over(w))
    return rows.where("core").select("symbol", "idx", "level")


# The least body, the greatest wick (of the range), the least volume z-score and imbalance, rows
# between two blocks, rows after which a zone is forgotten.
BODY, WICK, LOUD, ONE_SIDED, SPACING, REACH = 0.6, 0.2, 1.0, 0.3, 5, 9


def order_blocks(rows: DataFrame) -> DataFrame:
    """symbol, idx, side, low, high of the order blocks of dense rows (symbol, idx, prices, volume_zscore_20, taker_imbalance).

    A block is a candle with a large body, small wicks, high volume and a one-sided flow, at least SPACING rows
    after the block before it, in order of time; its side is the candle's.
    """
    size = F.col("high") - F.col("low")
    part = lambda c: c / F.greatest(size, F.lit(1e-12))
    wick = F.greatest(part(F.col("high") - F.greatest("open", "close")), part(F.least("open", "close") - F.col("low")))
    fits = (
        (part(F.abs(F.col("close") - F.col("open"))) >= BODY) & (wick <= WICK) & (F.col("volume_zscore_20") >= LOUD)
        & (F.abs("taker_imbalance") >= ONE_SIDED) & (F.col("close") != F.col("open"))
    )
    side = F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish")
    flagged = checkpointed(rows.select("symbol", "idx", F.coalesce(fits.cast("int"), F.lit(0)).alias("fits"), side.alias("side"), "low", "high"))
    return spaced(flagged, "fits", SPACING).join(flagged.where("fits = 1").drop("fits"), ["symbol", "idx"])


def zone_entries(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """symbol, idx, block_idx, signal, confidence: of rows (symbol, idx, close, taker_imbalance) whose close is in the zone
    of a block (symbol, idx, side, low, high) of the last REACH rows or their own, the latest such block.

    All zones of a row have one score, so the latest wins. Blocks are few; each goes to the rows it can reach, so
    the range join is an equality join.
    """
    ahead = blocks.select("symbol", F.col("idx").alias("block_idx"), "side", F.col("low").alias("zl"), F.col("high").alias("zh"), F.explode(F.sequence(F.col("idx"), F.col("idx") + REACH)).alias("idx"))
    hit = ahead.join(rows.select("symbol", "idx", "close", "taker_imbalance"), ["symbol", "idx"]).where("close BETWEEN zl AND zh")
    best = hit.groupBy("symbol", "idx").agg(F.max(F.struct("block_idx", "side")).alias("b"), F.max(F.abs("taker_imbalance")).alias("pressure"))
    signal = F.when(F.col("b.side") == "bullish", "BUY").otherwise("SELL")
    return best.select("symbol", "idx", "b.block_idx", signal.alias("signal"), (F.least(F.lit(1.0), "pressure") * 0.8 + 0.2).alias("confidence"))


def spaced(rows: DataFrame, flag: str, least: int = 5) -> DataFrame:
    """symbol, idx of the flagged (1, else 0) of dense rows that are taken: each at least so many rows after the one taken before."""
    # The state is the number of rows since the last one taken, 0 to least.
    table, states = transition_table(2, least, lambda since, code: 0 if code and since + 1 >= least else min(since + 1, least))
    taken = scan(rows, [Machine(flag, table, ["taken" if since == 0 else "" for since in states], "_taken")])
    return taken.where("_taken = 'taken'").select("symbol", "idx")
