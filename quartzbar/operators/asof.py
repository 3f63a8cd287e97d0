"""Backward and nearest as-of joins, prefix sums, exact ranks and percentiles without one task per entity.

All work in blocks and carry what a block needs from those before it (or after it) through a table of one row
per block. Blocks are spans of time or ranges of values, whatever share of the rows an entity has.

Defined results: rows without entity or time match nothing and ranks leave null and NaN values out; of right
rows of one time the last by ``tie`` counts; ties have their mean rank; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.session import checkpointed


def asof_backward(left: DataFrame, right: DataFrame, value: list[str], block: int, tie: list[str] | None = None) -> DataFrame:
    """left (entity, t, ...) with the value columns of the latest right row (entity, t, ...) at or before t.

    block: length of a block in units of t.
    """
    struct = F.struct("t", *(tie or []), F.struct(*value).alias("v"))
    kept = [c for c in left.columns if c not in ("entity", "t")]
    ls = left.select("entity", "t", F.lit(1).alias("is_left"), F.struct(*kept).alias("row"), F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType).alias("mine"))
    rs = right.where("entity IS NOT NULL AND t IS NOT NULL").select("entity", "t", F.lit(0).alias("is_left"), F.lit(None).cast(ls.schema["row"].dataType).alias("row"), struct.alias("mine"))
    rows = ls.unionByName(rs).withColumn("block", F.floor(F.col("t") / block))
    blocks = rows.groupBy("entity", "block").agg(F.max("mine").alias("last"))
    earlier = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("entity", "block", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    inside = Window.partitionBy("entity", "block").orderBy("t", "is_left", "mine").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("here", F.last("mine", ignorenulls=True).over(inside)).where("is_left = 1")
    joined = found.join(carried, (found.entity.eqNullSafe(carried.entity)) & (found.block.eqNullSafe(carried.block)), "left")
    best = F.coalesce(found.here, carried.carry)
    return joined.select(found.entity, found.t, *(found.row[c].alias(c) for c in kept), *(best["v"][c].alias(c) for c in value))


def asof_nearest(left: DataFrame, right: DataFrame, value: list[str], block: int, tie: list[str] | None = None) -> DataFrame:
    """left (entity, t, ...) with the value columns of the right row (entity, t, ...) nearest in time; at equal distance the earlier.

    Of right rows of one time the last by ``tie`` counts.
    """
    mine = F.struct(F.struct(*(tie or []), F.lit(0).alias("_")).alias("k"), F.struct(*value).alias("v"))
    rs = right.where("entity IS NOT NULL AND t IS NOT NULL").groupBy("entity", "t").agg(F.max_by(mine["v"], mine["k"]).alias("v"))
    kept = [c for c in left.columns if c not in ("entity", "t")]
    ls = left.select("entity", "t", F.lit(1).alias("is_left"), F.struct(*kept).alias("row"), F.lit(None).cast(rs.select(F.struct("t", "v").alias("s")).schema["s"].dataType).alias("mine"))
    rs = rs.select("entity", "t", F.lit(0).alias("is_left"), F.lit(None).cast(ls.schema["row"].dataType).alias("row"), F.struct("t", "v").alias("mine"))
    rows = ls.unionByName(rs).withColumn("block", F.floor(F.col("t") / block))
    blocks = rows.groupBy("entity", "block").agg(F.max_by("mine", F.when(F.col("mine").isNotNull(), F.col("t"))).alias("last"), F.min_by("mine", F.when(F.col("mine").isNotNull(), F.col("t"))).alias("first"))
    order = "PARTITION BY entity ORDER BY block"
    carried = blocks.select("entity", "block", F.expr(f"lag(last) IGNORE NULLS OVER ({order})").alias("back"), F.expr(f"lead(first) IGNORE NULLS OVER ({order})").alias("ahead"))
    inside = "PARTITION BY entity, block ORDER BY t, is_left"
    found = rows.withColumns({"p": F.expr(f"lag(mine) IGNORE NULLS OVER ({inside})"), "n": F.expr(f"lead(mine) IGNORE NULLS OVER ({inside})")}).where("is_left = 1")
    joined = found.join(carried, found.entity.eqNullSafe(carried.entity) & found.block.eqNullSafe(carried.block), "left")
    p, n = F.coalesce(found.p, carried.back), F.coalesce(found.n, carried.ahead)
    best = F.when(p["t"].isNull() | (n["t"] - found.t < found.t - p["t"]), n).otherwise(p)
    return joined.select(found.entity, found.t, *(found.row[c].alias(c) for c in kept), *(best["v"][c].alias(c) for c in value))


def prefix_sums(rows: DataFrame, key: str, order: str, sums: dict[str, Column], size: int) -> DataFrame:
    """rows with running sums up to and including each row, in the order of a number column."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / size)).withColumns({f"_{n}": c for n, c in sums.items()})
    blocks = rows.groupBy(key, "_block").agg(*(F.sum(f"_{n}").alias(f"_s_{n}") for n in sums))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(key, "_block", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, [key, "_block"])
    out = out.withColumns({n: F.sum(f"_{n}").over(inside) + F.col(f"_c_{n}") for n in sums})
    return out.drop("_block", *(f"_{n}" for n in sums), *(f"_c_{n}" for n in sums))


def _ordered_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, _n (rows of that value), _upto (rows up to and including it) of the known values.

    Equal values are folded before anything is shuffled, so a value that most rows have is one row. The folded
    values are cut into ranges by the engine's own sampling, as many as the session has shuffle partitions; what
    a range needs of those before it comes from one row per range and key.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = rows.where(ok).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    # The ranges are read twice and must be the same both times.
    counts = checkpointed(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    sums = counts.groupBy(key, "_part").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_below"), F.sum("_s").over(Window.partitionBy(key)).alias("_all"))
    inside = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(offsets, [key, "_part"]).withColumn("_upto", F.col("_below") + F.sum("_n").over(inside)).drop("_part", "_below")


def mean_ranks(rows: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """rows with the mean rank (1 is least) of a value within its key; null where the value is null or NaN.

    Rows meet the ranks of their values in a join, whose hot values the adaptive skew join splits.
    """
    ranks = _ordered_counts(rows, key, value).select(key, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(rank))
    return rows.join(ranks, [key, value], "left").select(*rows.columns, rank)


def percentiles(rows: DataFrame, key: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """key and exact percentiles (linear between neighbours): wanted gives name -> (column, share). All columns are ordered in one pass."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x"))
    placed = _ordered_counts(long.select(F.struct(F.col(key).alias("k"), "x.i").alias("_key"), F.col("x.v").alias("_v")), "_key", "_v")
    at = lambda p: F.lit(p) * (F.col("_all") - 1)
    picks = []
    for name, (column, p) in wanted.items():
        mine = F.col("_key.i") == columns.index(column)
        holds = lambda k: mine & (F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k)  # noqa: B023, E731
        lo, hi = F.floor(at(p)), F.ceil(at(p))
        picks += [F.max(F.when(holds(lo), F.col("_v"))).alias(f"_lo_{name}"), F.max(F.when(holds(hi), F.col("_v"))).alias(f"_hi_{name}"), F.max(F.when(mine, at(p) - lo)).alias(f"_w_{name}")]
    out = placed.groupBy(F.col("_key.k").alias(key)).agg(*picks)
    return out.select(key, *(F.expr(f"_lo_{n} + (_hi_{n} - _lo_{n}) * _w_{n}").alias(n) for n in wanted))
