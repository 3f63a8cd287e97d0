"""Samples with label intervals: uniqueness weights, purged walk-forward and combinatorial purged splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import prefix_sums
from quartzbar.session import checkpointed, with_row_per_key

BLOCK = 8192


def uniqueness_weights(samples: DataFrame) -> DataFrame:
    """samples (symbol, start, end) with weight: the mean over the interval of one by the number of samples there."""
    steps = samples.select("symbol", F.col("start").alias("idx"), F.lit(1).alias("d")).unionByName(
        samples.select("symbol", (F.col("end") + 1).alias("idx"), F.lit(-1).alias("d"))
    )
    # Sums and neighbours read the steps several times; they are few beside what made the samples.
    steps = checkpointed(steps.groupBy("symbol", "idx").agg(F.sum("d").alias("d")))
    running = prefix_sums(steps, "symbol", "idx", {"concurrency": F.col("d")}, BLOCK)
    # Between two steps the concurrency stays: the integral of its inverse needs the steps only.
    lengths = _following(checkpointed(running), "symbol", "idx")
    inverse = lengths.withColumn("area", F.when(F.col("concurrency") > 0, (F.coalesce("following", "idx") - F.col("idx")) / F.col("concurrency")).otherwise(0.0))
    total = prefix_sums(inverse, "symbol", "idx", {"upto": F.col("area")}, BLOCK)
    at = total.select("symbol", "idx", (F.col("upto") - F.col("area")).alias("integral"))
    out = samples.join(at.select("symbol", F.col("idx").alias("start"), F.col("integral").alias("a")), ["symbol", "start"])
    out = out.join(at.select("symbol", (F.col("idx") - 1).alias("end"), F.col("integral").alias("b")), ["symbol", "end"])
    return out.withColumn("weight", (F.col("b") - F.col("a")) / (F.col("end") - F.col("start") + 1)).drop("a", "b")


def _following(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the next row's order value; across blocks by a table of first values."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    firsts = rows.groupBy(key, "_block").agg(F.min(order).alias("_first"))
    firsts = firsts.select(key, "_block", F.lead("_first").over(Window.partitionBy(key).orderBy("_block")).alias("_next"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    joined = rows.join(firsts, [key, "_block"])
    return joined.withColumn("following", F.coalesce(F.lead(order).over(inside), F.col("_next"))).drop("_block", "_next")


def sample_numbers(samples: DataFrame) -> DataFrame:
    """samples with k (0, 1, ... per symbol by start) and n (how many there are); both come from one row per block."""
    rows = samples.withColumn("_block", F.floor(F.col("start") / BLOCK))
    blocks = rows.groupBy("symbol", "_block").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("symbol")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("symbol", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    inside = Window.partitionBy("symbol", "_block").orderBy("start")
    out = rows.join(blocks, ["symbol", "_block"]).withColumn("k", F.row_number().over(inside) - 1 + F.col("_before"))
    return out.drop("_block", "_before")


def sequential_groups(numbered: DataFrame, groups: int) -> DataFrame:
    """Adds grp: consecutive groups of equal size, the first ones larger by one where it does not come out even."""
    size, rest = F.floor(F.col("n") / groups), F.col("n") % groups
    large = (size + 1) * rest
    return numbered.withColumn(
        "grp", F.when(F.col("k") < large, F.floor(F.col("k") / (size + 1))).otherwise(rest + F.floor((F.col("k") - large) / F.greatest(size, F.lit(1))))
    )


def combinatorial_purged(samples: DataFrame, groups: int = 5, tested: int = 2, embargo: int = 0) -> DataFrame:
    """symbol, split, role (train, test, purged, embargoed), start, end of every sample in every split.

    Groups are consecutive, so a sample outside a group overlaps one of its samples exactly if it overlaps the
    span from the group's first start to its last end; the spans, a few per symbol, are all a row needs.
    """
    rows = checkpointed(sequential_groups(sample_numbers(samples), groups))
    spans = rows.groupBy("symbol", "grp").agg(F.struct(F.min("start").alias("a"), F.max("end").alias("b")).alias("s"))
    spans = spans.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("grp", "s"))).alias("spans"))
    splits = [list(c) for c in combinations(range(groups), tested)]
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("split"), F.array(*(F.lit(g).cast("long") for g in c)).alias("test")) for i, c in enumerate(splits))))
    rows = with_row_per_key(rows, spans, "symbol").withColumn("x", every)
    span = lambda g: F.col("spans")[g]
    touches = F.exists("x.test", lambda g: (F.col("start") <= span(g)["b"]) & (span(g)["a"] <= F.col("end")))
    after = F.exists("x.test", lambda g: (F.col("start") > span(g)["b"]) & (F.col("start") <= span(g)["b"] + embargo))
    role = F.when(F.array_contains("x.test", F.col("grp")), "test").when(touches, "purged").when(after & F.lit(embargo > 0), "embargoed").otherwise("train")
    return rows.select("symbol", F.col("x.split").alias("split"), role.alias("role"), "start", "end")


def walk_forward(counts: DataFrame, train: int, validation: int, test: int, purge: int) -> DataFrame:
    """symbol, split and the half-open row ranges of its three parts, from counts (symbol, n); test sizes apart."""
    whole = train + validation + test + 2 * purge
    last = F.floor((F.col("n") - whole) / test)
    rows = counts.where(F.col("n") >= whole).select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"))
    a = F.col("split") * test
    v = a + train + purge
    t = v + validation + purge
    return rows.select(
        "symbol", "split", a.alias("train_start"), (a + train).alias("train_end"), v.alias("validation_start"), (v + validation).alias("validation_end"),
        t.alias("test_start"), (t + test).alias("test_end"),
    )


def transition_weights(rows: DataFrame, label: str, window: int, weight: float = 0.1) -> DataFrame:
    """rows (symbol, idx, label) with a weight that is lower within window rows of a change of label."""
    w = Window.partitionBy("symbol", "chunk").orderBy("idx")
    from quartzbar.operators.timeline import in_chunks

    reach = in_chunks(rows, before=window + 1, after=window + 1)
    changed = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0))
    reach = reach.withColumn("_changed", changed)
    near = F.max("_changed").over(w.rowsBetween(-window, window))
    return reach.withColumn("weight", F.when(near == 1, weight).otherwise(1.0)).where("core").drop("core", "chunk", "_changed")
