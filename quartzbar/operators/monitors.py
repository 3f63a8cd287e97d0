"""What monitors ask for, and the order in which features can be computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Milliseconds of clock drift, ranks of the deleveraging queue, minutes before funding.
WARN_MS, BLOCK_MS, KILL_MS = 100, 500, 1000
REDUCE_RANK, BLOCK_RANK, KILL_RANK = 3, 4, 5
BLACKOUT_MIN = 5


def clock_action(drift_ms: Column) -> Column:
    drift = F.abs(drift_ms)
    return F.when(drift >= KILL_MS, "hard_kill").when(drift >= BLOCK_MS, "block_new_entries").when(drift >= WARN_MS, "warn_only").otherwise("allow")


def deleveraging_action(rank: Column) -> Column:
    """By the rank in the queue; without one 0."""
    known = F.coalesce(rank.cast("int"), F.lit(0))
    return F.when(known >= KILL_RANK, "hard_kill").when(known >= BLOCK_RANK, "block_new_entries").when(known >= REDUCE_RANK, "reduce_size").otherwise("allow")


def funding_action(minutes_to_next: Column, cost: Column, edge: Column) -> Column:
    """Blocked just before funding; a warning where its cost exceeds an edge that is known."""
    return F.when(minutes_to_next.between(0, BLACKOUT_MIN), "block_new_entries").when((edge != 0) & (F.abs(cost) > F.abs(edge)), "warn_only").otherwise("allow")


def calculation_order(dependencies: dict[str, list[str]]) -> tuple[bool, list[str]]:
    """(whether there is no cycle, names with each after those it needs); unknown names are ignored. Without recursion."""
    done: set[str] = set()
    open_: set[str] = set()
    order: list[str] = []
    acyclic = True
    for root in dependencies:
        stack = [(root, False)]
        while stack:
            name, left = stack.pop()
            if left:
                open_.discard(name)
                done.add(name)
                order.append(name)
            elif name in open_:
                acyclic = False
            elif name not in done:
                open_.add(name)
                stack.append((name, True))
                stack += [(d, False) for d in reversed(dependencies[name]) if d in dependencies and d not in done]
    return acyclic, order


def feature_parity(required: DataFrame, available: DataFrame) -> DataFrame:
    """feature, missing sources, status from required (feature, source) and available (source, live)."""
    j = required.join(available.where("live").select("source", F.lit(True).alias("there")), "source", "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("source"))))
    s = j.groupBy("feature").agg(missing.alias("missing"))
    return s.select("feature", "missing", F.when(F.size("missing") > 0, "fallback_unavailable_source").otherwise("available").alias("status"))
