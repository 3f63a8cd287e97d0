"""Exact percentiles of every prefix of a series, in parallel.

The values of a key are cut into buckets of like size by their order. What a chunk of rows has before it is one
count per bucket. A first pass over the chunk, by buckets, finds the few buckets that a percentile of one of its
prefixes ever falls into; only of these the values before the chunk are fetched (folded to distinct values with
counts), and a second pass gives the percentiles exactly. So no task holds a key's history.

Defined results: rows without a finite value are left out; ties are one value; an empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.asof import _ordered_counts
from quartzbar.operators.timeline import CHUNK
from quartzbar.session import checkpointed

BUCKETS = 256


def walk(codes: list[int], counts: list[int], shares: list[float]) -> np.ndarray:
    """For each row and share the entries that the places below and above a percentile fall into, as rows join one by one.

    counts: rows of each entry (in order of value) before the first; codes: the entry of each row. [share, row, 2].
    """
    counts = list(counts)
    n = sum(counts)
    out = np.zeros((len(shares), len(codes), 2), dtype=np.int64)
    # Per share and side: the entry it stands at and the rows below that.
    at = [[0, 0] for _ in range(2 * len(shares))]
    for i, code in enumerate(codes):
        counts[code] += 1
        n += 1
        for s, share in enumerate(shares):
            place = share * (n - 1)
            for side, k in enumerate((math.floor(place), math.ceil(place))):
                here = at[2 * s + side]
                entry, below = here
                if code < entry:
                    below += 1
                while below > k:
                    entry -= 1
                    below -= counts[entry]
                while below + counts[entry] <= k:
                    below += counts[entry]
                    entry += 1
                here[0], here[1] = entry, below
                out[s, i, side] = entry
    return out


def expanding_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], size: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """key, idx and the percentiles (linear between neighbours) of the values of the key's rows (idx, value) up to each row."""
    names, wanted = list(shares), list(shares.values())
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("key"), F.col("idx").cast("long").alias("idx"), F.col(value).cast("double").alias("v"))
    known = checkpointed(known)
    order = _ordered_counts(known, "key", "v").select("key", "v", F.floor((F.col("_upto") - 1) * buckets / F.col("_all")).cast("int").alias("bucket"))
    placed = checkpointed(known.join(order, ["key", "v"]).withColumn("chunk", F.floor(F.col("idx") / size)))
    per_chunk = placed.groupBy("key", "chunk", "bucket").agg(F.count(F.lit(1)).alias("n"))
    chunks = placed.select("key", "chunk").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    before = Window.partitionBy("key", "bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.join(per_chunk, ["key", "chunk", "bucket"], "left").select("key", "chunk", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    carried = checkpointed(carried)

    def coarse(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        p, counts = p.sort_values("idx", kind="stable"), np.zeros(buckets, dtype=np.int64)
        if not len(p):
            return pd.DataFrame({"key": pd.Series([], dtype=object), "chunk": pd.Series([], dtype="int64"), "bucket": pd.Series([], dtype="int32")})
        counts[c["bucket"].to_numpy()] = c["n"].to_numpy()
        hit = np.unique(walk(p["bucket"].tolist(), counts.tolist(), wanted))
        return pd.DataFrame({"key": pd.Series([p["key"].iloc[0]] * len(hit), dtype=object), "chunk": p["chunk"].iloc[0], "bucket": hit.astype("int32")})

    # The two sides of a cogroup come from the same rows: the names of one are made anew.
    beside = lambda rows: rows.withColumnsRenamed({"key": "_key", "chunk": "_chunk"}).groupBy("_key", "_chunk")
    needed = checkpointed(placed.groupBy("key", "chunk").cogroup(beside(carried)).applyInPandas(coarse, "key string, chunk long, bucket int"))
    values = placed.groupBy("key", "bucket", F.col("chunk").alias("from"), "v").agg(F.count(F.lit(1)).alias("n"))
    earlier = needed.join(values, ["key", "bucket"]).where(F.col("from") < F.col("chunk")).groupBy("key", "chunk", "bucket", "v").agg(F.sum("n").alias("n"))
    # Buckets that are not needed stand as one entry each; the needed ones by their values (kind 1), which may have none yet.
    plain = carried.join(needed.withColumn("_n", F.lit(1)), ["key", "chunk", "bucket"], "left")
    extra = plain.select("key", "chunk", "bucket", F.when(F.col("_n").isNull(), 0).otherwise(2).alias("kind"), F.lit(None).cast("double").alias("v"), "n").unionByName(
        earlier.select("key", "chunk", "bucket", F.lit(1).alias("kind"), "v", "n")
    )
    schema = "key string, idx long, " + ", ".join(f"{n} double" for n in names)

    def fine(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx", kind="stable")
        if not len(p):
            return pd.DataFrame({"key": pd.Series([], dtype=object), "idx": pd.Series([], dtype="int64")} | {n: pd.Series([], dtype="float64") for n in names})
        expanded = set(c.loc[c["kind"] == 2, "bucket"].tolist())
        mine = p[p["bucket"].isin(expanded)]
        entries = pd.concat([c.loc[c["kind"] == 1, ["bucket", "v", "n"]], pd.DataFrame({"bucket": mine["bucket"], "v": mine["v"], "n": 0}), c.loc[c["kind"] == 0, ["bucket", "v", "n"]]])
        entries = entries.assign(v=entries["v"].fillna(0.0)).groupby(["bucket", "v"], sort=True, as_index=False)["n"].sum()
        b, v = entries["bucket"].to_numpy(), entries["v"].to_numpy()
        # A bucket's entries follow each other; in an expanded one the value finds its own.
        first, end = np.searchsorted(b, p["bucket"].to_numpy(), "left"), np.searchsorted(b, p["bucket"].to_numpy(), "right")
        codes = [int(lo + np.searchsorted(v[lo:hi], x)) if k in expanded else int(lo) for lo, hi, x, k in zip(first, end, p["v"], p["bucket"])]
        found = walk(codes, entries["n"].astype("int64").tolist(), wanted)
        n0 = int(entries["n"].sum())
        count = n0 + 1 + np.arange(len(p))
        out = {"key": p["key"].astype(object), "idx": p["idx"]}
        for s, name in enumerate(names):
            place = wanted[s] * (count - 1)
            lo, hi = v[found[s, :, 0]], v[found[s, :, 1]]
            out[name] = lo + (hi - lo) * (place - np.floor(place))
        return pd.DataFrame(out)

    got = placed.groupBy("key", "chunk").cogroup(beside(extra)).applyInPandas(fine, schema)
    return got.withColumnRenamed("key", key)
