"""Filling containers of fixed capacity with items, by hierarchical residual packing.

Every partition packs its own items best-fit in decreasing order and emits its bins. Bins that are nearly full
are final; of the others the partition hands on those that could still matter, as items of the size they hold:
any bin at most half full (best-fit leaves one at most) and the emptiest of the rest, as many as bins half
empty can come together in the next round. A tree of rounds merges them by best-fit, FAN_IN groups at a time,
until one group is left. So a task never holds more than its partition's sizes or FAN_IN * (KEEP + 1) bins,
however the sizes are spread, and no merge is lost: a round brings at most FAN_IN bins that others could take
in, and KEEP is not less.

Only an item above the capacity is divided: into full containers and a rest, which is packed like an item.

Defined results: null and empty texts have no tokens and go into the fullest bin of their partition; repeated
rows are items of their own; a limit whose capacity is not positive or null is refused; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.llm.tokenizers import FOLDER, counter
from quartzbar.session import checkpointed

FAN_IN, KEEP = 8, 16
#: A bin with no more unused space than this share of its capacity is final at once.
NEARLY_FULL = 0.002
COUNT_ROWS = 256


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of every item, fill of every bin): best-fit in decreasing order; sizes must not exceed the capacity."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with r free places exists
    where = [0] * len(sizes)
    fill: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i] = b
        fill[b] += size
        rooms[room - size].append(b)
        mask |= 1 << (room - size)
    return where, fill


def still_open(fill: list[int], capacity: int) -> set[int]:
    """The bins that later rounds may still use."""
    loose = [b for b, f in enumerate(fill) if capacity - f > NEARLY_FULL * capacity]
    half = [b for b in loose if 2 * fill[b] <= capacity]
    return set(half) | set(sorted((b for b in loose if 2 * fill[b] > capacity), key=lambda b: (fill[b], b))[:KEEP])


_OUT = pa.schema(
    [("limit_id", pa.int32()), ("bin", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start_token", pa.int64()),
     ("n_tokens", pa.int64()), ("part", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())]
)
_DDL = "limit_id int, bin long, doc_id long, piece long, start_token long, n_tokens long, part long, fill long, open boolean"
_BIN_DDL = "limit_id int, bin long, target long, fill long, part long, open boolean"


def pack(documents: DataFrame, limits: DataFrame, folder: str = FOLDER) -> DataFrame:
    """limit_id, container_id, doc_id, piece, start_token, n_tokens: the container of each document or piece.

    limits is a table of fixed size (a few rows: limit_id, tokenizer, capacity_tokens) and read by the driver.
    """
    wanted = [(r.limit_id, r.tokenizer, r.capacity_tokens) for r in limits.select("limit_id", "tokenizer", "capacity_tokens").collect()]
    if any(c is None or c <= 0 for _, _, c in wanted):
        raise ValueError("a capacity must be positive")
    capacities = {i: c for i, _, c in wanted}

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[int] = []
        sizes: dict[str, list[int]] = {t: [] for _, t, _ in wanted}
        for batch in batches:
            for k in range(0, batch.num_rows, COUNT_ROWS):
                rows = batch.slice(k, COUNT_ROWS)
                ids += rows.column(0).to_pylist()
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for t in sizes:
                    sizes[t] += counter(t, folder)(texts)
        for limit, tokenizer, capacity in wanted:
            whole = [divmod(n, capacity) if n > capacity else (0, n) for n in sizes[tokenizer]]
            # The rest of a divided document may be nothing.
            kept = [k for k, (full, rest) in enumerate(whole) if rest or not full]
            where, fill = best_fit([whole[k][1] for k in kept], capacity)
            opened = still_open(fill, capacity)
            at = part << 32
            out: dict[str, list] = {f.name: [] for f in _OUT}

            def add(b, k, piece, start, n, filled, is_open):
                for name, value in zip(_OUT.names, (limit, at + b, ids[k], piece, start, n, part, filled, is_open)):  # noqa: B023
                    out[name].append(value)  # noqa: B023

            for k, b in zip(kept, where):
                full, rest = whole[k]
                add(b, k, full, full * capacity, rest, fill[b], b in opened)
            spare = len(fill)
            for k, (full, _) in enumerate(whole):
                for piece in range(full):
                    add(spare, k, piece, piece * capacity, capacity, capacity, False)
                    spare += 1
            table = pa.table(out, schema=_OUT)
            yield from table.to_batches(max_chunksize=50_000)

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[int(p["limit_id"].iloc[0])]
        bins = p[["target", "fill"]].drop_duplicates("target").sort_values(["fill", "target"], ascending=[False, True])
        targets, fills = bins["target"].tolist(), bins["fill"].tolist()
        where, fill = best_fit(fills, capacity)
        first: dict[int, int] = {}
        for t, b in zip(targets, where):
            first.setdefault(b, t)
        opened = still_open(fill, capacity)
        b_of = dict(zip(targets, where))
        b = p["target"].map(b_of)
        return p.assign(target=b.map(first), fill=[fill[x] for x in b], open=[x in opened for x in b])[["limit_id", "bin", "target", "fill", "part", "open"]]

    packed = checkpointed(documents.select("doc_id", "text").mapInArrow(pack_partition, _DDL))
    bins = packed.where("open").groupBy("limit_id", "bin", "part").agg(F.max("fill").alias("fill"))
    active = bins.select("limit_id", "bin", F.col("bin").alias("target"), "fill", "part", F.lit(True).alias("open"))
    groups = (packed.agg(F.max("part")).first()[0] or 0) + 1
    done = None
    while groups > 1:
        groups = -(-groups // FAN_IN)
        merged = active.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("limit_id", "part").applyInPandas(merge, _BIN_DDL)
        merged = checkpointed(merged)
        closed = merged if groups == 1 else merged.where("NOT open")
        done = closed if done is None else done.unionByName(closed)
        active = merged.where("open")
    columns = ["limit_id", "container_id", "doc_id", "piece", "start_token", "n_tokens"]
    if done is None:
        return packed.withColumnRenamed("bin", "container_id").select(*columns)
    final = packed.where("NOT open").withColumnRenamed("bin", "container_id").select(*columns)
    moved = packed.where("open").join(done.select("limit_id", "bin", F.col("target").alias("container_id")), ["limit_id", "bin"])
    return final.unionByName(moved.select(*columns))


def packing_report(documents: DataFrame, limits: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Of each limit: containers, tokens, the least number of containers that could hold them, share unused."""
    packed = pack(documents, limits, folder)
    per = packed.groupBy("limit_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return per.join(limits.select("limit_id", "capacity_tokens"), "limit_id").select(
        "limit_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("tokens") / room).alias("unused_share"),
    )


def packing_faults(documents: DataFrame, limits: DataFrame, folder: str = FOLDER) -> DataFrame:
    """limit_id, documents, pieces beyond the first of a document that had to be divided, and how often a rule is broken:
    containers over their capacity, documents not whole, documents divided though they fit."""
    packed = checkpointed(pack(documents, limits, folder)).join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id")
    fills = packed.groupBy("limit_id", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("fill"))
    over = fills.groupBy("limit_id").agg(F.count(F.when(F.col("fill") > F.col("capacity_tokens"), 1)).alias("over_full"))
    docs = packed.groupBy("limit_id", "doc_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min("start_token").alias("start")
    )
    whole = (F.col("last") == F.col("n") - 1) & (F.col("tokens") == F.col("end")) & (F.col("start") == 0)
    kept = docs.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(~whole, 1)).alias("not_whole"), F.count(F.when((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens")), 1)).alias("divided_though_fitting")
    )
    return kept.join(over, "limit_id").select("limit_id", "documents", "over_full", "not_whole", "divided_though_fitting")
