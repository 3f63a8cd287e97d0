"""Pairing records of two tables by nearest time within a tolerance.

Both tables are united, sorted per entity and time, and the last and the next right-side record are carried
onto each left row; the nearer within the tolerance is taken. The sort, one for both directions, runs per
entity and time bucket, and a right row is also handed to the neighbouring bucket if it lies within the
tolerance of the border, so that an entity with a third of all rows is spread over as many tasks as it has
buckets.

Defined results: rows without entity or time match nothing and are matched by nothing; at equal distance the
earlier time wins, at equal times the smaller id; repeated left rows each get their match; further columns of
the inputs are ignored; an empty side gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.functions.instants import iso_us
from quartzbar.functions.keys import entity_key, epoch_us

BUCKET_US = 3_600_000_000


def match_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """left: left_id, entity, t; right: right_id, entity, t (t in microseconds).

    Returns left_id, right_id, distance_us: the nearest right row of each left row that has one.
    """
    assert bucket_us >= tolerance_us >= 0
    bucket = lambda t: F.floor(t / F.lit(bucket_us))
    ls = left.where("entity IS NOT NULL AND t IS NOT NULL").select(
        "entity", bucket(F.col("t")).alias("bucket"), "t", F.lit(1).alias("is_left"), F.col("left_id").alias("id")
    )
    rs = (
        right.where("entity IS NOT NULL AND t IS NOT NULL")
        .select(
            "entity",
            F.explode(F.array_distinct(F.array(*(bucket(F.col("t") + d) for d in (0, -tolerance_us, tolerance_us))))).alias("bucket"),
            "t", F.lit(0).alias("is_left"), F.col("right_id").alias("id"),
        )
    )
    # One order serves all: the windows below need it or a prefix of it, so nothing is sorted again.
    rows = ls.unionByName(rs).repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "t", "is_left", "id")
    # Right rows of one time all stand for the smallest id among them.
    rows = rows.withColumn("least", F.expr("min(IF(is_left = 0, id, NULL)) OVER (PARTITION BY entity, bucket ORDER BY t RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"))
    rows = rows.withColumn("mine", F.when(F.col("is_left") == 0, F.struct("t", F.col("least").alias("id"))))
    order = "OVER (PARTITION BY entity, bucket ORDER BY t, is_left, id)"
    carried = rows.select("id", "t", "is_left", F.expr(f"lag(mine) IGNORE NULLS {order}").alias("prev"), F.expr(f"lead(mine) IGNORE NULLS {order}").alias("next"))
    back, ahead = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    nearer = F.when(ahead.isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    return (
        carried.where("is_left = 1")
        .select(F.col("id").alias("left_id"), nearer.alias("n"), "t")
        .select("left_id", F.col("n.id").alias("right_id"), F.abs(F.col("t") - F.col("n.t")).alias("distance_us"))
        .where(F.col("distance_us") <= tolerance_us)
    )


# Where exchange payloads give the instrument and the server's own time.
SYMBOL_KEYS = ("symbol", "s", "pair", "instrument")
SERVER_TIME_KEYS = ("time", "E", "serverTime", "eventTime", "timestamp")


def _scalar_time(value) -> int | None:
    """Microseconds of a server time given as a number, a string of digits or an ISO 8601 date and time."""
    if isinstance(value, str):
        value = value.strip()
        if not value.isascii() or not value.isdigit():
            return iso_us(value)
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value <= 0 or value >= 1e17:
        return None
    return int(value * 1_000_000 if value < 1e10 else value * 1_000 if value < 1e14 else value)


def _refuse(constant: str):
    raise ValueError(constant)


def payload_times(payload: str | None) -> list[tuple[str, int]]:
    """(symbol, server time in microseconds) pairs of one payload; none if it is not well-formed JSON.

    An object takes what it lacks from the object around it; each symbol of a payload counts.
    """
    if not payload:
        return []
    try:
        root = json.loads(payload, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return []
    found: dict[tuple[str, int], None] = {}
    stack = [(root, None, None)]
    while stack:
        node, symbol, time = stack.pop()
        if isinstance(node, list):
            stack.extend((x, symbol, time) for x in node)
        elif isinstance(node, dict):
            own = next((node[k] for k in SYMBOL_KEYS if isinstance(node.get(k), str) and node[k].strip()), None)
            at = next((t for k in SERVER_TIME_KEYS if (t := _scalar_time(node.get(k))) is not None), None)
            if (own is not None or at is not None) and (own or symbol) and (at or time):
                found[own or symbol, at or time] = None
            stack.extend((x, own or symbol, at or time) for x in node.values() if isinstance(x, (dict, list)))
    return list(found)


def response_times(responses: DataFrame) -> DataFrame:
    """right_id, entity, t of every usable response; one row per symbol that its payload gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, symbols, times = [], [], []
            for i, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for symbol, t in payload_times(payload):
                    ids.append(i)
                    symbols.append(symbol)
                    times.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(symbols, pa.string()), pa.array(times, pa.int64())],
                names=["right_id", "symbol", "t"],
            )

    usable = responses.where("status_code = 200 AND payload IS NOT NULL AND payload <> ''").select("response_id", "payload")
    parsed = usable.mapInArrow(run, "right_id long, symbol string, t long")
    return parsed.select("right_id", entity_key(F.col("symbol")).alias("entity"), "t").where("entity <> ''")


def match_funding(
    funding: DataFrame, bars: DataFrame, responses: DataFrame, bar_tolerance_s: int = 120, response_tolerance_s: int = 90
) -> DataFrame:
    """funding_id, side (bar, response), match_id, distance_us of each funding row with a known next time."""
    left = funding.where("next_funding_time <> 0").select(
        F.col("funding_id").alias("left_id"), entity_key(F.col("symbol")).alias("entity"), epoch_us(F.col("next_funding_time")).alias("t")
    )
    bar_times = bars.select(
        F.col("bar_id").alias("right_id"), entity_key(F.col("symbol")).alias("entity"), F.unix_micros(F.col("open_time").cast("timestamp")).alias("t")
    )

    def side(name: str, right: DataFrame, seconds: int) -> DataFrame:
        return match_nearest(left, right, seconds * 1_000_000).select(
            F.col("left_id").alias("funding_id"), F.lit(name).alias("side"), F.col("right_id").alias("match_id"), "distance_us"
        )

    return side("bar", bar_times, bar_tolerance_s).unionByName(side("response", response_times(responses), response_tolerance_s))
