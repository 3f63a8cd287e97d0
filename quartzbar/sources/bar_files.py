"""Scans of bar files: CSV with a header, archive CSV and zip, Parquet, kline rows and messages, metrics, periods."""

from __future__ import annotations

import heapq
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzbar.functions.fields import ARCHIVE_CSV_FIELDS, COLLECTED_CSV_FIELDS
from quartzbar.operators.asof import asof_backward

REQUIRED = ("open_time", "open", "high", "low", "close", "volume")
OPTIONAL = tuple(c for c in COLLECTED_CSV_FIELDS if c not in REQUIRED)


class BadBars(ValueError):
    """A file of bars breaks a rule that the scan enforces."""


def instant(text) -> F.Column:
    """Seconds up to 10^10, milliseconds beyond, or a date and time; without offset UTC."""
    c = F.trim(text.cast("string"))
    n = c.try_cast("bigint")
    return F.when(n.isNotNull(), F.timestamp_micros(F.when(n <= 10_000_000_000, n * 1_000_000).otherwise(n * 1_000))).otherwise(F.try_to_timestamp(c))


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with a header, in order of time; refuses missing columns, repeated times and files without any volume."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise BadBars(f"missing columns: {', '.join(missing)}")
    number = lambda c: F.col(c).try_cast("double")
    bars = raw.select(
        instant(F.col("open_time")).alias("open_time"), *(number(c).alias(c) for c in REQUIRED[1:]),
        *(F.coalesce(number(c), F.lit(0.0)).alias(c) if c in raw.columns else F.lit(0.0).alias(c) for c in OPTIONAL),
    )
    # One pass proves all three; times are folded before they are shuffled.
    times = bars.groupBy("open_time").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("volume")).alias("v"))
    untimed = F.sum(F.when(F.col("open_time").isNull(), F.col("n")))
    facts = times.agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.max(F.when(F.col("open_time").isNotNull(), F.col("n"))).alias("most"), untimed.alias("untimed")).first()
    if facts.untimed:
        raise BadBars(f"{facts.untimed} rows without a time")
    if facts.n and not facts.v:
        raise BadBars("no row has any volume")
    if (facts.most or 0) > 1:
        raise BadBars("repeated times")
    return bars.sort("open_time")


#: Where a row stands: its file, the split of the file (by first byte), its number in the order of reading.
PLACE = ("file", "split", "line")


def _archive_columns(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("open_time").rlike("^[0-9]")).select(
        *PLACE, instant(F.col("open_time")).alias("open_time"), *(F.col(c).try_cast("double").alias(c) for c in REQUIRED[1:]),
        F.col("quote_volume").try_cast("double").alias("quote_volume"), F.col("count").try_cast("double").alias("number_of_trades"),
        F.col("taker_buy_volume").try_cast("double").alias("taker_buy_base_volume"), F.col("taker_buy_quote_volume").try_cast("double").alias("taker_buy_quote_volume"),
    )


_ARCHIVE = T.StructType([T.StructField(c, T.StringType()) for c in ARCHIVE_CSV_FIELDS])


def _in_order(rows: DataFrame, strict: bool) -> DataFrame:
    if strict and (late := out_of_order(rows).select("file").limit(1).collect()):
        raise BadBars(f"times are not in order: {late[0].file}")
    return rows


def read_archive_csv(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Rows of archive CSV files with the PLACE of each; a header is optional, rows of too few cells are left out.

    strict: a file whose times do not rise is refused.
    """
    raw = spark.read.schema(_ARCHIVE).option("mode", "PERMISSIVE").csv(path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return _in_order(_archive_columns(placed.where(F.col("ignore").isNotNull())), strict)


def read_archive_zip(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """The same from zip files, of each the first CSV; broken zip files are left out. One file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = next(n for n in z.namelist() if n.endswith(".csv"))
                        line = 0
                        with z.open(inner) as f:
                            for part in pd.read_csv(f, header=None, names=list(ARCHIVE_CSV_FIELDS), dtype=str, chunksize=50_000, on_bad_lines="skip"):
                                part = part.assign(split=0, line=range(line, line + len(part)))
                                line += len(part)
                                part = part[part["ignore"].notna()].astype({c: object for c in ARCHIVE_CSV_FIELDS})
                                yield part.assign(file=pd.Series([name] * len(part), index=part.index, dtype=object))[[*ARCHIVE_CSV_FIELDS, *PLACE]]
                except (zipfile.BadZipFile, StopIteration, OSError):
                    continue

    schema = T.StructType([*_ARCHIVE.fields, T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("line", T.LongType())])
    return _in_order(_archive_columns(files.mapInPandas(unzip, schema)), strict)


def read_archive_folder(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """CSV and zip files of a folder: a CSV stands for the zip of its name, of rows of one time the first file's counts.

    Names are listed by the folder's own file system; no content is read for that.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,zip}").load(folder).select("path")
    paths = sorted(r.path for r in listed.collect())
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    plain = [p for p in paths if p.endswith(".csv")]
    stems = {stem(p) for p in plain}
    zipped = [p for p in paths if p.endswith(".zip") and stem(p) not in stems]
    parts = [read(spark, p, strict) for read, p in ((read_archive_csv, plain), (read_archive_zip, zipped)) if p]
    if not parts:
        raise BadBars(f"no archive files in {folder}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.regexp_extract("file", r"([^/]+)\.[a-z]+$", 1)
    least = rows.withColumn("_s", F.struct(name, "split", "line")).groupBy("open_time").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "open_time")), "_s").alias("b"))
    return least.select("open_time", "b.*")


def out_of_order(rows: DataFrame) -> DataFrame:
    """file, open_time of archive rows (with their PLACE) that do not come after all rows before them in their file.

    A split looks back in itself; the greatest time of the splits before it comes from one row per split.
    """
    tops = rows.groupBy("file", "split").agg(F.max("open_time").alias("_top"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("file", "split", F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select(*PLACE, "open_time").join(tops, ["file", "split"])
    return seen.withColumn("_p", F.greatest(F.max("open_time").over(inside), "_carried")).where("open_time <= _p").select("file", "open_time")


def read_parquet_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of Parquet files whose open_time is text, an epoch in milliseconds or a timestamp."""
    raw = spark.read.parquet(path)
    kind = dict(raw.dtypes)["open_time"]
    return raw if kind.startswith("timestamp") else raw.withColumn("open_time", instant(F.col("open_time")))


def parse_kline_rows(rows: DataFrame, column: str) -> DataFrame:
    """Bars of API rows: JSON arrays of at least eleven cells in archive order; others are left out."""
    a = F.from_json(column, "array<string>")
    got = rows.select(a.alias("a")).where("size(a) >= 11")
    cell = lambda i: F.get("a", F.lit(i))
    names = ("open", "high", "low", "close", "volume")
    return got.select(
        instant(cell(0)).alias("open_time"), *(cell(i + 1).try_cast("double").alias(n) for i, n in enumerate(names)),
        cell(7).try_cast("double").alias("quote_volume"), cell(8).try_cast("double").alias("number_of_trades"),
        cell(9).try_cast("double").alias("taker_buy_base_volume"), cell(10).try_cast("double").alias("taker_buy_quote_volume"),
    )


def parse_kline_messages(rows: DataFrame, column: str) -> DataFrame:
    """Bars of stream messages {s, k: {t, o, h, l, c, v, q, n, V, Q, x}}; only closed bars (x) count."""
    # A map, as names of fields differ by case only (v and V).
    got = rows.select(F.from_json(column, "s string, k map<string,string>").alias("j")).where("lower(j.k['x']) = 'true'")
    num = lambda n, a: F.try_element_at("j.k", F.lit(n)).try_cast("double").alias(a)
    return got.select(
        F.col("j.s").alias("symbol"), F.timestamp_millis(F.try_element_at("j.k", F.lit("t")).try_cast("bigint")).alias("open_time"),
        num("o", "open"), num("h", "high"), num("l", "low"), num("c", "close"), num("v", "volume"),
        num("q", "quote_volume"), num("n", "number_of_trades"), num("V", "taker_buy_base_volume"), num("Q", "taker_buy_quote_volume"),
    )


METRICS = (
    "create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio",
    "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio",
)


def _metrics(rows: DataFrame) -> DataFrame:
    typed = rows.select(instant(F.col("create_time")).alias("create_time"), "symbol", *(F.col(c).try_cast("double").alias(c) for c in METRICS[2:]), "_n")
    ok = typed.where(" AND ".join(f"{c} IS NOT NULL" for c in METRICS))
    last = ok.groupBy("symbol", "create_time").agg(F.max_by(F.struct(*METRICS[2:]), "_n").alias("b"))
    return last.select("create_time", "symbol", "b.*")


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metrics ticks; a header is optional, rows that do not parse are left out, the last write of a tick counts."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in METRICS)).option("mode", "PERMISSIVE").csv(path)
    return _metrics(raw.withColumn("_n", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("line"))))


def read_metrics_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same from all zip files of a folder; broken ones are left out, of one tick the file that sorts last counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for inner in sorted(n for n in z.namelist() if n.endswith(".csv")):
                            with z.open(inner) as f:
                                line = 0
                                for part in pd.read_csv(f, header=None, names=list(METRICS), dtype=str, chunksize=50_000, on_bad_lines="skip"):
                                    part = part.astype(object).where(part.notna(), None)
                                    yield part.assign(file=pd.Series([name] * len(part), index=part.index, dtype=object), line=range(line, line + len(part)))
                                    line += len(part)
                except (zipfile.BadZipFile, OSError):
                    continue

    schema = ", ".join(f"{c} string" for c in (*METRICS, "file")) + ", line long"
    return _metrics(files.mapInPandas(unzip, schema).withColumn("_n", F.struct("file", "line")))


def read_regime_periods(spark: SparkSession, path: str) -> DataFrame:
    """regime, start, end_exclusive, rank of periods in JSON files {periods: [...]}; unknown regimes are refused."""
    raw = spark.read.option("multiLine", True).schema("periods array<struct<regime:string,start:string,end_exclusive:string>>").json(path)
    rows = raw.select(F.posexplode("periods").alias("rank", "p")).select(
        "p.regime", F.to_timestamp("p.start").alias("start"), F.to_timestamp("p.end_exclusive").alias("end_exclusive"), "rank"
    )
    if rows.where(~F.col("regime").isin("up", "down", "range")).limit(1).count():
        raise BadBars("unknown regime")
    return rows


#: Periods that every row looks through as one literal.
MOST_PERIODS = 64


def _segments(periods: list) -> list[tuple]:
    """(start, regime or None) of the stretches of time in order, each with the first period that covers it."""
    edges = sorted({p.start for p in periods} | {p.end_exclusive for p in periods})
    opened: list[int] = []
    by_start = sorted(range(len(periods)), key=lambda i: periods[i].start)
    out, k = [], 0
    for at in edges:
        while k < len(by_start) and periods[by_start[k]].start <= at:
            heapq.heappush(opened, by_start[k])
            k += 1
        while opened and periods[opened[0]].end_exclusive <= at:
            heapq.heappop(opened)
        out.append((at, periods[opened[0]].regime if opened else None))
    return out


def with_periods(rows: DataFrame, periods: DataFrame, default: str = "range") -> DataFrame:
    """rows (open_time, ...) with the regime of the first period they are in; periods without start or end count for nothing.

    Periods are a file of dates and read by the driver. A few become one literal that every row looks through, so
    nothing is shuffled; many become a table of disjoint stretches of time and an as-of join by blocks of days.
    """
    listed = [p for p in periods.orderBy("rank").collect() if p.start is not None and p.end_exclusive is not None and p.start < p.end_exclusive]
    if len(listed) <= MOST_PERIODS:
        found = F.lit(default)
        for p in reversed(listed):
            found = F.when((F.col("open_time") >= F.lit(p.start)) & (F.col("open_time") < F.lit(p.end_exclusive)), p.regime).otherwise(found)
        return rows.withColumn("regime", found)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    right = rows.sparkSession.createDataFrame(_segments(listed), "start timestamp, regime string").select(F.lit(0).alias("entity"), us("start").alias("t"), "regime")
    left = rows.select(F.lit(0).alias("entity"), us("open_time").alias("t"), F.struct("*").alias("own"))
    found = asof_backward(left, right, ["regime"], 86_400_000_000)
    return found.select("own.*", F.coalesce("regime", F.lit(default)).alias("regime"))


def synthetic_bars(spark: SparkSession, n: int, start: str = "2026-01-01 00:00:00", missing: tuple[int, ...] = (37, 38, 119, 177)) -> DataFrame:
    """A deterministic series: two sines and a drift, with missing minutes."""
    base = spark.range(n).where(~F.col("id").isin(*missing)).withColumn("i", F.col("id").cast("double"))
    price = lambda i: 100_000 + 45 * F.sin(i / 5) + 95 * F.sin(i / 17) + 1.5 * (i % 29)
    o, c = price(F.greatest(F.col("i") - 1, F.lit(0.0))), price(F.col("i"))
    r = lambda x: F.round(x, 8)
    volume = r(8 + F.col("i") % 11 + 4 * F.abs(F.sin(F.col("i") / 3)))
    t = F.to_timestamp(F.lit(start)) + F.make_dt_interval(mins=F.col("id").cast("int"))
    return base.select(
        F.lit("SYNTH").alias("symbol"), t.alias("open_time"), r(o).alias("open"), r(F.greatest(o, c) + 18 + F.col("i") % 7).alias("high"), r(F.least(o, c) - 18 - F.col("i") % 5).alias("low"),
        r(c).alias("close"), volume.alias("volume"), r(volume * c).alias("quote_volume"), (F.lit(100) + F.col("id") % 50).alias("number_of_trades"),
        r(volume * 0.5).alias("taker_buy_base_volume"), r(volume * c * 0.5).alias("taker_buy_quote_volume"), t.alias("ingested_at"), F.col("id").alias("bar_id"),
    )


def small_bars(spark: SparkSession) -> DataFrame:
    """Six bars with a hole of two minutes."""
    i = F.col("id").cast("double")
    price, volume = 100_000 + 10 * i, 10 + i
    t = F.to_timestamp(F.lit("2026-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("id").cast("int"))
    return spark.range(8).where("id NOT IN (3, 4)").select(
        F.lit("FIXTURE").alias("symbol"), t.alias("open_time"), price.alias("open"), (price + 20).alias("high"), (price - 20).alias("low"), (price + 5).alias("close"), volume.alias("volume"),
        (volume * price).alias("quote_volume"), (F.col("id") + 100).alias("number_of_trades"), F.lit(5.0).alias("taker_buy_base_volume"), (5 * price).alias("taker_buy_quote_volume"), t.alias("ingested_at"), F.col("id").alias("bar_id"),
    )
