"""Writers of bars and artifacts, and manifests that prove what was written."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str, form: str = "parquet") -> None:
    """Bars as Parquet by symbol and month, or as CSV with a header. A month's rows of a symbol may be several files."""
    dated = bars.withColumn("month", F.date_format("open_time", "yyyy-MM"))
    if form == "parquet":
        dated.write.mode("overwrite").partitionBy("symbol", "month").parquet(path)
    elif form == "csv":
        bars.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form}")


def concat_csv_to_parquet(spark: SparkSession, pattern: str, path: str) -> None:
    """Collected CSV files with a header, as one Parquet table."""
    from quartzbar.sources.bar_files import read_csv_bars

    read_csv_bars(spark, pattern).write.mode("overwrite").parquet(path)


def write_json(record: dict, path: str) -> None:
    """A small record as JSON with sorted keys; what is no number becomes null."""

    def clean(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(clean(record), f, indent=2, sort_keys=True, default=str)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_records(records: list[dict], path: str) -> None:
    """A few records as CSV; the header is the sorted union of their keys."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, sorted({k for r in records for k in r}))
        out.writeheader()
        out.writerows(records)


def write_monitoring(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a report (a few rows) as one CSV file with a header in a folder of its name."""
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_cache(tables: dict[str, DataFrame], folder: str, facts: dict) -> None:
    """Tables of a dataset as Parquet by symbol (where they have one) below a folder, with their columns and further facts in a table of its own."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("symbol") if "symbol" in rows.columns else writer).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    known = facts | {"tables": {name: rows.columns for name, rows in tables.items()}}
    spark.createDataFrame([(json.dumps(known, sort_keys=True, default=str),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{folder}/_metadata")


def read_cache(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a cached dataset, or some of its columns; columns that it lacks are null."""
    rows = spark.read.parquet(f"{folder}/{name}")
    if columns is None:
        return rows
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns))


def cache_facts(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/_metadata").first()[0])


def write_lineage(path: str, run: str, inputs: dict[str, str], outputs: dict[str, str], parameters: dict) -> None:
    """What a run read and wrote (name to hash or path) and its parameters, as JSON."""
    write_json({"run": run, "inputs": inputs, "outputs": outputs, "parameters": parameters}, path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as its own file system spells it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder), bytes, sha256 of every file below a folder; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.substring("path", len(qualified(spark, folder)) + 2, 1 << 20)
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, problem (missing, added, changed, outside) of files that differ from a manifest (path, bytes, sha256)."""
    now = file_hashes(spark, folder).select("path", F.col("sha256").alias("now"))
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    j = manifest.select("path", "sha256").join(now, "path", "full_outer")
    problem = (
        F.when(outside, "outside").when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
    )
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")
