import json
import os
import random
import zipfile
from datetime import datetime, timedelta

import duckdb
import pytest

from quartzbar.plans import operations
from quartzbar.sources import bar_files, sinks

HEADER = "open_time,open,high,low,close,volume,quote_volume,number_of_trades"
LINE = "1577836800000,1,2,0.5,1.5,10,15,3"
ARCHIVE = "1577836800000,1,2,0.5,1.5,10,1577836859999,15,3,5,7.5,0"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv(spark, tmp_path):
    rows = bar_files.read_csv_bars(spark, write(tmp_path / "a.csv", HEADER, LINE, LINE.replace("1577836800000", "2020-01-01T00:01:00Z"))).sort("open_time").collect()
    assert [r.open_time.isoformat() for r in rows] == ["2020-01-01T00:00:00", "2020-01-01T00:01:00"] and rows[0].taker_buy_base_volume == 0.0


@pytest.mark.parametrize(
    "lines, why",
    [((HEADER.replace("close", "x"), LINE), "missing columns: close"), ((HEADER, LINE, LINE), "repeated"), ((HEADER, LINE.replace(",10,", ",0,")), "volume"), ((HEADER, LINE.replace("1577836800000", "soon")), "without a time")],
)
def test_bad_csv(spark, tmp_path, lines, why):
    with pytest.raises(bar_files.BadBars, match=why):
        bar_files.read_csv_bars(spark, write(tmp_path / "a.csv", *lines))


def test_archives(spark, tmp_path):
    names = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"
    write(tmp_path / "b.csv", names, ARCHIVE, "1577836860000,1,2")
    for name, content in (("a.zip", ARCHIVE.replace(",1.5,", ",1.7,")), ("b.zip", ARCHIVE.replace("1577836800000", "1577836920000")), ("c.zip", ARCHIVE.replace("1577836800000", "1577836980000"))):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", content + "\n")
    (tmp_path / "d.zip").write_bytes(b"no zip")
    rows = bar_files.read_archive_folder(spark, str(tmp_path)).sort("open_time").collect()
    # b.zip gives way to b.csv, d.zip is broken, and of the rows of one time that of a comes first.
    assert [(r.open_time.minute, r.close) for r in rows] == [(0, 1.7), (3, 1.5)]
    assert bar_files.out_of_order(bar_files.read_archive_csv(spark, str(tmp_path / "b.csv"))).count() == 0


def test_klines(spark):
    row = json.dumps([1577836800000, "1", "2", "0.5", "1.5", "10", 1577836859999, "15", 3, "5", "7.5", "0"])
    got = bar_files.parse_kline_rows(spark.createDataFrame([(row,), ("[1]",), (None,), ("x",)], "r string"), "r").collect()
    assert len(got) == 1 and got[0].close == 1.5 and got[0].number_of_trades == 3
    k = {"t": 1577836800000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "q": "15", "n": 3, "V": "5", "Q": "7.5", "x": True}
    lines = [json.dumps({"s": "A", "k": k}), json.dumps({"s": "A", "k": k | {"x": False}}), "broken", None]
    got = bar_files.parse_kline_messages(spark.createDataFrame([(x,) for x in lines], "v string"), "v").collect()
    assert len(got) == 1 and (got[0].volume, got[0].taker_buy_base_volume) == (10.0, 5.0)


def test_open_candles_are_no_bars(spark):
    k = {"t": 1577836800000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "q": "15", "n": 3, "V": "5", "Q": "7.5"}
    lines = [json.dumps({"s": s, "k": k | x}) for s, x in (("A", {"x": True}), ("B", {"x": False}), ("C", {}), ("D", {"x": None}), ("E", {"x": "true"}), ("F", {"x": True, "c": None}))]
    got = bar_files.parse_kline_messages(spark.createDataFrame([(x,) for x in lines], "v string"), "v").collect()
    assert sorted((r.symbol, r.close) for r in got if r.close) == [("A", 1.5), ("E", 1.5)] and sorted(r.symbol for r in got) == ["A", "E", "F"]


def test_messages_of_odd_bars_give_what_the_sql_gives(spark, tmp_path):
    # NaN stays NaN and null stays null; times are cut to whole milliseconds by integers, as in the SQL.
    closes = ("'NaN'", "'Infinity'", "'-Infinity'", "NULL", "-0.0", "5e-324", "1e22", "0.1")
    times = ("1577836800123456", "1577836800999999", "253402300799999999", "-1", "-1500", "NULL")
    values = ", ".join(f"({t}, {c}::DOUBLE)" for t in times for c in closes)
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"""CREATE TABLE bars AS SELECT 'A' AS symbol, make_timestamptz(us) AS open_time, 1.0 AS open, 2.0 AS high, 0.5 AS low, close, 10.0 AS volume, 15.0 AS quote_volume,
      3 AS number_of_trades, 5.0 AS taker_buy_base_volume, 7.5 AS taker_buy_quote_volume FROM (VALUES {values}) AS v(us, close)""")
    db.execute(f"COPY bars TO '{tmp_path / 'bars.parquet'}' (FORMAT parquet)")
    got = operations.kline_messages(spark, str(tmp_path)).select("t_us", "close").collect()
    said = db.execute(f"SELECT t_us, close FROM ({operations.SQL['kline_messages']})").fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, said)) and len(said) == len(times) * len(closes)


def test_metrics_and_periods(spark, tmp_path):
    tick = "2020-01-01 00:05:00,A,1,2,3,4,5,6"
    rows = bar_files.read_metrics_csv(spark, write(tmp_path / "m.csv", ",".join(bar_files.METRICS), tick, tick.replace(",1,", ",9,"), "bad,A,1,2,3,4,5,6", "2020-01-01 00:10:00,A,x,2,3,4,5,6")).collect()
    assert len(rows) == 1 and rows[0].sum_open_interest == 9.0
    path = tmp_path / "p.json"
    path.write_text("﻿" + json.dumps({"periods": [{"regime": "up", "start": "2020-01-01", "end_exclusive": "2020-01-02"}, {"regime": "down", "start": "2020-01-01", "end_exclusive": "2020-01-03"}]}))
    periods = bar_files.read_regime_periods(spark, str(path))
    at = spark.sql("SELECT explode(array(timestamp'2020-01-01 00:00:00', timestamp'2020-01-02 00:00:00', timestamp'2020-01-03 00:00:00')) AS open_time")
    assert [r.regime for r in bar_files.with_periods(at, periods).sort("open_time").collect()] == ["up", "down", "range"]
    path.write_text(json.dumps({"periods": [{"regime": "odd", "start": "2020-01-01", "end_exclusive": "2020-01-02"}]}))
    with pytest.raises(bar_files.BadBars):
        bar_files.read_regime_periods(spark, str(path))


def test_round_trip_and_manifest(spark, tmp_path):
    bars = bar_files.synthetic_bars(spark, 200)
    out = str(tmp_path / "bars")
    sinks.write_bars(bars, out)
    again = bar_files.read_parquet_bars(spark, out)
    assert again.count() == 196 and again.select("open_time").distinct().count() == 196
    manifest = spark.createDataFrame(sinks.file_hashes(spark, out).collect())
    assert sinks.changed_files(spark, out, manifest).count() == 0
    first = manifest.where("path LIKE '%.parquet'").first().path
    with open(f"{out}/{first}", "ab") as f:
        f.write(b"x")
    folder, _, name = f"{out}/{first}".rpartition("/")
    os.remove(f"{folder}/.{name}.crc")  # else the file system refuses the file before its hash is taken
    (tmp_path / "bars" / "new.txt").write_text("x")
    bad = manifest.unionByName(spark.createDataFrame([("../up", 1, "x")], "path string, bytes long, sha256 string"))
    assert {(r.path, r.problem) for r in sinks.changed_files(spark, out, bad).collect()} == {(first, "changed"), ("new.txt", "added"), ("../up", "outside")}
    sinks.write_bars(bars, str(tmp_path / "csv"), "csv")
    sinks.concat_csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 196
    sinks.write_json({"a": float("nan"), "b": [1, float("inf")]}, str(tmp_path / "x" / "r.json"))
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == {"a": None, "b": [1, None]}


def test_order_of_archive_rows(spark, tmp_path):
    minute = lambda i: ARCHIVE.replace("1577836800000", str(1577836800000 + 60000 * i))
    write(tmp_path / "x.csv", *(minute(i) for i in (3, 1, 2, 4, 4, 5)))
    write(tmp_path / "y.csv", *(minute(i) for i in range(5)))
    rows = bar_files.read_archive_csv(spark, str(tmp_path), strict=False)
    assert sorted((r.file[-5:], r.open_time.minute) for r in bar_files.out_of_order(rows).collect()) == [("x.csv", 1), ("x.csv", 2), ("x.csv", 4)]
    with pytest.raises(bar_files.BadBars, match="x.csv"):
        bar_files.read_archive_folder(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        split = bar_files.read_archive_csv(spark, str(tmp_path / "x.csv"), strict=False)
        assert split.select("split").distinct().count() > 1
        assert sorted(r.open_time.minute for r in bar_files.out_of_order(split).collect()) == [1, 2, 4]
        assert bar_files.read_archive_csv(spark, str(tmp_path / "y.csv")).count() == 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", minute(2) + "\n" + minute(1) + "\n")
    with pytest.raises(bar_files.BadBars, match="z.zip"):
        bar_files.read_archive_zip(spark, str(tmp_path / "z.zip"))


def test_many_periods_as_few(spark, monkeypatch):
    rng = random.Random(2)
    at = lambda h: datetime(2020, 1, 1) + timedelta(hours=h)
    listed = [(rng.choice(["up", "down", "range"]), at(a), at(a + rng.randrange(-1, 30)), i) for i, a in enumerate(rng.choices(range(300), k=60))] + [("up", None, at(5), 60)]
    periods = spark.createDataFrame(listed, "regime string, start timestamp, end_exclusive timestamp, rank int")
    rows = spark.createDataFrame([(i, at(i / 2), "clash", 5) for i in range(-4, 700)] + [(999, None, "", 6)], "id int, open_time timestamp, entity string, t int")
    few = {r.id: r.regime for r in bar_files.with_periods(rows, periods, "none").collect()}
    monkeypatch.setattr(bar_files, "MOST_PERIODS", 3)
    many = bar_files.with_periods(rows, periods, "none")
    assert {r.id: r.regime for r in many.collect()} == few and set(few.values()) == {"up", "down", "range", "none"}
    assert many.columns == [*rows.columns, "regime"]


def test_cache_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 2.5), ("B", 2, None)], "symbol string, idx int, x double")
    sinks.write_cache({"features": rows}, str(tmp_path / "c"), {"horizon": 5})
    got = sinks.read_cache(spark, str(tmp_path / "c"), "features", ["idx", "x", "y"]).sort("idx").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, None), (2, None, None)] and sinks.read_cache(spark, str(tmp_path / "c"), "features").count() == 2
    assert sinks.cache_facts(spark, str(tmp_path / "c")) == {"horizon": 5, "tables": {"features": ["symbol", "idx", "x"]}}
    sinks.write_records([{"b": 1}, {"a": 2}], str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().split() == ["a,b", ",1", "2,"]
    sinks.write_monitoring({"m": rows}, str(tmp_path / "mon"))
    assert spark.read.option("header", True).csv(str(tmp_path / "mon/m")).count() == 2
    sinks.write_lineage(str(tmp_path / "l.json"), "r1", {"bars": "x"}, {}, {"h": float("nan")})
    assert json.loads((tmp_path / "l.json").read_text())["parameters"] == {"h": None}
    paths = {r.path for r in sinks.file_hashes(spark, str(tmp_path)).collect()}
    assert "r.csv" in paths and all(not p.startswith("/") for p in paths)
