import json

import pytest
from pyspark.sql import functions as F

from quartzbar.operators.schema_drift import consistent_bars, quantity, schema_changes

FILES = "file_id long, feed string, file_seq int, file_name string, symbol string, file_format string, header string, extra string, form string"
ROWS = "file_id long, row_no int, record string, path string, mask int"


def tables(spark, files, rows):
    f = spark.createDataFrame([(i, feed, seq, f"{i}.x", "S", fmt, head, "e", "clash") for i, feed, seq, fmt, head in files], FILES)
    r = spark.createDataFrame([(i, n, rec, "clash", 9) for n, (i, rec) in enumerate(rows)], ROWS)
    return f, r


def changes(spark, files, rows):
    out = schema_changes(*tables(spark, files, rows)).select("file_id", "field", "change").collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_each_kind_of_change(spark):
    files = [
        (1, "a", 1, "csv", "open_time,volume,count"),
        (2, "a", 2, "csv", " count,open_time,v"),
        (3, "a", 3, "jsonl", None),
        (4, "a", 4, "csv", "open_time,v,vwap"),
        (9, "b", 7, "csv", "open_time"),
    ]
    rows = [
        (1, "1577836800,1.5,7"), (2, "7,1577836800000,2"), (2, "7.0,1577836800000,2"), (3, json.dumps({"open_time": 1577836800000, "v": "2.5", "halted": True, "count": None})),
        (4, "2020-01-01T00:00:00Z,2.5 u,"), (9, "5"),
    ]
    assert changes(spark, files, rows) == {
        (2, "open_time", "retyped"), (2, "volume", "renamed"), (2, "volume", "retyped"), (2, "count", "retyped"),
        (3, "volume", "retyped"), (3, "halted", "added"),
        (4, "open_time", "retyped"), (4, "halted", "removed"), (4, "count", "removed"), (4, "vwap", "added"),
    }


def test_no_value_keeps_the_type_and_names_are_case_sensitive(spark):
    files = [(1, "a", 1, "csv", "v,V"), (2, "a", 2, "csv", "v,V"), (3, "a", 3, "csv", "v,V"), (4, "a", 5, "csv", "V,v")]
    rows = [(1, "1,2"), (2, ",2"), (3, "1.5,"), (4, "3,2.5"), (4, "3,2.5")]
    assert changes(spark, files, rows) == {(3, "volume", "retyped")}


def test_json_strings_are_text_and_nested_values_do_not_break(spark):
    files = [(1, "a", 1, "jsonl", None), (2, "a", 2, "jsonl", None), (3, "a", 3, "jsonl", None)]
    rows = [(1, '{"o": 1, "x": "}{,\\" :"}'), (2, '{"o": "1", "x": {"y": [1, 2]}}'), (3, "not json"), (3, '{"o": 1.0}')]
    assert changes(spark, files, rows) == {(2, "open", "retyped"), (3, "open", "retyped"), (3, "x", "removed")}


def test_empty_and_null(spark):
    assert changes(spark, [], []) == set()
    files = [(1, "a", 1, "csv", None), (2, "a", 2, "csv", "o"), (3, None, None, None, None)]
    assert changes(spark, files, [(None, None), (2, None), (77, "1")]) == {(2, "open", "added")}


def test_alternatives_that_leave_the_type_have_rows(spark):
    files = [(i, "a", i, "csv", h) for i, h in enumerate(("o,note,v,t,c", "o,note,v,t,c", "o,note,v,t,c", "o,note,volume,t,c"), 1)]
    rows = [(1, "1.5,x,2.5,1577836800,"), (2, "1.5,x,,1577836800,7"), (2, "3,4.5,,1577836800,7"), (3, "3.5,x,2.5,1577836800,7"), (4, "2,6,200000000000,1577836800,8"), (4, "2.5,x,3.5,x,8")]
    out = schema_changes(*tables(spark, files, rows)).collect()
    assert {(r.file_id, r.field, r.change, *r.new_alternatives) for r in out} == {
        (2, "open", "alternative", "integer"), (2, "note", "alternative", "decimal"), (2, "close", "alternative", "integer"), (4, "open", "alternative", "integer"),
        (4, "note", "alternative", "integer"), (4, "volume", "alternative", "integer"), (4, "volume", "renamed", "integer"), (4, "open_time", "retyped", "text"),
    }
    assert len(out) == 8


def test_long_values_and_hot_file(spark):
    rows = [(1, "x" * 200_000 + ",1")] + [(1, "1,1")] * 500 + [(2, "1,1")]
    files = [(1, "a", 1, "csv", "o,c"), (2, "a", 2, "csv", "o,c")]
    assert changes(spark, files, rows) == {(2, "open", "retyped")}


def test_one_table(spark):
    files = [(1, "a", 1, "csv", "t,close,vol,odd"), (2, "a", 2, "jsonl", None)]
    rows = [(1, "1577836800,2.5 USDT,abc,k"), (2, '{"open_time": "2020-01-01T00:01:00Z", "c": 3, "V": null}')]
    got = {r.file_id: r for r in consistent_bars(*tables(spark, files, rows)).collect()}
    assert got[1].open_time.isoformat() == "2020-01-01T00:00:00" and got[1].close == 2.5 and got[1].volume is None
    assert got[1].unconverted == {"volume": "abc"} and got[1].extras == {"odd": "k"}
    assert got[2].open_time.isoformat() == "2020-01-01T00:01:00" and got[2].close == 3.0 and got[2].unconverted == {}


def test_values_without_a_column_are_in_typed_branches(spark):
    files = [(1, "a", 1, "jsonl", None), (2, "a", 2, "csv", "o,c,odd")]
    rows = [(1, '{"o": true, "c": "true", "t": 1.5, "h": 2, "x": -7, "z": 12345678901234567890}'), (2, "abc,2.5,6")]
    got = {r.file_id: {k: tuple(v) for k, v in r.branches.items()} for r in consistent_bars(*tables(spark, files, rows)).collect()}
    put = lambda name, i, v: (name, *(v if i == k else None for k in range(4)))
    assert got[1] == {
        "open": put("boolean", 0, True), "close": put("text", 3, "true"), "open_time": put("decimal", 2, 1.5),
        "x": put("integer", 1, -7), "z": put("decimal", 2, 12345678901234567890.0),
    }
    assert got[2] == {"open": put("text", 3, "abc"), "odd": put("integer", 1, 6)}


@pytest.mark.parametrize("record", ["", " ", ",,,", '{"a": }', "null"])
def test_odd_records(spark, record):
    changes(spark, [(1, "a", 1, "jsonl", None), (2, "a", 2, "csv", "o")], [(1, record), (2, record)])


def test_long_nested_and_escaped_members(spark):
    files = [(i, "a", i, "jsonl", None) for i in (1, 2, 3)]
    rows = [
        (1, '{"open": 1, "volume": 3}'),
        (2, json.dumps({"open": 2, "volume": 4, "x": [1, {"y": "z" * 5_000}]})),
        (3, json.dumps({"open": 2, "volume": "\\\"" * 500_000, "x": {"deep": [[[1]]]}})), (3, '{"open": 12.0, "volume": "q"}'),
    ]
    assert changes(spark, files, rows) == {(2, "x", "added"), (3, "open", "retyped"), (3, "volume", "retyped")}
    bars = {(r.file_id, r.row_no): r for r in consistent_bars(*tables(spark, files, rows)).collect()}
    assert bars[2, 1].open == 2.0 and bars[2, 1].extras["x"].startswith('[1,{"y":"zzz') and len(bars[3, 2].unconverted["volume"]) == 1_000_000


def test_json_objects_in_csv_files_and_what_is_no_json_number(spark):
    files = [(1, "a", 1, "csv", "o,c"), (2, "a", 2, "csv", "o,c"), (3, "a", 3, "jsonl", None), (4, "a", 4, "jsonl", None)]
    rows = [(1, "1,2"), (2, "1,2"), (2, '{"o": "x", "c": "y"}'), (3, '{"o": 1, "c": 2}'), (4, '{"o": NaN, "c": 12345678901234567890}')]
    assert changes(spark, files, rows) == {(4, "open", "retyped")}


def test_names_made_of_known_words(spark):
    names = {
        "takerBuyBaseAssetVolume": "taker_buy_volume", "Taker-Buy quote qty": "taker_buy_quote_volume", "num_trades": "count", "ClosePrice": "close", "base_qty": "volume",
        "quoteAmount": "quote_volume", "candleStart": "open_time", "kline_close_time": "close_time", "open_interest": "open_interest", "first_trade_id": "first_trade_id",
        "mark_price": "mark_price", "vwap": "vwap", "zz_vol": "zz_vol", "is_final": "is_final", "": "", "_": "_", "X": "X", "V": "taker_buy_volume", "v": "volume",
    }
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", quantity(F.col("n")).alias("q")).collect()
    assert {r.n: r.q for r in got} == names
