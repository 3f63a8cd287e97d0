import csv
import io
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzbar.functions.instants import iso_us
from quartzbar.operators.bad_rows import api_rows, cheapest_edits, judge, parse_records, zero_cost_cells
from quartzbar.plans import operations
from quartzbar.session import table
from quartzbar.sources.bar_files import parse_kline_rows

GOOD = "1577836800000,2.1,2.3,2.0,2.2,5.5,1577836859999,11.5,7,2.5,5.5,0"


def with_cell(i, text):
    cells = GOOD.split(",")
    cells[i] = text
    return ",".join(cells)


@pytest.mark.parametrize(
    "record",
    [GOOD, "﻿" + GOOD, GOOD + "\r", ",".join(f'"{c}"' for c in GOOD.split(",")), " , ".join(GOOD.split(",")), with_cell(11, '"late, ""x""\nsecond"'), with_cell(0, "2020-01-01T00:00:00Z"),
     with_cell(0, "2020-01-01 00:00:00"), with_cell(0, "2020-01-01T02:00:00+02:00"), with_cell(0, "1577836800"), with_cell(5, "0"), with_cell(7, ""), with_cell(8, "12.0"), with_cell(5, "1.5e+3"), with_cell(6, "x"), with_cell(11, "")],
)
def test_loads(record):
    assert judge([record])[0][0] == "ok"


@pytest.mark.parametrize(
    "record, reason",
    [
        ('"' + GOOD, "quoting"), (with_cell(11, '"0"x'), "quoting"), (with_cell(8, '7"'), "quoting"), (with_cell(1, '""2.1"'), "quoting"), (with_cell(11, '"open'), "quoting"),
        (GOOD + ",1", "column_count"), ("a,b", "column_count"), (GOOD.replace(",", ";"), "column_count"), ('"a,b"', "column_count"), ("1577836800000", "column_count"),
        (with_cell(8, '"1,234"'), "invalid_value"), (with_cell(8, "1.5"), "invalid_value"), (with_cell(1, "0"), "invalid_value"), (with_cell(5, "-1"), "invalid_value"), (with_cell(2, "2.05"), "invalid_value"),
        (with_cell(0, "2020-13-01T00:00:00Z"), "invalid_value"), (with_cell(0, "1577836799"), "invalid_value"), (with_cell(0, "4102444800"), "invalid_value"), (with_cell(4, "NaN"), "invalid_value"), (with_cell(4, "２.2"), "invalid_value"),
        (with_cell(9, "-0.5"), "invalid_value"), (with_cell(0, ""), "invalid_value"), (with_cell(0, "2020-01-01"), "invalid_value"), (with_cell(3, "2..0"), "invalid_value"),
    ],
)
def test_reasons(record, reason):
    assert judge([record])[0][0] == reason


@pytest.mark.parametrize("record", [None, "", "  ", "﻿", "\r", "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"])
def test_no_cases(record):
    assert judge([record])[0][0] == "skip"


def valid(text):
    return zero_cost_cells(text) is not None


def brute(text, width, most=3):
    """(quote edits, cells that are too many or too few) of every least reading: by number of quote edits."""
    level, seen, out = {text}, set(), []
    for quotes in range(most + 1):
        cells = [len(zero_cost_cells(t)) for t in level if valid(t)]
        if cells:
            out.append((quotes, min(abs(n - width) for n in cells)))
        seen |= level
        level = ({t[:i] + t[i + 1 :] for t in level for i in range(len(t)) if t[i] == '"'} | {t[:i] + '"' + t[i:] for t in level for i in range(len(t) + 1)}) - seen
    return out


def costs(texts, width, quote):
    return [(c, sum("quote" in e for e in edits), sum("delimiter" in e for e in edits)) for c, edits in cheapest_edits(texts, width, quote)]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_cheapest_edits_against_brute_force(width):
    texts = [t for n in range(1, 6) for t in map("".join, itertools.product('a", ', repeat=n))]
    weighty, even = costs(texts, width, 1 << 32), costs(texts, width, 1)
    for t, (_, quotes, delimiters), (cost, *_) in zip(texts, weighty, even):
        want = brute(t, width)
        assert (quotes, delimiters) == min(want), t
        assert cost == min(q + d for q, d in want), t


def test_longer_records_against_brute_force():
    rng = random.Random(3)
    for width in (1, 3, 5, 12):
        texts = ["".join(rng.choice('a",,b " ') for _ in range(rng.randrange(6, 13))) for _ in range(15)]
        for t, (cost, quotes, delimiters) in zip(texts, costs(texts, width, 1 << 32)):
            want = brute(t, width, 2)
            if want:
                assert (quotes, delimiters) == min(want) and cost == (quotes << 32) + delimiters, t
            else:
                assert quotes > 2, t


def test_edits_in_their_places():
    assert cheapest_edits(['a"b,c', "a", "a,b,c", '"a', 'x,"a"b'], 2) == [
        (1 << 32, ["delete_quote@1"]), (1, ["insert_delimiter@1"]), (1, ["delete_delimiter@1"]), ((1 << 32) + 1, ["delete_quote@0", "insert_delimiter@2"]), (1 << 33, ["delete_quote@2", "delete_quote@4"]),
    ]
    assert cheapest_edits([',",a,,,",aa,"a,,,""",,"'], 10, 1)[0][0] == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n', max_size=6), min_size=2, max_size=6))
def test_round_trip(cells):
    text = io.StringIO()
    csv.writer(text, lineterminator="", quoting=csv.QUOTE_ALL).writerow(cells)
    strip = lambda c: c.strip(" \t\r\n\v\f 　")
    assert zero_cost_cells(text.getvalue()) == [strip(c) for c in cells]


def test_instants():
    assert iso_us("2020-01-01T00:00:00.5Z") == 1577836800500000 == iso_us("20200101T000000.5Z") and iso_us("2019-12-31T24:00:00Z") == 1577836800000000
    assert iso_us("2020-01-01T00:00:00-01:30") == 1577842200000000 and iso_us("2020/01/01T00:00:00Z") is None and iso_us("2020-02-30T00:00:00Z") is None


def test_table(spark):
    long = with_cell(11, '"' + "x" * 300_000 + '"')
    df = spark.createDataFrame([(1, GOOD, 5), (1, GOOD, 5), (2, None, 5), (3, "a,b", 5), (4, long, 5), (None, '"', 5)], "rec_id long, record string, reason int")
    got = parse_records(df).collect()
    assert sorted((r.rec_id or 0, r.reason or "ok") for r in got) == [(0, "quoting"), (1, "ok"), (1, "ok"), (3, "column_count"), (4, "ok")]
    assert parse_records(df.limit(0)).count() == 0
    assert "10 edits: insert_delimiter@3" in next(r.detail for r in got if r.rec_id == 3)


def test_every_accepted_record_is_an_api_row(spark):
    cells = GOOD.split(",")
    records = [
        GOOD, ",".join(f'"{c}"' for c in cells), GOOD + "\r", "\ufeff" + GOOD, with_cell(6, "-1"), with_cell(1, "21e-1"), with_cell(5, "+5.5"), with_cell(4, " 2.2 "),
        with_cell(0, "2020-01-01T00:00:00Z"), with_cell(0, "1577836800"), with_cell(11, '"a ""b"", c"'), with_cell(8, ""), with_cell(1, "x"), GOOD + ",1", GOOD + '"', None, "",
    ]
    got = parse_kline_rows(api_rows(spark.createDataFrame(list(enumerate(records)), "rec_id long, record string")), "row").collect()
    assert len(got) == 12
    assert {(r.open_time.isoformat(), *r[1:7]) for r in got} == {("2020-01-01T00:00:00", 2.1, 2.3, 2.0, 2.2, 5.5, 11.5)}
    assert sorted(str(r.number_of_trades) for r in got) == ["7.0"] * 11 + ["None"]


def test_archive_rows_are_the_bars_of_the_parser(spark, data):
    names = ("open", "high", "low", "close", "volume", "quote_volume")
    want = [(r.open_time_us, *(r[n] for n in names), r["count"]) for r in parse_records(table(spark, data, "archive_records")).where("reason IS NULL").collect()]
    got = [(r.t_us, *(r[n] for n in names), r.number_of_trades) for r in operations.kline_rows(spark, data).collect()]
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key(want)
