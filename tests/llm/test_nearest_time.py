import random

import pytest

from quartzbar.functions.keys import entity_key
from quartzbar.llm.nearest_time import match_funding, match_nearest, payload_times

L = "left_id long, entity string, t long, bucket string"
R = "right_id long, entity string, t long, prev string"


def brute(left, right, tolerance):
    out = set()
    for i, e, t, _ in left:
        near = [(abs(t - u), u, j) for j, f, u, _ in right if None not in (e, t, f, u) and f == e and abs(t - u) <= tolerance]
        if near:
            out.add((i, min(near)[2]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.randrange(400), rng.randrange(400), rng.randrange(-50, 50)]))
    left = [(i, *pick(), "x") for i in range(150)]
    right = [(i, *pick(), "y") for i in rng.sample(range(1000), 200)]
    right += right[:20]
    got = match_nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), 7, bucket_us=20).select("left_id", "right_id").collect()
    assert {tuple(r) for r in got} == brute(left, right, 7)
    assert len(got) == len({r.left_id for r in got})


def test_ties(spark):
    left = spark.createDataFrame([(1, "a", 100, "")], L)
    right = spark.createDataFrame([(9, "a", 95, ""), (8, "a", 95, ""), (1, "a", 105, "")], R)
    assert [tuple(r) for r in match_nearest(left, right, 5, 10).collect()] == [(1, 8, 5)]
    exact = spark.createDataFrame([(7, "a", 100, ""), (6, "a", 100, ""), (5, "a", 101, "")], R)
    assert [tuple(r) for r in match_nearest(left, exact, 5, 10).collect()] == [(1, 6, 0)]


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 1, "")], L), spark.createDataFrame([], R)
    assert match_nearest(left, right, 5).count() == 0
    assert match_nearest(left.limit(0), spark.createDataFrame([(1, "a", 1, "")], R), 5).count() == 0


def test_spellings(spark):
    df = spark.createDataFrame([(x,) for x in (" abc/usdt", "ABC-USDT ", "abc_usdt", "ABCUSDT", "Abc Usdt", None)], "s string")
    assert {r[0] for r in df.select(entity_key(df.s)).collect()} == {"ABCUSDT", None}


@pytest.mark.parametrize(
    "payload, expected",
    [
        (None, []), ("", []), ("{", []), ('{"symbol": "A"}', []), ('{"time": 1577836800000}', []), ('{"symbol": "A", "time": NaN}', []),
        ('{"symbol": "A", "nextFundingTime": 1577836800000}', []),
        ('{"symbol": "A", "time": 1577836800000}', [("A", 1577836800000000)]), ('{"symbol": "A", "time": "1577836800"}', [("A", 1577836800000000)]),
        ('{"symbol": "A", "time": "2020-01-01T00:00:00Z"}', [("A", 1577836800000000)]), ('{"e": "x", "E": 1577836800001, "s": "A", "T": 5}', [("A", 1577836800001000)]),
        ('{"stream": "a@x", "data": {"symbol": "A", "time": 1577836800000}}', [("A", 1577836800000000)]),
        ('[{"symbol": "A", "time": 1577836800000}, {"symbol": "B", "time": 1577836801000}]', [("A", 1577836800000000), ("B", 1577836801000000)]),
        ('{"serverTime": 1577836800000, "symbols": [{"symbol": "A"}, {"symbol": "B"}]}', [("A", 1577836800000000), ("B", 1577836800000000)]),
        ("[1, 2]", []), ('"text"', []), ("[" * 100_000, []),
    ],
)
def test_payloads(payload, expected):
    assert sorted(payload_times(payload)) == expected


def test_funding(spark):
    f = spark.createDataFrame([(1, "a/b", 1577836800), (2, "AB", 0), (3, None, 5), (4, "AB", None), (5, "ab ", 1577836800500)], "funding_id long, symbol string, next_funding_time long")
    b = spark.createDataFrame([(10, "AB", 1577836800), (11, "AB", 1577836921), (12, None, 1)], "bar_id long, symbol string, s long").selectExpr("bar_id", "symbol", "timestamp_seconds(s) AS open_time")
    r = spark.createDataFrame([(20, 200, '{"symbol":"A-B","time":1577836890000}', "x"), (21, 500, '{"symbol":"AB","time":1577836800000}', "x"), (22, 200, None, "x")], "response_id long, status_code int, payload string, t string")
    got = {tuple(x) for x in match_funding(f, b, r).select("funding_id", "side", "match_id").collect()}
    assert got == {(1, "bar", 10), (5, "bar", 10), (1, "response", 20), (5, "response", 20)}
