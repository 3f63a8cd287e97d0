from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from quartzbar.operators.spikes import additive_outliers, implausible_readings, in_blocks, run_lengths

T0 = datetime(2020, 1, 1)


def bars(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 4e-4, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    top, bottom = np.maximum(open_, close), np.minimum(open_, close)
    high, low = top * (1 + rng.exponential(2e-4, n)), bottom * (1 - rng.exponential(2e-4, n))
    volume = np.round(np.exp(rng.normal(3, 0.5, n)), 3)
    p = pd.DataFrame({"symbol": "A", "open": open_, "high": high, "low": low, "close": close, "volume": volume, "quote_volume": volume * (open_ + close) / 2})
    p["number_of_trades"] = (volume * 3).astype("int64") + 1
    p["taker_buy_base_volume"] = volume * 0.5
    p["open_time"] = [T0 + timedelta(minutes=i) for i in range(n)]
    p["bar_id"] = np.arange(n)
    p["block"] = "clash"
    return p


def depth(n=600, seed=2):
    rng = np.random.default_rng(seed)
    mid = 50 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))
    p = pd.DataFrame({"symbol": "A", "best_bid": mid * (1 - 1e-4 * rng.uniform(0.5, 2, n)), "best_ask": mid * (1 + 1e-4 * rng.uniform(0.5, 2, n))})
    p["snapshot_time"] = [T0 + timedelta(seconds=45 * i) for i in range(n)]
    p["snapshot_id"] = np.arange(n)
    return p


def found(spark, b, d):
    schema_b = "symbol string, open double, high double, low double, close double, volume double, quote_volume double, number_of_trades long, taker_buy_base_volume double, open_time timestamp, bar_id long, block string"
    schema_d = "symbol string, best_bid double, best_ask double, snapshot_time timestamp, snapshot_id long"

    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x == -999):
            return None
        return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x

    rows = lambda p, s: spark.createDataFrame([tuple(map(plain, r)) for r in p.astype(object).itertuples(index=False)], s)
    got = implausible_readings(rows(b, schema_b), rows(d, schema_d)).collect()
    return {(r.src, r.row_id, r.field) for r in got}


def test_planted_cases(spark):
    b, d = bars(), depth()
    b.loc[500, "high"] *= 1.3
    b.loc[900, "low"] *= 0.7
    b.loc[1300, "volume"] *= 400
    b.loc[1500, "volume"] = 0.0
    b.loc[1600, "volume"] = -1.0
    b.loc[1700, "high"] = b.loc[1700, "open"] * 0.9
    b.loc[2878:2890, "high"] = b.loc[2878:2890, ["open", "close"]].max().max() * 1.0001  # across a block's border
    # What the rest of the row bears out: a burst, a level move, minutes without trades.
    b.loc[2000, ["volume", "quote_volume"]] *= 50
    b.loc[2000, "number_of_trades"] *= 40
    b.loc[2100:, ["open", "high", "low", "close"]] *= 1.4
    b.loc[2100:, "quote_volume"] *= 1.4
    b.loc[2100, "open"] /= 1.4
    b.loc[2100, "low"] = b.loc[2100, "open"] * 0.999
    for i in range(2300, 2320):
        b.loc[i, ["open", "high", "low", "close"]] = b.loc[2299, "close"]
        b.loc[i, ["volume", "quote_volume", "number_of_trades", "taker_buy_base_volume"]] = 0
    d.loc[100, "best_bid"] *= 0.5
    d.loc[200, "best_bid"] = d.loc[200, "best_ask"] * 1.01
    d.loc[300:308, "best_bid"] = d.loc[300:308, "best_bid"].min()
    d.loc[400:410, "best_bid"], d.loc[400:410, "best_ask"] = 50.0, 50.01
    got = found(spark, b, d)
    stuck = {("bars", i, "high") for i in range(2878, 2891)}
    expected = {("bars", 500, "high"), ("bars", 900, "low"), ("bars", 1300, "volume"), ("bars", 1500, "volume"), ("bars", 1600, "volume"), ("bars", 1700, "high")} | stuck
    expected |= {("depth_snapshots", 100, "best_bid"), ("depth_snapshots", 200, "best_bid")} | {("depth_snapshots", i, "best_bid") for i in range(300, 309)}
    assert got == expected


def test_nulls_nans_repeats_and_empty(spark):
    b, d = bars(300), depth(100)
    b = b.astype({"volume": object, "number_of_trades": object, "close": object, "symbol": object, "open_time": object})
    b.loc[5, "volume"], b.loc[6, "number_of_trades"], b.loc[7, "close"], b.loc[8, "symbol"], b.loc[9, "open_time"], b.loc[10, "quote_volume"] = None, None, float("nan"), None, None, -999
    d.loc[3, "best_bid"] = -999
    again = pd.concat([b, b.iloc[[50]]])
    assert found(spark, again, d) == set()
    assert found(spark, b.iloc[:0], d.iloc[:0]) == set()
    assert found(spark, b.iloc[:1], d.iloc[:1]) == set()


def test_blocks_hold_every_row_once_as_core(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'hot', 'x') AS symbol", "id * 100000000 AS t", "id")
    got = in_blocks(rows, hours=13, halo=6)
    assert got.where("core").count() == 20_000 and got.where("core").select("id").distinct().count() == 20_000


def test_additive_outlier_but_not_level_shift():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 400)
    x[100] += 40
    x[250:] += 40
    for phi in (None, 0.0, 0.1):
        effect = np.abs(additive_outliers(x, phi)[0])
        assert effect[100] > 30 and (effect[240:260] < 20).all()


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 1.0, 2.0, 1.0]])
def test_run_lengths(values):
    v = np.array(values)
    n, s = run_lengths(v, np.ones(len(v)))
    assert n.tolist() == s.astype(int).tolist() == ([2, 2, 1, 1] if len(v) == 4 else [1] * len(v))
