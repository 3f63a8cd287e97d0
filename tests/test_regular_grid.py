from datetime import datetime, timedelta

import numpy as np
import pytest

from quartzbar.operators.regular_grid import local_linear, regular_grid

T0 = datetime(2020, 1, 1)
B = "bar_id long, symbol string, open_time timestamp, close double, volume double, ingested_at timestamp, block string"
W = "window_id long, symbol string, start_time timestamp, end_time timestamp, kind string"


def test_a_line_is_met_exactly():
    t = np.sort(np.random.default_rng(0).uniform(0, 100, 300))
    grid = np.arange(5.0, 95.0)
    fit, support, n = local_linear(grid, t, np.column_stack([3 * t + 1, -t]), 4.0)
    assert np.allclose(fit[:, 0], 3 * grid + 1) and np.allclose(fit[:, 1], -grid) and (support <= n).all()


def test_nothing_and_single_readings():
    fit, support, n = local_linear(np.array([0.0, 5.0]), np.array([0.5]), np.array([[7.0]]), 2.0)
    assert fit[0, 0] == 7.0 and np.isnan(fit[1, 0]) and support.tolist() == [1.0, 0.0] and n.tolist() == [1, 0]
    assert np.isnan(local_linear(np.array([0.0]), np.zeros(0), np.zeros((0, 1)), 1.0)[0]).all()


def bar(i, s, seconds, close=1.0, volume=2.0, came=0):
    return (i, s, T0 + timedelta(seconds=seconds) if seconds is not None else None, close, volume, T0 + timedelta(seconds=came) if came is not None else None, "clash")


def window(i, s, a, b):
    return (i, s, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), "clash")


def grid(spark, bars, windows, **k):
    return {(r.symbol, r.minute_ms // 60000 - 26297280): r for r in regular_grid(spark.createDataFrame(bars, B), spark.createDataFrame(windows, W), **k).collect()}


def test_minutes_rounding_and_marks(spark):
    bars = [bar(1, "a", 29.999), bar(2, "a", 90.0), bar(3, "a", 180, None), bar(4, "a", 240, float("nan")), bar(5, "a", 300, 4.0, 1.0), bar(6, "a", 300, 9.0, 1.0, 50), bar(7, "a", None), bar(8, None, 60), bar(9, "b", 0)]
    got = grid(spark, bars, [window(1, "a", 0, 7), window(2, "a", 100, 102), window(3, "a", 5, 5), window(4, None, 0, 3)])
    assert sorted(k[1] for k in got) == [0, 1, 2, 3, 4, 5, 6, 100, 101]
    assert {m for (_, m), r in got.items() if r.missing} == {1, 3, 4, 6, 100, 101}
    assert got["a", 5].close == 9.0 and got["a", 5].status == "read"
    assert got["a", 3].status == "filled" and got["a", 3].close is not None and got["a", 100].status == "missing" and got["a", 100].close is None


@pytest.mark.parametrize("block", [8, 60, 1440])
def test_blocks_do_not_matter(spark, block):
    rng = np.random.default_rng(3)
    bars = [bar(i, "a", float(x), float(x), 1.0) for i, x in enumerate(rng.uniform(0, 300 * 60, 200))]
    rows = grid(spark, bars, [window(1, "a", 0, 300)], block_min=block)
    whole = grid(spark, bars, [window(1, "a", 0, 300)], block_min=1440)
    assert rows.keys() == whole.keys()
    for k, r in rows.items():
        assert r.status == whole[k].status and r.readings == whole[k].readings and (r.close is None or abs(r.close - whole[k].close) < 1e-6)


def test_empty(spark):
    assert grid(spark, [], [window(1, "a", 0, 2)]).keys() == {("a", 0), ("a", 1)}
    assert grid(spark, [bar(1, "a", 0)], []) == {}
    assert grid(spark, [], []) == {}


def test_repeated_and_overlapping_windows(spark):
    assert len(grid(spark, [bar(1, "a", 0)] * 3, [window(1, "a", 0, 3), window(1, "a", 0, 3), window(2, "a", 2, 4)])) == 4
