from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzbar.operators import bar_features, controls, quality, regimes, rule_regimes, timeline
from quartzbar.operators.scan import Machine, scan, start_states


def walk(rows, hold):
    """The rule as a plain loop over (proposals, bypass)."""
    regime, held, out = None, 0, []
    for proposals, bypass in rows:
        new = proposals[0] if regime is None else proposals[1 + regime]
        if regime is None:
            regime, held = new, 0
        elif new != regime and (bypass or held >= hold):
            regime, held = new, 0
        else:
            held += 1
        out.append(rule_regimes.CLASSES[regime])
    return out


def test_rule_machine_against_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        if rng.random() < 0.02:
            d = int(rng.integers(1, 3))
            rows.append(([d] * 4, True))
        else:
            rows.append((rng.integers(0, 3, 4).tolist(), False))
    table, states = rule_regimes.machine(7)
    codes = [("S", i, b * 81 + p[0] * 27 + p[1] * 9 + p[2] * 3 + p[3]) for i, (p, b) in enumerate(rows)]
    df = spark.createDataFrame(codes, "symbol string, idx long, code int")
    got = scan(df, [Machine("code", table, [rule_regimes.CLASSES[s[0]] if s else "" for s in states], "regime")], size=64)
    assert [r.regime for r in got.sort("idx").collect()] == walk(rows, 7)


def test_rule_regimes_of_a_trend(spark):
    cols = [*rule_regimes.FEATURES, *rule_regimes.FLAGS]
    up = {f: 1.0 for f in rule_regimes.FEATURES}
    rows = [("S", i, *(float(up.get(c, 0.0)) * (1 if i >= 200 else -1) if c in rule_regimes.TREND or c in rule_regimes.FAST else (1.0 if i % 2 else 1.5) if c in rule_regimes.VOLATILITY else 0.0 for c in cols)) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, idx long, " + ", ".join(f"{c} double" for c in cols))
    got = [r.regime for r in rule_regimes.with_rule_regimes(df, hold=5).sort("idx").collect()]
    assert "down" in got[:200] and "up" in got[200:] and "up" not in got[:200]


def test_runs_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(regimes, "CHUNK", 10)
    labels = ["a"] * 25 + ["b"] * 3 + ["a"] * 2 + ["b"] + ["a"] * 4 + ["b"] * 30
    df = spark.createDataFrame([("S", i, x) for i, x in enumerate(labels)], "symbol string, idx long, l string")
    got = {r.l: (r.rows, r.entries, r.longest_run) for r in regimes.diagnostics(df, "l").collect()}
    assert got == {"a": (31, 3, 25), "b": (34, 3, 30)}


@pytest.mark.parametrize(
    "group, ratio, run, live, action",
    [
        ("safety_features", 1.0, 9, False, "keep_as_state"), ("volatility_features", 0.05, 0, False, "drop_sample"), ("volatility_features", 0.04, 0, False, "allow"),
        ("price_return_features", 0.0, 3, False, "drop_sample"), ("price_return_features", 0.0, 3, True, "block_new_entries"), ("x", 0.2, 0, True, "block_new_entries"),
        ("x", 0.1, 0, True, "warn"), ("x", 0.09, 0, True, "allow"), ("x", 0.1, 0, False, "drop_sample"),
    ],
)
def test_gap_policy(spark, group, ratio, run, live, action):
    df = spark.createDataFrame([(ratio, run)], "r double, n int")
    assert df.select(quality.gap_action(group, df.r, df.n, live)).first()[0] == action


def test_correlated_features(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([("S", i, float(a), float(a**3), float(b), -float(a)) for i, (a, b) in enumerate(zip(x, y))], "symbol string, idx long, a double, b double, c double, d double")
    assert [r.feature for r in quality.correlated_features(df, ["a", "b", "c", "d"]).collect()] == ["b", "d"]
    flat = df.selectExpr("symbol", "idx", "a", "1.0D AS b")
    assert quality.correlated_features(flat, ["a", "b"]).count() == 0


def test_folds_never_see_the_future(spark):
    counts = spark.createDataFrame([("S", 103), ("T", 3), ("U", 1)], "symbol string, n long")
    rows = quality.walk_forward_folds(counts, 5, 10).collect()
    assert all(r.train_end <= max(r.start - 10, 0) and r.start < r.stop for r in rows)
    assert sum(r.stop - r.start for r in rows if r.symbol == "S") == 103 - 20


def test_paid_in_against_pairs(spark):
    rng = np.random.default_rng(1)
    trades = [("S", int(a), int(a + n), int(s)) for a, n, s in zip(np.unique(rng.integers(0, 900, 60)), rng.integers(0, 200, 60), rng.choice([-1, 1], 60))]
    events = [("S", int(t), float(r)) for t, r in zip(rng.integers(0, 1100, 80), rng.normal(size=80))] + [("T", 5, 1.0)]
    got = quality.paid_in(spark.createDataFrame(trades, "symbol string, entry_idx long, exit_idx long, side int"), spark.createDataFrame(events, "symbol string, at long, rate double")).collect()
    assert len(got) == len(trades)
    for r in got:
        assert np.isclose(r.paid, -r.side * sum(x for s, t, x in events if s == "S" and r.entry_idx < t <= r.exit_idx))


def test_in_time(spark):
    df = spark.sql("SELECT explode(array(timestamp'2020-01-01 00:00:00', timestamp'2020-01-02 00:00:00', timestamp'2020-01-02 23:59:59', timestamp'2020-01-03 00:00:00')) AS t")
    n = lambda *a, **k: quality.in_time(df, "t", *a, **k).count()
    assert n("2020-01-02", "2020-01-02") == 2 and n(None, "2020-01-02 00:00:00") == 1 and n(None, "2020-01-02 00:00:00", end_included=True) == 2 and n(None, None) == 4


def test_accuracy_changes(spark):
    df = spark.createDataFrame([("S", i, float(i % 2), 0.5, i % 2) for i in range(10)], "symbol string, start long, a double, b double, y int")
    turned = quality.reversed_columns(df, ["a"])
    assert [r.rev_a for r in turned.sort("start").collect()] == [float((9 - i) % 2) for i in range(10)]
    probability = lambda c: c["a"] * 0.9 + c["b"] * 0.1
    got = quality.accuracy_changes(turned, probability, ["a", "b"], "y", {"a": F.col("rev_a"), "b": F.lit(0.5)})
    assert {r.feature: (r.baseline, r.changed) for r in got.collect()} == {"a": (1.0, 0.0), "b": (1.0, 1.0)}


def test_chunks_cover_every_row_once(spark):
    rows = spark.range(1000).selectExpr("'S' AS symbol", "id AS idx")
    got = timeline.in_chunks(rows, before=30, after=20, size=64)
    assert got.where("core").count() == 1000 and got.groupBy("chunk").count().agg({"count": "max"}).first()[0] == 64 + 30 + 20


def test_spaced_rows_against_a_loop(spark):
    rng = np.random.default_rng(9)
    flags = (rng.random(20_000) < 0.4).astype(int)
    flags[:3] = flags[8190:8196] = 1
    want, last = [], -5
    for i, x in enumerate(flags):
        if x and i - last >= 5:
            want.append(i)
            last = i
    rows = spark.range(len(flags)).selectExpr("'S' AS symbol", "id AS idx").join(
        spark.createDataFrame([(i, int(x)) for i, x in enumerate(flags)], "idx long, c int"), "idx"
    )
    assert sorted(r.idx for r in controls.spaced(rows, "c").collect()) == want


def test_order_blocks_are_spaced_and_take_the_side_of_the_candle(spark):
    t0 = datetime(2026, 1, 1)
    strong = {25: -8.0, 27: 8.0, 29: 8.0, 30: 8.0, 34: -8.0, 35: 8.0, 37: 0.0}  # bodies; all but one of them with net buying
    rows = []
    for i in range(45):
        body, volume = strong.get(i, 1.0), 200.0 if i in strong else 10.0 + i % 3
        share = 0.5 if i not in strong else 0.05 if i == 30 else 0.9
        rows.append(("S", t0 + timedelta(minutes=i), 1000.0, 1001 + max(body, 0.0), 999 + min(body, 0.0), 1000 + body, volume, volume, 9, volume * share, volume * share, t0, i))
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, number_of_trades long, taker_buy_base_volume double, taker_buy_quote_volume double, ingested_at timestamp, bar_id long")
    f = bar_features.with_features(timeline.canonical(timeline.valid_bars(df)), "zscores", "activity", keep=("open", "high", "low", "close"))
    blocks = controls.order_blocks(f)
    assert sorted((r.idx, r.side) for r in blocks.collect()) == [(25, "bearish"), (30, "bullish"), (35, "bullish")]
    entries = {r.idx: (r.block_idx, r.signal, round(r.confidence, 6)) for r in controls.zone_entries(f, blocks).collect()}
    # Its own candle is in a block's zone; the rows after it are near 1001, in the zones of all of them; the latest wins.
    assert entries[25] == (25, "SELL", round(0.8 * 0.8 + 0.2, 6)) and entries[36][:2] == (35, "BUY") and entries[36][2] == 0.2 and 45 not in entries and 24 not in entries


def test_composed_maps_against_a_loop(spark):
    rng = np.random.default_rng(4)
    maps = {s: [[int(x) for x in rng.integers(0, 5, 5)] for _ in range(n)] for s, n in (("a", 1), ("b", 37), ("c", 9))}
    rows = [(s, i, m) for s, listed in maps.items() for i, m in enumerate(listed)]
    df = spark.createDataFrame(rows, "symbol string, chunk long, ends array<int>")
    want = {}
    for s, listed in maps.items():
        state = 0
        for i, m in enumerate(listed):
            want[s, i] = state
            state = m[state]
    for group, levels in ((2, 0), (2, 3), (3, 2), (64, 2)):
        assert {(r.symbol, r.chunk): r.start for r in start_states(df, 5, group, levels).collect()} == want
