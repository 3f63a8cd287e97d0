from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from quartzbar.operators import asof, backtest, bar_features, external_features, labels, recursive_features, regimes, scan, splits, statistics, timeframes, timeline
from quartzbar.sources.bar_files import synthetic_bars


@pytest.fixture(scope="module")
def series(spark):
    return timeline.canonical(timeline.valid_bars(synthetic_bars(spark, 600))).cache()


def frame(df, *by):
    return df.toPandas().sort_values(list(by or ("symbol", "idx"))).reset_index(drop=True)


def test_gap_repair(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("S", t0 + timedelta(minutes=m), 100000.0 + 10 * i, 100020.0 + 10 * i, 99980.0 + 10 * i, 100005.0 + 10 * i, 10.0 + i, None, None, None, None, None, i) for i, m in enumerate((0, 1, 2, 5, 6, 7))]
    rows += [("S", t0 + timedelta(minutes=5), 1.0, 1.0, 1.0, 1.0, 1.0, None, None, None, None, t0, 99), ("S", t0, -1.0, 1.0, 1.0, 1.0, 1.0, None, None, None, None, t0, 100)]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, number_of_trades long, taker_buy_base_volume double, taker_buy_quote_volume double, ingested_at timestamp, bar_id long")
    p = frame(timeline.canonical(timeline.valid_bars(df)))
    assert p.gap_flag.tolist() == [0, 0, 0, 1, 1, 0, 0, 0] and p.gap_length.tolist() == [0, 0, 0, 1, 2, 0, 0, 0]
    assert p.close[3] == p.close[2] == p.high[4] and p.volume[3] == 0
    assert p.close[5] == 1.0  # the last delivered of a minute
    c = timeline.validation_counts(df).first()
    assert (c["rows"], c.valid, c.not_positive) == (8, 7, 1)
    assert timeline.canonical(timeline.valid_bars(df.limit(0))).count() == 0


def test_gaps_across_days(spark):
    days = [0, 3, 9]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i long, d int").selectExpr("'S' AS symbol", "d * 1440L AS m", *(f"CAST(1 + i AS DOUBLE) AS {c}" for c in (*timeline.PRICES, *timeline.VOLUMES)))
    p = frame(timeline.canonical(rows))
    assert len(p) == 9 * 1440 + 1 and p.gap_flag.sum() == len(p) - 3 and p.idx.tolist() == list(range(len(p)))
    assert [r.day for r in timeline.missing_days(rows).sort("day").collect()] == [1, 2, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("size", [64, 100])
def test_chunks_do_not_matter(series, monkeypatch, size):
    families = ("returns", "trend", "range", "zscores")
    whole = frame(bar_features.with_features(series, *families))
    monkeypatch.setattr(bar_features, "in_chunks", lambda rows: timeline.in_chunks(rows, before=size, size=size) if size >= 128 else timeline.in_chunks(rows, before=256, size=256))
    assert np.allclose(frame(bar_features.with_features(series, *families)).drop(columns="symbol"), whole.drop(columns="symbol"), atol=1e-12)


def test_known_values(series):
    p, f = frame(series), frame(bar_features.with_features(series, "returns", "trend", "volatility"))
    c = p.close.to_numpy()
    assert np.allclose(f.return_5[5:], c[5:] / c[:-5] - 1) and (f.return_5[:5] == 0).all()
    assert np.allclose(f.close_sma_20_ratio[19:], c[19:] / pd.Series(c).rolling(20).mean()[19:] - 1) and (f.close_sma_20_ratio[:19] == 0).all()
    r = np.concatenate([[0], c[1:] / c[:-1] - 1])
    assert np.allclose(f.rv_15[15:], pd.Series(r).rolling(15).std(ddof=0)[15:]) and (f.rv_15[:15] == 0).all()


def naive_rsi(c, n):
    out, g, lo = [50.0] * min(len(c), n), 0.0, 0.0
    for i in range(1, len(c)):
        up, down = max(c[i] - c[i - 1], 0), max(c[i - 1] - c[i], 0)
        if i <= n:
            g, lo = g + up / n, lo + down / n
        else:
            g, lo = (g * (n - 1) + up) / n, (lo * (n - 1) + down) / n
        if i >= n:
            out.append(100 - 100 / (1 + g / lo) if lo else 100.0 if g else 50.0)
    return out


def test_recursions(series):
    c = frame(series).close.to_numpy()
    e, want = c[0], []
    for x in c:
        e = 2 / 13 * x + 11 / 13 * e
        want.append(e)
    assert np.allclose(recursive_features.ema(c, 12), want)
    assert np.allclose(recursive_features.wilder_rsi(c, 14), naive_rsi(c, 14))
    assert recursive_features.wilder_rsi(np.ones(5), 7).tolist() == [50.0] * 5 and recursive_features.wilder_rsi(np.ones(20), 7).tolist() == [50.0] * 20
    x = np.random.default_rng(0).uniform(1, 2, 40)
    assert np.isclose(recursive_features.slope_over(x, 10)[25], np.polyfit(range(10), x[16:26], 1)[0] / x[25])


def test_chunked_recursions_forget(spark, monkeypatch):
    long = timeline.canonical(timeline.valid_bars(synthetic_bars(spark, 6000)))
    whole = frame(recursive_features.with_recursive_features(long))
    monkeypatch.setattr(recursive_features, "in_chunks", lambda rows, before: timeline.in_chunks(rows, before=before, size=1600))
    parts = frame(recursive_features.with_recursive_features(long))
    assert np.allclose(parts.drop(columns="symbol"), whole.drop(columns="symbol"), rtol=1e-11, atol=1e-11)


def test_prefix_invariance_of_timeframes(series):
    """What a minute shows must not change when later minutes come."""
    whole = frame(timeframes.onto_minutes(series, "15m"))
    part = frame(timeframes.onto_minutes(series.where("idx <= 431"), "15m"))
    assert np.allclose(part.drop(columns="symbol"), whole[:432].drop(columns="symbol"))


def test_weekly_is_known_on_monday(spark):
    m0 = 26297280 // 10080 * 10080 + 4 * 1440
    rows = spark.range(60 * 7).selectExpr("'S' AS symbol", f"{m0} + id * 1440 AS m", "id * 1440 AS idx", "CAST(100 + id AS DOUBLE) AS close")
    p = frame(timeframes.weekly_onto_minutes(rows))
    sunday, monday = p[p.idx == (51 * 7 - 1) * 1440].iloc[0], p[p.idx == 51 * 7 * 1440].iloc[0]
    closes = np.array([100.0 + 7 * w + 6 for w in range(60)])
    assert np.isclose(monday.close_vs_weekly_ma50, (100 + 51 * 7) / closes[1:51].mean() - 1) and np.isclose(sunday.close_vs_weekly_ma50, (100 + 51 * 7 - 1) / closes[:50].mean() - 1)
    assert (frame(timeframes.weekly_onto_minutes(rows.where("idx < 1440 * 7 * 49"))).drop(columns=["symbol", "idx"]) == 0).all().all()


@pytest.mark.parametrize(
    "high, low, open_, close, gap, label, reason",
    [
        (100.11, 99.99, 100.0, 100.05, 0, 1, "tp_first"), (100.05, 99.9, 100.0, 99.95, 0, 0, "sl_first"), (100.05, 99.9, 100.0, 99.95, 1, 0, "gap_cross_sl"), (100.2, 99.9, 100.0, 100.05, 0, 1, "tp_first"),
        (100.2, 99.9, 100.05, 100.0, 0, 0, "sl_first"), (100.2, 99.9, 100.0, 100.0, 0, 0, "ambiguous_path"), (100.05, 99.99, 100.0, 100.0, 0, 0, "timeout_no_tp"), (100.05, 99.99, 100.0, 100.0, 1, 0, "gap_cross_timeout"),
    ],
)
def test_barriers(high, low, open_, close, gap, label, reason):
    p = pd.DataFrame({"symbol": "S", "idx": range(4), "open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "gap_flag": 0, "core": True})
    p.loc[2, ["open", "high", "low", "close"]] = open_, high, low, close
    p.loc[2, "gap_flag"] = gap
    got = labels.of_chunk(3, 0.001, 0.0005, 0.001, p)
    assert len(got) == 1 and (got.label[0], got.label_reason[0]) == (label, reason)


def test_hysteresis_in_chunks(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 3, 2000)
    codes[500:1200] = 1
    codes[501:1200:2] = 2  # a stretch that never settles
    table, states = regimes.hysteresis(3)
    rows = spark.createDataFrame([("S", i, int(c)) for i, c in enumerate(codes)], "symbol string, idx long, c int")
    got = frame(scan.scan(rows, [scan.Machine("c", table, [str(s[0]) if s else "" for s in states], "stable")], size=97)).stable.astype(int).tolist()
    stable, cand, n, want = None, None, 0, []
    for c in codes:
        if stable is None or c == stable:
            stable, cand, n = c if stable is None else stable, None, 0
        else:
            n = n + 1 if c == cand else 1
            cand = c
            if n >= 3:
                stable, cand, n = c, None, 0
        want.append(int(stable))
    assert got == want
    runs = {(r.stable, r.rows, r.entries) for r in regimes.diagnostics(spark.createDataFrame([("S", i, str(s)) for i, s in enumerate(want)], "symbol string, idx long, stable string"), "stable").collect()}
    assert sum(r[1] for r in runs) == 2000 and sum(r[2] for r in runs) == 1 + sum(a != b for a, b in zip(want, want[1:]))


@pytest.mark.parametrize("pause", [0, 2])
def test_backtest_against_a_walk(spark, monkeypatch, pause):
    rng = np.random.default_rng(4)
    n = 700
    close = 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))
    open_ = np.concatenate([[100], close[:-1]])
    rows = [("S", i, float(o), float(max(o, c) * 1.0008), float(min(o, c) * 0.9992), float(c), int(s)) for i, (o, c, s) in enumerate(zip(open_, close, rng.choice([0, 0, 1, -1], n)))]
    df = spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double, signal int")
    monkeypatch.setattr(backtest, "in_chunks", lambda r, before, after: timeline.in_chunks(r, before, after, size=100))
    got = [(t.entry_idx, t.exit_idx, t.reason) for t in backtest.backtest(df, horizon=20, pause=pause).sort("entry_idx").collect()]
    want, i = [], 0
    while i < n:
        _, _, _, _, _, c, s = rows[i]
        if not s:
            i += 1
            continue
        up, down = c * (1 + (0.004 if s > 0 else 0.002)), c * (1 - (0.002 if s > 0 else 0.004))
        exit_, why = min(i + 20, n - 1), "horizon" if i + 20 < n else "end"
        for k in range(i + 1, min(i + 20, n - 1) + 1):
            _, _, o, h, lo, x, _ = rows[k]
            if h >= up or lo <= down:
                both = h >= up and lo <= down
                takes_up = (x > o if s > 0 else not x < o) if both else h >= up
                exit_, why = k, "take_profit" if takes_up == (s > 0) else "stop_loss"
                break
        want.append((i, exit_, why))
        i = max(exit_ + (pause + 1 if pause else 0), i + 1)
    assert got == want and len(got) > 20


def test_breakdown_adds_up(spark):
    t = spark.createDataFrame([("S", 1, "take_profit", 0.01), ("S", -1, "stop_loss", -0.02), ("T", 1, "horizon", 0.0)], "symbol string, side int, reason string, net double")
    b = backtest.breakdown(t).collect()
    total = next(r for r in b if (r.symbol, r.side, r.reason) == ("all", "all", "all"))
    assert total.trades == 3 and abs(total.compounded - (1.01 * 0.98 - 1)) < 1e-12
    assert sum(r.trades for r in b if r.symbol != "all") == 3


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 50, 900).astype(float), [np.nan] * 5])
    rows = spark.createDataFrame([("S" if i % 3 else "T", i, float(v)) for i, v in enumerate(x)], "symbol string, idx long, v double")
    p = asof.mean_ranks(rows, "symbol", "v", "r").toPandas()
    for _, g in p.groupby("symbol"):
        assert np.allclose(g.r, g.v.rank(), equal_nan=True)
    q = {r.symbol: r for r in asof.percentiles(rows, "symbol", {"a": ("v", 0.75), "b": ("v", 0.1), "c": ("v", 1.0)}).collect()}
    for s, g in p.dropna().groupby("symbol"):
        assert np.allclose([q[s].a, q[s].b, q[s].c], np.percentile(g.v, [75, 10, 100]))


def test_asof(spark):
    left = spark.createDataFrame([("a", t, t) for t in (0, 5, 10, 99, 1000)] + [(None, 5, -1), ("b", 3, -2)], "entity string, t long, k long")
    right = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 5, 2, 20.0), ("a", 11, 1, 30.0), ("b", 4, 1, 1.0), (None, 1, 1, 5.0)], "entity string, t long, n int, v double")
    got = {r.k: r.v for r in asof.asof_backward(left, right, ["v"], 7, ["n"]).collect()}
    assert got == {0: None, 5: 20.0, 10: 20.0, 99: 30.0, 1000: 30.0, -1: None, -2: None}


def test_purged_splits_against_pairs(spark):
    samples = [("S", i, i + 3) for i in range(40) if i % 7]
    got = splits.combinatorial_purged(spark.createDataFrame(samples, "symbol string, start long, `end` long"), 4, 2, 2).collect()
    by = {}
    for r in got:
        by.setdefault(r.split, {}).setdefault(r.role, []).append((r.start, r.end))
    assert len(by) == 6
    for roles in by.values():
        assert sum(map(len, roles.values())) == len(samples)
        assert not any(a <= y and x <= b for a, b in roles["test"] for x, y in roles["train"])


def test_weights_sum_to_covered_minutes_when_disjoint(spark):
    df = spark.createDataFrame([("S", 0, 3), ("S", 10, 13), ("S", 12, 15)], "symbol string, start long, `end` long")
    w = {r.start: r.weight for r in splits.uniqueness_weights(df).collect()}
    assert np.isclose(w[0], 1.0) and np.isclose(w[10], (2 + 2 / 2) / 4) and np.isclose(w[12], w[10])


def test_bootstrap(spark):
    rows = spark.range(5000).selectExpr("CAST(id % 11 AS DOUBLE) AS v")
    r = statistics.bootstrap_interval(rows, "v").first()
    assert r.n == 5000 and r.lower < r["mean"] < r.upper and r.upper - r.lower < 0.4


def _assigned(probabilities, names, unsure, n, confidence, after):
    out, current, pending, run = [], None, None, 0
    for i in range(len(probabilities)):
        window = probabilities[max(0, i - n + 1) : i + 1]
        means = [sum(p[k] for p in window) / len(window) for k in range(len(names))]
        best = max(range(len(names)), key=lambda k: means[k])
        sure = means[best] >= confidence
        if current is None:
            current = names[best] if sure else unsure
        elif names[best] == current or not sure:
            pending, run = None, 0
        else:
            pending, run = names[best], run + 1 if names[best] == pending else 1
            if run >= after:
                current, pending, run = names[best], None, 0
        out.append(current)
    return out


@pytest.mark.parametrize("first", [(0.2, 0.2, 0.6), (0.3, 0.3, 0.4)])
def test_assigned_regimes_against_a_loop(spark, first):
    rng = np.random.default_rng(5)
    level = np.repeat(rng.dirichlet([0.7] * 3, 180), rng.integers(5, 190, 180), axis=0)
    p = np.vstack([[first], rng.dirichlet([2.0] * 3, len(level)) * 0.3 + level * 0.7])
    names = ["down", "range", "up"]
    df = spark.createDataFrame(pd.DataFrame(p, columns=names).assign(symbol="S", idx=range(len(p))))
    got = frame(regimes.assigned(df.select("symbol", "idx", *names), names, "range"))
    want = _assigned(p.tolist(), names, "range", 30, 0.45, 60)
    assert len(p) > timeline.CHUNK and got.assigned.tolist() == want
    assert len(set(want)) == 3 and want != got.smoothed.tolist()


def _first_threshold(p, y, gain, loss):
    best, best_score = 0.5, None
    for t in sorted({round(i / 20, 2) for i in range(1, 20)} | {round(x, 4) for x in p.tolist()}):
        hit = p >= t
        if hit.sum() < max(1, len(p) // 20):
            continue
        pnl = np.where(hit, np.where(y == 1, gain, -loss), 0.0)
        run = np.cumsum(pnl)
        fall = (np.maximum.accumulate(np.maximum(run, 0.0)) - run).max()
        f1 = 2 * (hit & (y == 1)).sum() / (hit.sum() + (y == 1).sum()) if (hit & (y == 1)).any() else 0.0
        score = (pnl.sum() / fall if fall > 1e-12 else 0.0, pnl.mean() / pnl.std() * len(p) ** 0.5 if pnl.std() > 1e-12 else 0.0, f1)
        score = (*(round(x, 9) for x in score), -round(abs(t - 0.5), 4))
        if best_score is None or score > best_score:
            best, best_score = t, score
    return best, best_score


def test_threshold_ranking_against_all_candidates(spark):
    rng, parts, want = np.random.default_rng(3), [], {}
    for symbol, n, low, high, edge in (("A", 3000, 0.46, 0.54, 6.0), ("B", 3000, 0.0, 1.0, 0.5), ("C", 700, 0.49, 0.51, -9.0), ("D", 30, 0.0, 0.0003, 0.0), ("E", 40, 0.3, 0.9, 1.0)):
        p = rng.uniform(low, high, n)
        p[:9] = p[0].round(4)
        y = (rng.random(n) < np.clip(0.4 + edge * (p - 0.5), 0, 1)).astype(int) if symbol != "E" else np.ones(n, dtype=int)
        parts.append(pd.DataFrame({"symbol": symbol, "idx": range(n), "p": p, "y": y}))
        want[symbol] = _first_threshold(p, y, 0.0022, 0.0023)
    got = {r.symbol: r for r in statistics.threshold_ranking(spark.createDataFrame(pd.concat(parts)), 0.0022, 0.0023, size=500).collect()}
    assert {s: r.threshold for s, r in got.items()} == {s: t for s, (t, _) in want.items()}
    for s, (_, score) in want.items():
        assert score is None or (got[s].calmar, got[s].sharpe, got[s].f1) == pytest.approx(score[:3], abs=1e-7)
    assert any(round(r.threshold * 20, 6) % 1 for r in got.values())


def test_weights_within_a_day_of_a_change(spark):
    label = np.repeat(["up", "range", "down", "up"], [8192, 2, 5000, 4000])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "idx": range(len(label)), "direction": label}))
    got = frame(splits.transition_weights(df, "direction", 1440)).weight.to_numpy()
    at = np.arange(len(label))
    near = np.any([np.abs(at - c) <= 1440 for c in (8192, 8194, 13194)], axis=0)
    assert (got == np.where(near, 0.1, 1.0)).all()


def test_account_features(spark):
    rows = [("S", 0, 2.0, 1.5, 0.0), ("S", 1, 3.0, 1.25, 4.0), ("S", 2, 1.5, 1.0, 3.0)]
    ticks = spark.createDataFrame(rows, "symbol string, idx long, count_toptrader_long_short_ratio double, sum_toptrader_long_short_ratio double, count_long_short_ratio double")
    got = frame(external_features.account_features(ticks))
    assert got.toptrader_ls_account.tolist() == [2.0, 3.0, 1.5] and got.toptrader_ls_position.tolist() == [1.5, 1.25, 1.0] and got.global_ls_account.tolist() == [0.0, 4.0, 3.0]
    assert got.toptrader_ls_account_change_5m.tolist() == [0.0, 0.5, -0.5] and got.global_ls_account_change_5m.tolist() == [0.0, 0.0, -0.25]
