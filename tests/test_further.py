import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzbar.functions.instants import interval_ms
from quartzbar.operators import asof, expanding, external_features, labels, learners, models, monitors, quality, regimes, rule_regimes, timeline, validation
from quartzbar.sources import bar_files

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=1500), rng.normal(size=1500)
    y = (x + 0.5 * z + rng.normal(0, 0.5, 1500) > 0).astype(int)
    c = np.where(x > 0.5, "up", np.where(x < -0.5, "down", "range"))
    rows = [("S", i, float(x[i]), float(z[i]), int(y[i]), int(x[i] > 0), str(c[i])) for i in range(1500)]
    return spark.createDataFrame(rows, "symbol string, idx long, x double, z double, y int, d int, c string").cache()


def hit_rate(rows, p, y):
    return rows.agg(F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int"))).first()[0]


@pytest.mark.parametrize("fit", [lambda r, f, y: learners.fit_trees(r, f, y, trees=10), learners.fit_logistic, learners.fit_centroid])
def test_held_out_accuracy(scored, fit):
    model = fit(scored.where("idx < 1000"), ["x", "z"], "y")
    held = model(scored.where("idx >= 1000"), "p")
    assert held.columns == [*scored.columns, "p"] and hit_rate(held, "p", "y") > 0.75


def test_stacking_and_blend(scored):
    base = lambda r, f, y: learners.fit_trees(r, f, y, trees=5)
    model = learners.fit_stacked(scored, ["x", "z"], "idx", "d", "y", base)
    assert hit_rate(model(scored.where("idx >= 1200"), "p"), "p", "y") > 0.75
    with pytest.raises(ValueError, match="200"):
        learners.fit_stacked(scored.limit(50), ["x", "z"], "idx", "d", "y", base)
    parts = {30: learners.fit_logistic(scored, ["x"], "y"), 60: learners.fit_logistic(scored, ["z"], "y")}
    both = parts[60](parts[30](scored, "a"), "b")
    weights = learners.accuracy_edges(both, {30: ("a", "y"), 60: ("b", "y")})
    assert weights[30] > weights[60] >= 0
    p = learners.blended(parts, {30: 3.0, 60: 1.0})(scored, "p").join(both.select("idx", "a", "b"), "idx").first()
    assert abs(p.p - (0.75 * p.a + 0.25 * p.b)) < 1e-12
    for bad in ({30: -1.0, 60: 2.0}, {30: 0.0, 60: 0.0}, {30: float("nan"), 60: 1.0}, {30: 1.0}):
        with pytest.raises(ValueError):
            learners.blended(parts, bad)


def test_classes_keep_their_order(scored):
    classes = ["down", "range", "up"]
    out = learners.fit_classes(scored, ["x", "z"], "c", classes)(scored, "p")
    best = F.array_position("p", F.array_max("p")) - 1
    assert out.agg(F.avg((F.get(F.array(*map(F.lit, classes)), best) == F.col("c")).cast("int"))).first()[0] > 0.8
    two = learners.fit_classes(scored.where("c <> 'up'"), ["x", "z"], "c", classes)(scored.limit(1), "p").first().p
    assert len(two) == 3 and two[2] == 0.0


def test_fallback_chain(scored):
    assert learners.fit_first(scored, ["x"], "y", ("logistic", "centroid"))[0] == "logistic"
    assert learners.fit_first(scored.where("y = 1"), ["x"], "y")[0] == "centroid"
    with pytest.raises(ValueError):
        learners.fit_first(scored, ["x"], "y", ("forest",))


def test_calibrations(scored):
    p = scored.withColumn("p", F.lit(1) / (1 + F.exp(-6 * F.col("x"))))
    method, q = models.fit_calibration(p, "p", "y")
    brier = lambda c: F.avg((c - F.col("y")) * (c - F.col("y")))
    before, after = p.agg(brier(F.col("p")), brier(q)).first()
    assert method == "beta" and after < before
    assert models.fit_calibration(p.where("y = 1").limit(60).unionByName(p.where("y = 0").limit(60)), "p", "y")[0] == "platt"


def test_monitors(spark):
    df = spark.createDataFrame([(0,), (99,), (-100,), (500,), (1000,)], "x int")
    assert [r[0] for r in df.select(monitors.clock_action(F.col("x"))).collect()] == ["allow", "allow", "warn_only", "block_new_entries", "hard_kill"]
    ranks = spark.createDataFrame([(None,), (2,), (3,), (4,), (7,)], "x int")
    assert [r[0] for r in ranks.select(monitors.deleveraging_action(F.col("x"))).collect()] == ["allow", "allow", "reduce_size", "block_new_entries", "hard_kill"]
    f = spark.createDataFrame([(3.0, 0.0, 0.0), (60.0, 2.0, 1.0), (60.0, 1.0, 2.0), (60.0, 9.0, 0.0)], "m double, c double, e double")
    assert [r[0] for r in f.select(monitors.funding_action(F.col("m"), F.col("c"), F.col("e"))).collect()] == ["block_new_entries", "warn_only", "allow", "allow"]


def test_calculation_order():
    assert monitors.calculation_order({"c": ["b", "x"], "b": ["a"], "a": []}) == (True, ["a", "b", "c"])
    acyclic, order = monitors.calculation_order({"a": ["b"], "b": ["a"], "c": []})
    assert not acyclic and sorted(order) == ["a", "b", "c"]
    assert monitors.calculation_order({i: [i + 1] for i in range(5000)} | {5000: []})[0]


def test_parity_and_warm_ups(spark):
    required = spark.createDataFrame([("f", "klines"), ("f", "mark"), ("g", "klines")], "feature string, source string")
    have = spark.createDataFrame([("klines", True), ("mark", False)], "source string, live boolean")
    got = {r.feature: (r.missing, r.status) for r in monitors.feature_parity(required, have).collect()}
    assert got == {"f": (["mark"], "fallback_unavailable_source"), "g": ([], "available")}
    assert quality.warm_up() == 504_000 and quality.warm_up(200) == 165 and quality.warm_up(0) == 1
    rows = spark.range(30).selectExpr("'S' AS symbol", "id AS idx")
    assert quality.warm_rows(rows).where("warming").count() == 29
    assert quality.after_weekly_warm_up(rows.withColumn("label", F.lit(1)), rows).count() == 30
    assert quality.without_fallbacks([f"f{i}" for i in range(12)], {"f0"}) == [f"f{i}" for i in range(1, 12)] and len(quality.without_fallbacks(["a", "b"], {"a"})) == 2
    assert interval_ms("4h") == 14_400_000 and interval_ms("1M") == 2_592_000_000 and interval_ms("7m") == 60_000


def test_small_bars(spark):
    c = timeline.canonical(timeline.valid_bars(bar_files.small_bars(spark))).sort("idx").collect()
    assert [r.gap_flag for r in c] == [0, 0, 0, 1, 1, 0, 0, 0] and c[4].close == 100_025.0


def test_metrics_folder_onto_minutes(spark, tmp_path):
    line = lambda minute, oi: f"2026-01-01 00:{minute:02d}:00,FIXTURE,{oi},2,3,4,5,6"
    for name, lines in (("a.zip", ["create_time,symbol,a,b,c,d,e,f", line(0, 10), line(5, 11), "broken,row"]), ("b.zip", [line(5, 12)])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("m.csv", "\n".join(lines) + "\n")
    (tmp_path / "c.zip").write_bytes(b"no zip")
    ticks = bar_files.read_metrics_folder(spark, str(tmp_path))
    assert sorted((r.create_time.minute, r.sum_open_interest) for r in ticks.collect()) == [(0, 10.0), (5, 12.0)]
    late = ticks.where("create_time > timestamp'2026-01-01 00:01:00'")
    base = timeline.canonical(timeline.valid_bars(bar_files.small_bars(spark)))
    got = {r.idx: r for r in external_features.metrics_onto_minutes(base, ticks).collect()}
    assert len(got[0].asDict()) == 13 and got[4].oi_change_rate_5m == 0.0 and abs(got[5].oi_change_rate_5m - 0.2) < 1e-12 and got[7].global_ls_account == 5.0
    assert external_features.metrics_onto_minutes(base, late).where("idx = 3").first().taker_ls_ratio == 0.0


def test_nearest_asof_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(str(rng.choice(["hot", "a"])), int(t), i) for i, t in enumerate(rng.integers(0, 300, 120))] + [("none", 5, 998), (None, 5, 999)]
    right = [(str(rng.choice(["hot", "a"])), int(t), i) for i, t in enumerate(rng.integers(-50, 400, 40))] + [(None, 5, 77), ("a", None, 78)]
    want = {}
    for e, t, i in left:
        near = [(abs(t - u), u, -j) for f, u, j in right if None not in (e, f, u) and e == f]
        want[i] = -min(near)[2] if near else None
    ls, rs = spark.createDataFrame(left, "entity string, t long, i int"), spark.createDataFrame(right, "entity string, t long, j int")
    for block in (7, 1000):
        assert {r.i: r.v for r in asof.asof_nearest(ls, rs.withColumn("v", F.col("j")), ["v"], block, ["j"]).collect()} == want
    assert asof.asof_nearest(ls, rs.limit(0).withColumn("v", F.col("j")), ["v"], 7).where("v IS NOT NULL").count() == 0


def test_event_labels(spark):
    rows = spark.createDataFrame(
        [("S", i, T0 + timedelta(minutes=i), 1, "sl_first", 0.01 * (1 if i % 2 else -1)) for i in range(8)], "symbol string, idx long, open_time timestamp, label int, label_reason string, target_return double"
    )
    schema = "symbol string, idx long, open_time timestamp, label_reason string, label int"
    events = [("S", 0, None, "tp_first", None), ("S", 1, None, "no_fill", None), ("S", None, T0 + timedelta(minutes=2), "liquidation", 1), ("S", 3, None, "timeout_no_tp", None), ("S", 4, None, "gap_cross_timeout", None), ("S", 0, T0, "no_fill", None), ("X", 5, None, "no_fill", None)]
    got = {r.idx: (r.label, r.label_reason) for r in labels.external_labels(rows, spark.createDataFrame(events, schema)).collect()}
    assert got == {0: (0, "no_fill"), 1: (0, "no_fill"), 2: (1, "liquidation"), 3: (1, "timeout_no_tp"), 4: (0, "gap_cross_timeout"), 5: (1, "sl_first"), 6: (1, "sl_first"), 7: (1, "sl_first")}
    assert labels.external_labels(rows, spark.createDataFrame([], schema)).count() == 8
    for bad in (("S", 0, None, "luck", None), ("S", 0, None, "tp_first", 2), ("S", 0, None, None, 1)):
        with pytest.raises(Exception, match="unknown label or reason"):
            labels.external_labels(rows, spark.createDataFrame([bad], schema)).collect()
    with pytest.raises(ValueError):
        labels.with_target(rows, "luck")


def test_policy_and_empty_inputs(spark):
    rows = spark.createDataFrame([("S", 1, "up", 1, 0), ("S", 2, "range", 0, 1)], "symbol string, idx long, direction string, long_success int, short_success int")
    assert sorted((r.idx, r.side, r.target) for r in regimes.by_policy(rows, "direction").collect()) == [(1, "long", 1), (2, "long", 0), (2, "short", 1)]
    with pytest.raises(Exception, match="no policy for regime"):
        regimes.by_policy(rows.withColumn("direction", F.lit("sideways")), "direction").collect()
    none = spark.createDataFrame([], "symbol string, idx long, p double, y int, net double, entry_idx long, side int, close double, gap_flag int")
    assert validation.calibration_offset(none).count() == 0 and validation.order_interval(none, "p").count() == 0 and validation.shuffled_drawdowns(none, "net", 3).count() == 0
    assert validation.return_variance(none).count() == 0 and validation.head_to_head(none, none).count() == 0


def test_shuffled_drawdown_of_few(spark):
    rows = spark.createDataFrame([("S", i, x) for i, x in enumerate([0.5, -0.75, 0.5])], "symbol string, idx long, net double")
    r = validation.shuffled_drawdowns(rows, "net", 20).first()
    assert abs(r.own - 0.5) < 1e-12 and 0.375 - 1e-12 <= r.shuffled <= 0.75 + 1e-12


@pytest.mark.parametrize("confirm, hold", [(1, 0), (3, 4), (2, 60)])
def test_confirmed_rules_against_a_loop(confirm, hold):
    rng = np.random.default_rng(7)
    table, states = rule_regimes.machine(hold, confirm)
    current, held, pending, count, state = None, 0, None, 0, 0
    for code in rng.choice([0, 13, 26, 40, 67, 81 + 40, 80, 3 * 26], 4000):
        bypass, rest = divmod(int(code), 81)
        proposed = [rest // 27, rest // 9 % 3, rest // 3 % 3, rest % 3]
        candidate = proposed[0] if current is None else proposed[1 + current]
        if current is None:
            current = candidate
        elif candidate == current:
            held, pending, count = held + 1, None, 0
        else:
            pending, count = candidate, count + 1 if candidate == pending else 1
            if bypass or (held >= hold and count >= confirm):
                current, held, pending, count = candidate, 0, None, 0
            else:
                held += 1
        state = table[state, code]
        assert states[state][0] == current


def test_expanding_percentiles_against_numpy(spark):
    rng = np.random.default_rng(11)
    series = {"walk": np.cumsum(rng.normal(size=700)), "ties": rng.choice([0.0, 0.0, 0.0, 1.0, 2.5], 500), "one": np.array([3.0]), "fall": -np.arange(300.0), "same": np.zeros(260)}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)] + [("walk", 9_999, None), ("walk", 10_000, float("nan"))]
    df = spark.createDataFrame(rows, "symbol string, idx long, x double")
    got = {(r.symbol, r.idx): (r.a, r.b) for r in expanding.expanding_percentiles(df, "symbol", "x", {"a": 0.75, "b": 0.1}, size=97, buckets=16).collect()}
    want = {(k, i): (np.percentile(v[: i + 1], 75), np.percentile(v[: i + 1], 10)) for k, v in series.items() for i in range(len(v))}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    assert expanding.expanding_percentiles(df.limit(0), "symbol", "x", {"a": 0.75}).count() == 0


def test_position_features(spark):
    base = timeline.canonical(timeline.valid_bars(bar_files.small_bars(spark)))
    us = lambda minute: 1767225600000000 + minute * 60_000_000
    queue = spark.createDataFrame([("FIXTURE", us(2), 3.0), ("FIXTURE", us(6), 5.0), (None, us(0), 9.0)], "entity string, t long, quantile double")
    brackets = spark.createDataFrame([("FIXTURE", us(1), 50.0, 200.0), ("FIXTURE", us(5), 50.0, None)], "entity string, t long, notional double, cap double")
    got = [(r.adl_indicator, r.leverage_bracket_utilization) for r in external_features.position_features(base, queue, brackets).sort("idx").collect()]
    assert [a for a, _ in got] == [0, 0, 3, 3, 3, 3, 5, 5] and [round(u, 6) for _, u in got[:5]] == [0, 0.25, 0.25, 0.25, 0.25] and got[5][1] == 50.0 / 1e-12
