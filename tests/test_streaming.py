import json

from quartzbar.streaming.bars_stream import alerts, batch_gap_events, gap_events, gap_kind, latest_bars, read_kline_stream, unique_bars, windowed_bars

M0 = 26297280


def message(symbol, minute, close=1.5, closed=True):
    k = {"t": (M0 + minute) * 60_000, "o": "1", "h": "2", "l": "0.5", "c": str(close), "v": "10", "q": "15", "n": 3, "V": "5", "Q": "7.5", "x": closed}
    return json.dumps({"s": symbol, "k": k})


def run(spark, tmp_path, batches, transform, mode="append"):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    query = (
        transform(read_kline_stream(spark, str(folder))).writeStream.outputMode(mode)
        .foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    for i, lines in enumerate(batches):
        (tmp_path / f"{i}.part").write_text("\n".join(lines) + "\n")
        (tmp_path / f"{i}.part").rename(folder / f"{i}.txt")
        query.processAllAvailable()
    query.stop()
    return seen


def test_gap_events_as_at_rest(spark, tmp_path):
    minutes = [[0, 1, 3], [2, 1, 6], [7, 20, 9], [21]]
    batches = [[message("A", m) for m in b] + [message("B", 5), message("A", 500, closed=False), "broken"] for b in minutes]
    got = {(s, m - M0, n, k) for s, m, n, k in run(spark, tmp_path, batches, gap_events)}
    # Within a batch bars are put in order; a late bar of a later batch fills nothing.
    assert got == {("A", 2, 1, "gap"), ("A", 4, 2, "gap_cross_timeout"), ("A", 8, 1, "gap"), ("A", 10, 10, "stream_desync")}
    rest = spark.createDataFrame([("A", m) for m in (0, 1, 3, 6, 7, 9, 20, 21)], "symbol string, m long")
    assert {tuple(r) for r in batch_gap_events(rest).collect()} == got
    assert {(r.rule, r.minute) for r in alerts(batch_gap_events(rest)).collect()} == {("desync", 10), ("long_gap", 10)}
    assert [gap_kind(n) for n in (1, 2, 3)] == ["gap", "gap_cross_timeout", "stream_desync"]


def test_last_write_wins_in_the_buffer(spark, tmp_path):
    batches = [[message("A", m) for m in (0, 1, 2)], [message("A", 1, 9.0), message("A", 3), message("A", 2)]]
    got = [(r[1] - M0, r[5]) for r in run(spark, tmp_path, batches, lambda b: latest_bars(b, kept=3), "update")]
    assert got == [(0, 1.5), (1, 1.5), (2, 1.5), (1, 9.0), (3, 1.5)]


def test_first_delivery_and_windows(spark, tmp_path):
    batches = [[message("A", m) for m in (0, 0, 1)], [message("A", 1, 9.0), message("A", 2)]]
    got = run(spark, tmp_path, batches, lambda b: unique_bars(b).select("symbol", "open_time", "close"))
    assert sorted(r[2] for r in got) == [1.5, 1.5, 1.5]


def test_windows_close_with_the_watermark(spark, tmp_path):
    batches = [[message("A", m) for m in range(15)], [message("A", 60)], [message("A", 61)]]
    got = run(spark, tmp_path, batches, windowed_bars)
    assert [(r[0], r[7]) for r in got] == [("A", 15)]
