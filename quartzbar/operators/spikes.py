"""Implausible readings, flagged per source relative to that source's normal behaviour.

Each field becomes a residual of what the other fields of its row bear out (the wick beyond open and close in
units of the usual range and of the row's own activity; the volume against quote volume and price; the spread
in units of the usual spread), so that genuine bursts, level moves and wide books vanish from it. A robust
autoregression (Huber weights) is fitted per source: every block fits its own, and the source's is their median,
weighted by readings. With it additive outliers and level shifts are tested against each other and taken out in
turn until none is left; the scale of its errors is that of the time around. An additive outlier of sufficient
size is a spike; a level shift is none. Stuck runs and physical limits are tested apart.

Blocks: readings are cut per source into blocks of a fixed number of hours that have readings (found by a
dense rank over distinct hours, a table bounded by the span of time), each with a halo of such hours on both
sides. Every hour of the halo has a reading, so a run of six is always seen whole, and no source, however
large its share, is ever gathered into one task.

Defined results: null and NaN readings are no cases; rows without symbol, time or id are left out; rows of one
moment count once as neighbours but each is judged; sources with few readings are judged by the limits, the
runs and their few readings; repeated rows with one id give one case; further columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
RUN = 6
SCHEMA = "row_id long, field string, fault string, score double"


def in_blocks(rows: DataFrame, hours: int = 48, halo: int = 6) -> DataFrame:
    """Adds block and core to rows (symbol, t, ...): whole blocks of hours with readings, and their halos."""
    assert hours > 2 * halo >= 2 * RUN
    rows = rows.withColumn("hour", F.floor(F.col("t") / HOUR_US))
    ranked = rows.select("symbol", "hour").distinct().withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("hour")) - 1)
    at, own = F.col("r") % hours, F.floor(F.col("r") / hours)
    blocks = ranked.select(
        "symbol", "hour", own.alias("own"),
        F.explode(F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= hours - halo, own + 1)))).alias("block"),
    )
    return rows.join(blocks, ["symbol", "hour"]).withColumn("core", F.col("own") == F.col("block")).drop("own", "hour")


def robust_ar1(x: np.ndarray, rounds: int = 5) -> tuple[float, float, np.ndarray, float]:
    """(mean, phi, residuals, scale) of an AR(1) fitted with Huber weights."""
    mu = float(np.median(x))
    d = x - mu
    a, b = d[:-1], d[1:]
    phi, scale = 0.0, 1e-9
    w = np.ones(len(b))
    for _ in range(rounds):
        # Both ends of a pair are weighted: an outlier spoils the pair it ends and the pair it begins.
        e = b - phi * a
        scale = max(1.4826 * float(np.median(np.abs(e))), 1e-9) if len(e) else 1e-9
        cap = 3 * max(1.4826 * float(np.median(np.abs(d))), 1e-9)
        w = np.minimum(1, 1.345 * scale / np.maximum(np.abs(e), 1e-12)) * np.minimum(1, (cap / np.maximum(np.abs(a), 1e-12)) ** 2)
        phi = float(np.clip((w * a * b).sum() / max((w * a * a).sum(), 1e-12), -0.95, 0.95)) if len(a) else 0.0
    return mu, phi, np.concatenate([d[:1], d[1:] - phi * d[:-1]]), scale


def additive_outliers(x: np.ndarray, phi: float | None = None, tau: float = 6.0, reach: int = 5, hold: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(size of the additive outlier at each point, 0: none; what the autoregression expects at each point).

    Outliers and level shifts are found by turns until none is left; a point is taken out once as either. phi: the
    source's autoregression; without it the series' own.
    """
    x = x.astype("float64").copy()
    effect, level = np.zeros(len(x)), np.zeros(len(x))
    if len(x) < 3:
        return effect, x
    spent = np.zeros((2, len(x)), bool)
    while True:
        mu, own, e, scale = robust_ar1(x)
        if phi is None:
            f = own
        else:
            f, d = phi, x - mu
            e = np.concatenate([d[:1], d[1:] - f * d[:-1]])
            scale = max(1.4826 * float(np.median(np.abs(e[1:]))), 1e-9)
        ahead = np.concatenate([e[1:], np.zeros(reach)])
        ao = (e - f * ahead[: len(e)]) / (1 + f * f)
        ao_t = ao * np.sqrt(1 + f * f) / scale
        # A level shift leaves (1 - phi) of itself in each residual after it.
        later = np.lib.stride_tricks.sliding_window_view(np.concatenate([ahead, np.zeros(1)])[: len(e) + reach - 1], reach)
        k = 1 - f
        robust_later = np.median(later, axis=1) * reach
        norm = 1 + reach * k * k
        ls = (e + k * robust_later) / norm
        ls_t = ls * np.sqrt(norm) / scale
        # The level moved here if the usual values on both sides and the step itself say so; it is then their difference.
        sides = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, hold, mode="edge"), hold), axis=1)
        moved = sides[hold : hold + len(x)] - sides[: len(x)]
        held = (np.abs(moved) >= np.abs(ls) / 2) & (np.abs(np.diff(x, prepend=x[:1])) >= np.abs(moved) / 2)
        shift = np.abs(ls_t) > np.abs(ao_t)
        size = np.where(shift, np.where(held, np.abs(ls_t), 0.0), np.abs(ao_t))
        peak = (size > tau) & (size >= np.concatenate([[0], size[:-1]])) & (size >= np.concatenate([size[1:], [0]]))
        peak &= ~np.where(shift, spent[1], spent[0])
        if not peak.any():
            return effect, x - ao + level
        out, steps = peak & ~shift, np.where(peak & shift, moved, 0.0)
        spent |= np.array([out, peak & shift])
        effect[out] += ao[out]
        x[out] -= ao[out]
        x -= np.cumsum(steps)
        level += np.cumsum(steps)


def usual(values: np.ndarray, width: int = 61) -> np.ndarray:
    """The running median around each point; the median of all where neighbours are few."""
    s = pd.Series(values)
    whole = float(s.median()) if s.notna().any() else np.nan
    return s.rolling(width, center=True, min_periods=5).median().fillna(whole).to_numpy()


def run_lengths(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the run of equal values that each point is in: its length and the sum of counts over it."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    group = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    return np.bincount(group)[group], np.bincount(group, weights=counts)[group]


def _log(a: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a > 0, np.log(np.where(a > 0, a, 1)), np.nan)


def _cases(found: list[tuple[np.ndarray, str, str, np.ndarray]]) -> pd.DataFrame:
    # Plain object columns: concatenated frames would hold chunked strings, which Arrow refuses here.
    names = lambda i: np.array([f[i] for f in found for _ in f[0]], dtype=object)
    return pd.DataFrame(
        {
            "row_id": np.concatenate([f[0] for f in found]) if found else np.zeros(0, "int64"),
            "field": pd.Series(names(1), dtype=object),
            "fault": pd.Series(names(2), dtype=object),
            "score": np.concatenate([f[3] for f in found]) if found else np.zeros(0),
        }
    )


def _outlying(x: np.ndarray, first: np.ndarray, moment: np.ndarray, least: float, phi: float | None) -> np.ndarray:
    """Of every row: the size of its outlier, 0 below least.

    An outlier must stand out twice: from the autoregression and from the usual level around it. Rows that
    repeat a moment are measured against what the autoregression expects of that moment.
    """
    series = x[first]
    ok = np.isfinite(series)
    common = usual(series)
    effect, expected = np.zeros(len(series)), common.copy()
    effect[ok], expected[ok] = additive_outliers(series[ok], phi)
    away = np.abs(np.nan_to_num(x - common[moment]))
    is_first = np.zeros(len(x), bool)
    is_first[first] = True
    out = np.where(is_first, np.abs(effect)[moment], np.abs(np.nan_to_num(x - expected[moment])))
    size = np.minimum(out, away)
    return np.where(size > least, size, 0.0)


#: A wick counts from so many usual ranges, a spread from so many usual spreads, a volume from a factor of so
#: many powers of e away from what quote volume and price bear out.
WICK, SPREAD, VOLUME = 4.0, 40.0, 3.5


class _Rows(NamedTuple):
    """Rows of one block in order: which are the first of their moment, the moment of each, which are of the block itself."""

    p: pd.DataFrame
    first: np.ndarray
    moment: np.ndarray
    core: np.ndarray


def _in_order(p: pd.DataFrame) -> _Rows:
    p = p.sort_values(["t", "id"], kind="stable")
    _, first, moment = np.unique(p["t"].to_numpy("int64"), return_index=True, return_inverse=True)
    return _Rows(p, first, moment, p["core"].to_numpy(bool))


def _bar_residuals(rows: _Rows) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Of each field what its row does not bear out (NaN where that cannot be told), which readings are impossible, which rows had trades."""
    p, first, moment, _ = rows
    o, h, lo, c, v, q, n, tb = (p[k].to_numpy("float64") for k in ("open", "high", "low", "close", "volume", "quote_volume", "number_of_trades", "taker_buy_base_volume"))
    top, bottom = np.fmax(o, c), np.fmin(o, c)
    price = np.where(np.isfinite(c) & (c > 0), (o + c) / 2, o)
    traded = (n > 0) | (np.isnan(n) & ((v > 0) | (q > 0)))
    impossible = {
        "high": (h <= 0) | (h < top),
        "low": (lo <= 0) | (lo > bottom),
        "volume": (v < 0) | ((v == 0) & (n > 0)) | ((v > 0) & (n == 0)),
    }
    # What a row bears out: its own body, and its activity in quote volume and trades.
    span = _log(h) - _log(lo)
    span = np.where(traded & (span > 0), span, np.nan)
    common = usual(span[first])[moment]
    with np.errstate(divide="ignore", invalid="ignore"):
        active = np.fmax(q / usual(np.where(q > 0, q, np.nan)[first])[moment], n / usual(np.where(n > 0, n, np.nan)[first])[moment])
        active = np.sqrt(np.clip(np.nan_to_num(active, nan=1.0), 1.0, 100.0))
        unit = np.fmax(common, np.abs(_log(c) - _log(o))) * active
        x = {"high": (_log(h) - _log(top)) / unit, "low": (_log(bottom) - _log(lo)) / unit}
        part = _log(v) - _log(tb)
        x["volume"] = np.where(q > 0, _log(v) + _log(price) - _log(q), part - usual(part[first])[moment])
    return {f: np.where(traded & ~impossible[f], e, np.nan) for f, e in x.items()}, impossible, traded


def _depth_residuals(rows: _Rows) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The spread in units of the usual one, which readings are impossible, of which rows the bid is at fault."""
    p, first, moment, _ = rows
    b, a = p["best_bid"].to_numpy("float64"), p["best_ask"].to_numpy("float64")
    impossible = (b <= 0) | (b > a)
    spread = _log(a) - _log(b)
    spread = np.where(impossible | (spread <= 0), np.nan, spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = spread / usual(spread[first])[moment]
        # Of a wide spread the side is at fault that left its usual level.
        strays = lambda s: np.abs(_log(s) - usual(_log(s)[first], 21)[moment])
        mine = strays(b) >= strays(a)
    return {"best_bid": x}, impossible, mine


def fit_block(residuals: Callable[[_Rows], tuple]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function that fits the autoregression of each field to one block: symbol, block, field, phi, n."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(p)
        found = []
        for field, x in residuals(rows)[0].items():
            series = x[rows.first]
            series = series[np.isfinite(series)]
            if len(series) >= 3:
                found.append((p["symbol"].iloc[0], p["block"].iloc[0], field, robust_ar1(series)[1], len(series)))
        out = pd.DataFrame(found, columns=["symbol", "block", "field", "phi", "n"])
        return out.astype({"symbol": object, "field": object})

    return fit


def _source_phi(fits: pd.DataFrame) -> dict[str, float]:
    return dict(zip(fits["field"], fits["phi"]))


def judge_bars(p: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
    """Cases among the core rows of one block of bars; fits: field, phi of the source."""
    rows, phi = _in_order(p), _source_phi(fits)
    p, first, moment, core = rows
    x, impossible, traded = _bar_residuals(rows)
    out = []
    for field, least in (("high", WICK), ("low", WICK), ("volume", VOLUME)):
        values = p[field].to_numpy("float64")
        score = _outlying(x[field], first, moment, least, phi.get(field))
        there = np.isfinite(values)
        known = first[there[first]]
        length, trades = run_lengths(values[known], traded[known].astype(float))
        stuck = np.zeros(len(first), bool)
        stuck[moment[known]] = (length >= RUN) & (trades >= RUN)
        stuck = stuck[moment] & traded & (values == values[first][moment])
        for fault, hit in (("impossible", impossible[field]), ("stuck", stuck & ~impossible[field]), ("spike", (score > 0) & ~stuck & ~impossible[field])):
            k = np.flatnonzero(hit & core & there)
            if len(k):
                out.append((p["id"].to_numpy()[k], field, fault, score[k]))
    return _cases(out)


def judge_depth(p: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
    """Cases among the core rows of one block of depth snapshots; fits: field, phi of the source."""
    rows, phi = _in_order(p), _source_phi(fits)
    p, first, moment, core = rows
    b, a = p["best_bid"].to_numpy("float64"), p["best_ask"].to_numpy("float64")
    x, impossible, mine = _depth_residuals(rows)
    score = np.where(mine, _outlying(x["best_bid"], first, moment, SPREAD, phi.get("best_bid")), 0.0)
    there = np.isfinite(b)
    known = first[there[first]]
    asks = np.nan_to_num(a[known], nan=-1.0)
    moved = np.concatenate([[0.0], (asks[1:] != asks[:-1]).astype(float)]) if len(asks) else asks
    # The ask's step into a run is not one within it.
    bids = b[known]
    if len(bids):
        moved[1:][bids[1:] != bids[:-1]] = 0
    length, moves = run_lengths(bids, moved)
    stuck = np.zeros(len(first), bool)
    stuck[moment[known]] = (length >= RUN) & (moves >= np.maximum(2, (length - 1) / 3))
    stuck = stuck[moment] & (b == b[first][moment])
    out = []
    for fault, hit in (("impossible", impossible), ("stuck", stuck & ~impossible), ("spike", (score > 0) & ~stuck & ~impossible)):
        k = np.flatnonzero(hit & core & there)
        if len(k):
            out.append((p["id"].to_numpy()[k], "best_bid", fault, score[k]))
    return _cases(out)


def _found(rows: DataFrame, residuals: Callable, judge: Callable, src: str) -> DataFrame:
    # Both passes read the one exchange of the blocks; what joins them is a few rows per block.
    blocks = in_blocks(rows)
    fits = blocks.groupBy("symbol", "block").applyInPandas(fit_block(residuals), "symbol string, block long, field string, phi double, n long")
    sources = fits.groupBy("symbol", "field").agg(F.percentile("phi", 0.5, F.col("n")).alias("phi"))
    of_blocks = fits.select("symbol", "block", "field").join(sources, ["symbol", "field"])
    cases = blocks.groupBy("symbol", "block").cogroup(of_blocks.groupBy("symbol", "block")).applyInPandas(judge, SCHEMA)
    return cases.select(F.lit(src).alias("src"), "row_id", "field", "fault", "score")


def implausible_readings(bars: DataFrame, depth: DataFrame) -> DataFrame:
    """src, row_id, field, fault (impossible, stuck, spike), score of every implausible reading."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("t")
    b = bars.select(
        "symbol", us("open_time"), F.col("bar_id").alias("id"),
        "open", "high", "low", "close", "volume", "quote_volume", F.col("number_of_trades").cast("double").alias("number_of_trades"), "taker_buy_base_volume",
    ).where("symbol IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL")
    d = depth.select("symbol", us("snapshot_time"), F.col("snapshot_id").alias("id"), "best_bid", "best_ask").where(
        "symbol IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL"
    )
    return _found(b, _bar_residuals, judge_bars, "bars").unionByName(_found(d, _depth_residuals, judge_depth, "depth_snapshots"))
