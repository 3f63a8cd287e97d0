"""Rows that fail to parse: a minimum-cost error parse of CSV records.

A dynamic program reads each record through five states (cell start, unquoted, quoted, after the closing quote,
after blanks behind it) and the number of cells so far. It may insert or delete quotes, delete a delimiter (the
two cells are then one) and insert delimiters, each at a cost; of all readings with the wanted number of cells
the cheapest holds. A quote edit costs more than any number of delimiter edits, as quoting is the first reason
that applies; both costs are parameters. A record of cost zero whose cells have valid types is loaded. Otherwise
the edits state the reason: with any quote edit it is quoting, else with any delimiter edit the column count;
cost zero with an invalid cell is an invalid value.

The zero-cost layer is the RFC 4180 automaton; it is run first, and only records it refuses, or that have another
number of cells, go through the program. That runs over many records at once, one step per token (a run of
ordinary characters or of blanks, a quote, a comma), and is linear in the length of a record. No record meets
another in a result, so there is no shuffle and nothing can be skewed.

Defined results: null, empty and blank records and header lines are neither loaded nor faults; repeated rows
each count; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quartzbar.functions.fields import ARCHIVE_CSV_FIELDS, QUANTITY_OF
from quartzbar.functions.instants import iso_us

BLANK = " \t\r\n\v\f\u00a0\u3000"
_CELL = rf'[{BLANK}]*"[^"]*(?:""[^"]*)*"[{BLANK}]*|[^",]*'
_RECORD = re.compile(rf"(?:{_CELL})(?:,(?:{_CELL}))*")
_EACH = re.compile(_CELL)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_START, _OPEN, _QUOTED, _CLOSED, _AFTER = range(5)
#: A quote edit outweighs all delimiter edits that a record can have.
QUOTE_COST = 1 << 32
_EPOCH = datetime(1970, 1, 1)
_FIRST, _END = 1_577_836_800_000_000, 4_102_444_800_000_000  # 2020 and 2100, in microseconds


def zero_cost_cells(record: str) -> list[str] | None:
    """The cells of a record that needs no edit of quotes; None if it needs one."""
    if '"' not in record:
        return [c.strip(BLANK) for c in record.split(",")]
    if not _RECORD.fullmatch(record):
        return None
    cells, at = [], 0
    while True:
        m = _EACH.match(record, at)
        cell = m.group().strip(BLANK)
        cells.append(cell[1:-1].replace('""', '"').strip(BLANK) if cell.startswith('"') else cell)
        if m.end() == len(record):
            return cells
        at = m.end() + 1


_TOKEN = re.compile(rf'(?P<text>[^",{BLANK}]+)|(?P<blank>[{BLANK}]+)|(?P<quote>")|(?P<comma>,)')
_TEXT, _SPACE, _QUOTE, _COMMA, _PAST = range(5)
_KIND = {"text": _TEXT, "blank": _SPACE, "quote": _QUOTE, "comma": _COMMA}
_INFINITE = 1 << 60
#: Tokens that one run of the program holds, over all its records.
_AT_ONCE = 200_000


def _least(*options: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(cost, code) of the cheapest option at each place; the first of equal ones."""
    cost, code = options[0][0], np.full(options[0][0].shape, options[0][1], dtype=np.uint8)
    for other, k in options[1:]:
        less = other < cost
        cost, code = np.where(less, other, cost), np.where(less, np.uint8(k), code)
    return cost, code


def cheapest_edits(records: list[str], width: int, quote: int = QUOTE_COST, delimiter: int = 1) -> list[tuple[int, list[str]]]:
    """(cost, edits as text in order of place) of the cheapest reading of each record with ``width`` cells."""
    tokens = [[(_KIND[m.lastgroup], m.start()) for m in _TOKEN.finditer(r)] for r in records]
    order = sorted(range(len(records)), key=lambda i: len(tokens[i]))
    out: list = [None] * len(records)
    while order:
        # Records of like length run together.
        n = len(order)
        while n > 1 and n * len(tokens[order[n - 1]]) > _AT_ONCE:
            n = (n + 1) // 2
        group, order = order[:n], order[n:]
        for i, found in zip(group, _program([tokens[i] for i in group], [len(records[i]) for i in group], width, quote, delimiter)):
            out[i] = found
    return out


def _program(tokens: list[list[tuple[int, int]]], ends: list[int], width: int, quote: int, delimiter: int) -> list[tuple[int, list[str]]]:
    n, steps = len(tokens), max(map(len, tokens), default=0)
    kinds = np.full((n, steps), _PAST, dtype=np.int8)
    for i, t in enumerate(tokens):
        kinds[i, : len(t)] = [k for k, _ in t]
    # cost[state, record, cells - 1]; opened and read remember how each state was reached: before a token by an
    # inserted quote (the code of the state it was inserted in), at a token by reading or deleting it.
    cost = np.full((5, n, width), _INFINITE, dtype=np.int64)
    cost[_START, :, 0] = 0
    opened = np.zeros((steps + 1, 2, n, width), dtype=np.uint8)
    read = np.zeros((steps, 5, n, width), dtype=np.uint8)
    last = np.full((5, n, width), _INFINITE, dtype=np.int64)

    def inserted(cost: np.ndarray, step: int) -> np.ndarray:
        now = cost.copy()
        now[_QUOTED], opened[step, 0] = _least((cost[_QUOTED], _QUOTED), (cost[_START] + quote, _START), (cost[_CLOSED] + quote, _CLOSED))
        now[_CLOSED], opened[step, 1] = _least((cost[_CLOSED], _CLOSED), (cost[_QUOTED] + quote, _QUOTED))
        return np.minimum(now, _INFINITE)

    for step in range(steps + 1):
        full = inserted(cost, step)
        done = np.array([len(t) == step for t in tokens])
        last[:, done] = full[:, done]
        if step == steps:
            break
        start, open_, quoted, closed, after = full
        none = np.full_like(start, _INFINITE)
        kind = kinds[:, step]
        new = np.full_like(full, _INFINITE)
        for k in set(kind.tolist()) - {_PAST}:
            if k == _TEXT:
                got = [(none, np.zeros(none.shape, np.uint8)), _least((open_, _OPEN), (start, _START)), _least((quoted, _QUOTED)), *[(none, np.zeros(none.shape, np.uint8))] * 2]
            elif k == _SPACE:
                got = [_least((start, _START)), _least((open_, _OPEN)), _least((quoted, _QUOTED)), (none, np.zeros(none.shape, np.uint8)), _least((after, _AFTER), (closed, _CLOSED))]
            elif k == _QUOTE:
                # Codes from 8 on: the quote is deleted.
                got = [
                    _least((start + quote, 8 + _START)), _least((open_ + quote, 8 + _OPEN)), _least((start, _START), (closed, _CLOSED), (quoted + quote, 8 + _QUOTED)),
                    _least((quoted, _QUOTED), (closed + quote, 8 + _CLOSED)), _least((after + quote, 8 + _AFTER)),
                ]
            else:
                end, whence = _least((start, _START), (open_, _OPEN), (closed, _CLOSED), (after, _AFTER))
                ahead, code = np.full_like(end, _INFINITE), np.zeros_like(whence)
                ahead[:, 1:], code[:, 1:] = end[:, :-1], whence[:, :-1]
                less = end + delimiter < ahead
                got = [(np.where(less, end + delimiter, ahead), np.where(less, whence + 8, code)), (none, np.zeros(none.shape, np.uint8)), _least((quoted, _QUOTED)), *[(none, np.zeros(none.shape, np.uint8))] * 2]
            mine = kind == k
            for s, (c, code) in enumerate(got):
                new[s, mine], read[step, s, mine] = c[mine], code[mine]
        cost = np.minimum(new, _INFINITE)
    # Cells that lack at the end are delimiters inserted there.
    whole, state = _least(*((last[s], s) for s in (_START, _OPEN, _CLOSED, _AFTER)))
    whole = whole + delimiter * np.arange(width - 1, -1, -1)
    best = whole.argmin(axis=1)
    return [_edits(int(whole[i, best[i]]), int(state[i, best[i]]), int(best[i]), i, t, ends[i], width, opened, read) for i, t in enumerate(tokens)]


def _edits(cost: int, state: int, cell: int, i: int, tokens: list[tuple[int, int]], end: int, width: int, opened: np.ndarray, read: np.ndarray) -> tuple[int, list[str]]:
    found = [f"insert_delimiter@{end}"] * (width - 1 - cell)
    for step in range(len(tokens), -1, -1):
        if state in (_QUOTED, _CLOSED):
            before = int(opened[step, 0 if state == _QUOTED else 1, i, cell])
            if before != state:
                found.append(f"insert_quote@{tokens[step][1] if step < len(tokens) else end}")
                state = before
        if step:
            kind, at = tokens[step - 1]
            code = int(read[step - 1, state, i, cell])
            if code >= 8:
                found.append(f"delete_{'quote' if kind == _QUOTE else 'delimiter'}@{at}")
            elif kind == _COMMA and state == _START:
                cell -= 1
            state = code % 8
    return cost, found[::-1]


def instant_us(cell: str) -> int | None:
    """Microseconds since 1970 of an open time; None if it is none."""
    if cell.isascii() and cell.isdigit():
        value = int(cell) if len(cell) < 19 else 1 << 62
        return value * 1_000_000 if value <= 10_000_000_000 else value * 1_000
    return iso_us(cell)


def typed(cells: list[str]) -> dict | str:
    """The typed values of twelve cells, or the name of the first field that is invalid."""
    at = instant_us(cells[0])
    if at is None or not _FIRST <= at < _END:
        return "open_time"
    row: dict = {"open_time": at}
    for name, cell in zip(ARCHIVE_CSV_FIELDS[1:6], cells[1:6]):
        if not _NUMBER.fullmatch(cell):
            return name
        value = float(cell)
        if value < 0 or (value == 0 and name != "volume"):
            return name
        row[name] = value
    if not (row["low"] <= row["open"] <= row["high"] and row["low"] <= row["close"] <= row["high"]):
        return "low" if row["low"] > min(row["open"], row["close"]) else "high"
    for i in (7, 8, 9, 10):
        name, cell = ARCHIVE_CSV_FIELDS[i], cells[i]
        if cell == "":
            row[name] = None
            continue
        if not _NUMBER.fullmatch(cell):
            return name
        value = float(cell)
        if value < 0 or (name == "count" and value != float("inf") and value != int(value)):
            return name
        row[name] = value
    row["close_time"], row["ignore"] = cells[6], cells[11]
    return row


def is_header(cells: list[str]) -> bool:
    """Whether every cell names a field."""
    return len(cells) > 1 and all(c in QUANTITY_OF or c.lower() in QUANTITY_OF for c in cells)


def judge(records: list[str | None], width: int = len(ARCHIVE_CSV_FIELDS)) -> list[tuple[str, object]]:
    """Of each record (ok, values), (skip, None) or (reason, what was wrong)."""
    out: list[tuple[str, object]] = [("skip", None)] * len(records)
    refused: list[tuple[int, str]] = []
    for i, record in enumerate(records):
        record = (record or "").removeprefix("\ufeff").removesuffix("\r")
        if not record.strip(BLANK):
            continue
        cells = zero_cost_cells(record)
        if cells is not None and is_header(cells):
            continue
        if cells is None or len(cells) != width:
            refused.append((i, record))
            continue
        values = typed(cells)
        out[i] = ("invalid_value", values) if isinstance(values, str) else ("ok", values)
    for (i, _), (_, edits) in zip(refused, cheapest_edits([r for _, r in refused], width)):
        reason = "quoting" if any(e.startswith(("insert_quote", "delete_quote")) for e in edits) else "column_count"
        out[i] = reason, f"{len(edits)} edits: " + " ".join(edits)
    return out


_OUT = pa.schema(
    [("rec_id", pa.int64()), ("reason", pa.string()), ("detail", pa.string()), ("open_time_us", pa.int64())]
    + [(f, pa.float64()) for f in ARCHIVE_CSV_FIELDS[1:6]]
    + [("close_time", pa.string())]
    + [(f, pa.float64()) for f in ("quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")]
    + [("ignore", pa.string())]
)
_DDL = ", ".join(f"`{f.name}` {'bigint' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in _OUT)


def parse_records(records: DataFrame) -> DataFrame:
    """One row per record that is neither blank nor a header: the typed values, or reason and detail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (verdict, value) in zip(batch.column(0).to_pylist(), judge(batch.column(1).to_pylist())):
                if verdict == "ok":
                    out.append({"rec_id": i, "open_time_us": value.pop("open_time")} | value)
                elif verdict != "skip":
                    out.append({"rec_id": i, "reason": verdict, "detail": value})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return records.select("rec_id", "record").mapInArrow(run, _DDL)


def row_text(record: str | None, verdict: str, values: object) -> str | None:
    """An accepted record as an API row: a JSON array of its cells, a date and time in full; None for others."""
    if verdict != "ok":
        return None
    cells = zero_cost_cells(record.removeprefix("\ufeff").removesuffix("\r"))
    if not cells[0].isdigit():
        cells[0] = (_EPOCH + timedelta(microseconds=values["open_time"])).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return json.dumps(cells)


def api_rows(records: DataFrame) -> DataFrame:
    """rec_id, row: every accepted record as an API row."""
    schema = pa.schema([("rec_id", pa.int64()), ("row", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, row_text(record, *found)) for i, record, found in zip(batch.column(0).to_pylist(), texts, judge(texts))]
            yield pa.RecordBatch.from_pylist([{"rec_id": i, "row": row} for i, row in rows if row is not None], schema=schema)

    return records.select("rec_id", "record").mapInArrow(run, "rec_id bigint, row string")
