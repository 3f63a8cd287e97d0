"""Order-dependent state machines over unbounded series, exact and in parallel.

A machine with few states is run over each chunk from every state it could start in; what comes out is a map
from start to end state. The maps of a symbol's chunks, one short array each, are composed by a tree, which
gives each chunk its true start; a second pass writes the states. So a scan costs two passes over the rows and
no symbol needs to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.operators.timeline import CHUNK


def transition_table(codes: int, start: Hashable, step: Callable[[Hashable, int], Hashable]) -> tuple[np.ndarray, list]:
    """(table[state, code] -> state, states) of all states that can be reached; state 0 is the start."""
    states, number = [start], {start: 0}
    rows: list[list[int]] = []
    for state in states:
        row = []
        for code in range(codes):
            after = step(state, code)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        rows.append(row)
    return np.array(rows, dtype=np.int32), states


#: Chunks whose maps are composed in one step, and how often groups of them are grouped again.
GROUP, LEVELS = 64, 2


def start_states(maps: DataFrame, states: int, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """symbol, chunk, start from maps (symbol, chunk, ends): what the maps before a chunk make of state 0.

    Maps compose associatively: those of a group of chunks make the group's map, and a group's start gives the
    starts of its chunks. So a row never holds more than a group's maps, however many chunks a symbol has.
    """
    if levels == 0:
        ordered = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = maps.withColumn("before", F.collect_list("ends").over(ordered))
        return before.select("symbol", "chunk", F.aggregate("before", F.lit(0), lambda s, ends: F.get(ends, s)).alias("start"))
    parts = maps.groupBy("symbol", F.floor(F.col("chunk") / group).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("parts"))
    every = F.array(*(F.lit(s) for s in range(states)))
    whole = F.aggregate("parts", every, lambda now, x: F.transform(now, lambda s: F.get(x["ends"], s)))
    starts = start_states(parts.select("symbol", F.col("grp").alias("chunk"), whole.alias("ends")), states, group, levels - 1)
    joined = parts.join(starts.select("symbol", F.col("chunk").alias("grp"), "start"), ["symbol", "grp"])
    upto = F.transform("parts", lambda x, i: F.struct(x["chunk"].alias("chunk"), F.aggregate(F.slice("parts", 1, i), F.col("start"), lambda s, y: F.get(y["ends"], s)).alias("start")))
    return joined.select("symbol", F.inline(upto))


class Machine(NamedTuple):
    """A machine over the codes of one column: its table, and what the state after a row shows."""

    code: str
    table: np.ndarray
    shown: list[str]
    name: str


def scan(rows: DataFrame, machines: list[Machine], size: int = CHUNK) -> DataFrame:
    """symbol, idx and one column per machine, from rows (symbol, idx, codes) in order of idx.

    The rows are read twice; callers that computed them at some cost cut their lineage first.
    """
    codes = [m.code for m in machines]
    chunked = rows.select("symbol", "idx", *dict.fromkeys(codes)).withColumn("chunk", F.floor(F.col("idx") / size))
    # The maps of all machines stand in one array, each after the states of those before it.
    offsets = np.cumsum([0, *(len(m.table) for m in machines)])
    steps = [m.table.T.copy() for m in machines]

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx", kind="stable")
        out: list[int] = []
        for m, by_code in zip(machines, steps):
            state = np.arange(len(m.table))
            for c in p[m.code].to_numpy():
                state = by_code[c][state]
            out += state.tolist()
        return pd.DataFrame({"symbol": p["symbol"].astype(object).iloc[:1].to_numpy(), "chunk": p["chunk"].iloc[:1].to_numpy(), "ends": [out]})

    maps = chunked.groupBy("symbol", "chunk").applyInPandas(ends, "symbol string, chunk long, ends array<int>")
    starts = None
    for k, (m, a) in enumerate(zip(machines, offsets)):
        part = start_states(maps.select("symbol", "chunk", F.slice("ends", int(a) + 1, len(m.table)).alias("ends")), len(m.table)).withColumnRenamed("start", f"start{k}")
        starts = part if starts is None else starts.join(part, ["symbol", "chunk"])
    nested = [m.table.tolist() for m in machines]

    def write(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx", kind="stable")
        out = {"symbol": p["symbol"].astype(object), "idx": p["idx"]}
        for k, m in enumerate(machines):
            state, column = int(p[f"start{k}"].iloc[0]), []
            for c in p[m.code].tolist():
                state = nested[k][state][c]
                column.append(m.shown[state])
            out[m.name] = pd.Series(column, index=p.index, dtype=object)
        return pd.DataFrame(out)

    schema = "symbol string, idx long, " + ", ".join(f"{m.name} string" for m in machines)
    return chunked.join(starts, ["symbol", "chunk"]).groupBy("symbol", "chunk").applyInPandas(write, schema)
