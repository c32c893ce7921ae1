"""Windows that restart from the data: a row opens a new window once the current one is too old.

Used for resetting energy windows, report cool-downs and display throttles. The row that opens a
window depends on the one before it, so a long key is handled slice by slice: every slice states
where it would end for each possible incoming window start (few cases, because chains merge),
the slices are chained on those small tables, and a second pass marks the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.scan import fresh_rows, key_at, sorted_tasks, with_columns
from sigspark.operators.series import SLICE, edgeless, key_struct, on_slices, resumed, settled, stretches


def _next_open(ts: np.ndarray, start: int, width: int, closed: bool) -> int:
    """Index of the first row that leaves the window opened at ``start``."""
    return int(np.searchsorted(ts, start + width, side="left" if closed else "right"))


def _mark(ts: np.ndarray, start: int | None, width: int, closed: bool) -> np.ndarray:
    """Window start of every row, given the start of the window already open (None: open at row 0)."""
    out = np.empty(len(ts), dtype=np.int64)
    i = 0
    if start is None:
        start = int(ts[0])
    while i < len(ts):
        j = max(i, _next_open(ts, start, width, closed))
        out[i:j] = start
        if j < len(ts):
            start = int(ts[j])
        i = j
    return out


def _marker(by: Sequence[str], order: str, width: int, closed: bool, drop: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = fresh_rows(batch, by, last)
            ts = batch.column(order).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty(n, dtype=np.int64)
            edges = [0, *[int(i) for i in np.flatnonzero(fresh) if i], n]
            for a, b in zip(edges, edges[1:]):
                if fresh[a]:
                    start = batch.column("__s0")[a].as_py()
                out[a:b] = _mark(ts[a:b], start, width, closed)
                start = int(out[b - 1])
            last = key_at(batch, by, n - 1)
            yield with_columns(batch, drop, {"window_start": pa.array(out, pa.int64())})

    return run


def _outcomes(ts: np.ndarray, width: int, closed: bool) -> tuple[list[int], list[int]]:
    """(limits, ends): an incoming start at or under ``limits[k]`` ends at ``ends[k]``; above all, it stays."""
    n = len(ts)
    nxt = np.searchsorted(ts, ts + width, side="left" if closed else "right")
    end = np.arange(n)
    jump = np.where(nxt < n, nxt, end)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    reach = int(np.searchsorted(ts - width, ts[0], side="right"))
    limits = ts[: reach + 1] - width - (0 if closed else 1)
    ends = ts[jump[: reach + 1]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return limits[keep].tolist(), ends[keep].tolist()


def restart_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, closed: bool = False) -> DataFrame:
    """Add ``window_start``: the order value of the row that opened the row's window.

    A new window opens when ``order - start > width`` (``closed``: ``>= width``). ``order[0]``
    must be an integer; rows with equal values share a window.
    """
    keys, order = list(keys), list(order)
    cut, done = on_slices(df, keys, order)
    t, by = order[0], [SLICE, *keys]
    kept = T.StructType([*cut.schema.fields, T.StructField("window_start", T.LongType())])
    if edgeless(cut):
        ready = cut.withColumn("__s0", F.lit(None).cast("long"))
        return done(sorted_tasks(ready, by, order).mapInArrow(_marker(by, t, width, closed, ["__s0"]), kept))
    cut = settled(cut)
    parts = stretches(cut, keys).withColumn("__k", key_struct(keys))
    ends = f"{SLICE} int, __next int, limits array<long>, ends array<long>, first long"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf[t].to_numpy(dtype=np.int64))
        limits, final = _outcomes(ts, width, closed)
        return pd.DataFrame({SLICE: [pdf[SLICE].iloc[0]], "__next": [pdf["__next"].iloc[0]], "limits": [limits], "ends": [final], "first": [int(ts[0])]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        start, out = None, []
        for limits, final, first in zip(pdf["limits"], pdf["ends"], pdf["first"]):
            if start is None:
                start = int(first)
            k = int(np.searchsorted(limits, start, side="left"))
            if k < len(limits):
                start = int(final[k])
            out.append(start)
        return pd.DataFrame({SLICE: pdf["__next"], "__s0": pd.array(out, dtype="Int64")})

    going = resumed(cut.select(*dict.fromkeys([SLICE, *keys, t])), parts.filter(F.col("__next").isNotNull()), keys, __next="__next")
    tables = going.filter(F.col("__next").isNotNull()).groupBy(SLICE).applyInPandas(summarise, ends)
    named = parts.select(SLICE, *keys, F.col("__next").alias("__to")).join(tables, SLICE).filter(F.col("__to") == F.col("__next"))
    states = named.groupBy(*keys).applyInPandas(chain, f"{SLICE} int, __s0 long")
    starts = parts.filter(F.col("__pos0") > 0).join(states, SLICE)
    ready = resumed(cut, starts, keys, __s0="__s0")
    return done(sorted_tasks(ready, by, order).mapInArrow(_marker(by, t, width, closed, ["__s0"]), kept))
