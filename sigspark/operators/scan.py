"""Recursive filters as prefix scans.

A recursive step is a map from the previous state to the next one. Affine maps and clips
compose into maps of the same kind, so a series can be scanned block by block: compose each
block, carry the state over the blocks, then replay the blocks from their start states. The
same rule works on three levels: numpy blocks inside an Arrow batch, batches of one task, and
slices of one long key spread over the cluster.

Steps that do not compose (``Fold``) run in order; for a long key they are relayed slice after
slice through the shared folder, which holds the slices one folder per turn.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigspark.operators.series import SLICE, edgeless, key_struct, null_safe_join, on_slices, resumed, settled, stretches
from sigspark.session import written

Cols = dict[str, np.ndarray]


class AffineMaps:
    """Maps ``s -> M s + c``."""

    def __init__(self, dim: int):
        self.dim = dim
        self.width = dim * dim + dim

    def identity(self, n: int):
        return np.broadcast_to(np.eye(self.dim), (n, self.dim, self.dim)).copy(), np.zeros((n, self.dim))

    def then(self, first, second):
        return second[0] @ first[0], (second[0] @ first[1][..., None])[..., 0] + second[1]

    def apply(self, m, s):
        return (m[0] @ s[..., None])[..., 0] + m[1]

    def constant(self, m, mask, value):
        keep = ~mask
        return m[0] * keep[:, None, None], np.where(mask[:, None], value, m[1])

    def pick(self, mask, a, b):
        return np.where(mask[:, None, None], a[0], b[0]), np.where(mask[:, None], a[1], b[1])

    def pack(self, m) -> list[float]:
        return [*m[0].ravel().tolist(), *m[1].ravel().tolist()]

    def unpack(self, flat):
        d, flat = self.dim, np.asarray(flat, dtype=float)
        return flat[: d * d].reshape(1, d, d), flat[d * d:].reshape(1, d)


class ClipMaps:
    """Maps ``s -> min(max(s, lo), hi)`` on one number."""

    dim, width = 1, 2

    def identity(self, n: int):
        return np.full((n, 1), -np.inf), np.full((n, 1), np.inf)

    def then(self, first, second):
        lo, hi = second
        return np.clip(first[0], lo, hi), np.clip(first[1], lo, hi)

    def apply(self, m, s):
        return np.clip(s, m[0], m[1])

    def constant(self, m, mask, value):
        return np.where(mask[:, None], value, m[0]), np.where(mask[:, None], value, m[1])

    def pick(self, mask, a, b):
        return np.where(mask[:, None], a[0], b[0]), np.where(mask[:, None], a[1], b[1])

    def pack(self, m) -> list[float]:
        return [float(m[0].ravel()[0]), float(m[1].ravel()[0])]

    def unpack(self, flat):
        return np.array([[flat[0]]]), np.array([[flat[1]]])


@dataclass
class Scan:
    """A filter whose step composes.

    ``step(cols)`` gives the maps of a set of rows, ``first(cols)`` the state right after the
    first row of a series, ``emit(prev, cur, cols)`` the outputs. ``cols`` holds the input
    columns as arrays plus ``pos``, the 0-based position in the series.
    """

    maps: AffineMaps | ClipMaps
    step: Callable[[Cols], tuple]
    first: Callable[[Cols], np.ndarray]
    emit: Callable[[np.ndarray, np.ndarray, Cols], Cols]
    inputs: Sequence[str] = ("value",)
    outputs: Sequence[str] = ("filtered",)
    before_first: Callable[[Cols], np.ndarray] | None = None


@dataclass
class Fold:
    """A filter that has to run in order: ``step(state, row, pos) -> (state, outputs)`` on float lists."""

    initial: Callable[[tuple], list[float]]
    step: Callable[[list[float], tuple, int], tuple[list[float], tuple]]
    inputs: Sequence[str] = ("value",)
    outputs: Sequence[str] = ("filtered",)


def run_block(scan: Scan, cols: Cols, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Scan rows from the state ``start``; returns previous states, states and the composed map."""
    n, d, maps = len(first), scan.maps.dim, scan.maps
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    pad = blocks * length - n

    steps = scan.step(cols)
    if first.any():
        steps = maps.constant(steps, first, scan.first(cols))
    if pad:
        steps = tuple(np.concatenate(both) for both in zip(steps, maps.identity(pad)))
    table = [np.ascontiguousarray(a.reshape(blocks, length, *a.shape[1:]).swapaxes(0, 1)) for a in steps]

    def at(i: int):
        return table[0][i], table[1][i]

    total = maps.identity(blocks)
    for i in range(length):
        total = maps.then(total, at(i))
    starts = np.empty((blocks, d))
    state, whole = start.reshape(1, d), maps.identity(1)
    for j in range(blocks):
        starts[j] = state[0]
        piece = (total[0][j: j + 1], total[1][j: j + 1])
        state = maps.apply(piece, state)
        whole = maps.then(whole, piece)
    prev, cur = np.empty((blocks, length, d)), np.empty((blocks, length, d))
    s = starts
    for i in range(length):
        prev[:, i] = s
        s = maps.apply(at(i), s)
        cur[:, i] = s
    prev, cur = prev.reshape(-1, d)[:n], cur.reshape(-1, d)[:n]
    if first.any():
        at_first = {k: v[first] for k, v in cols.items()}
        prev[first] = scan.before_first(at_first) if scan.before_first else 0.0
    return prev, cur, whole


def fresh_rows(batch: pa.RecordBatch, by: Sequence[str], last: tuple | None) -> np.ndarray:
    """True where a new series (or slice) begins, given the key of the row before the batch."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    for c in by:
        v = batch.column(c)
        here, before = v.slice(1), v.slice(0, n - 1)
        moved = pc.fill_null(pc.not_equal(here, before), False)
        fresh[1:] |= pc.or_(moved, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    fresh[0] = last is None or last != key_at(batch, by, 0)
    return fresh


def key_at(batch: pa.RecordBatch, by: Sequence[str], i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in by)


def _positions(fresh: np.ndarray, offsets: np.ndarray, carried: int) -> np.ndarray:
    idx = np.arange(len(fresh))
    begun = np.maximum.accumulate(np.where(fresh, idx, -1))
    base = np.where(begun >= 0, offsets[np.maximum(begun, 0)] - begun, carried)
    return base + idx


def numbers(col: pa.Array) -> np.ndarray:
    """A numeric column, or a column of equally long lists as a matrix."""
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False).astype(float)


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def with_columns(batch: pa.RecordBatch, drop: Sequence[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without some columns and with new ones; the other columns stay as they are in Arrow."""
    kept = [f for f in batch.schema if f.name not in drop]
    arrays = [batch.column(f.name) for f in kept] + list(added.values())
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + list(added))


def _schema(df: DataFrame, drop: Sequence[str], outputs: Sequence[str]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in (*drop, *outputs)]
    return T.StructType(kept + [T.StructField(o, T.DoubleType()) for o in outputs])


def _replay(scan: Scan, by: Sequence[str], drop: Sequence[str], ends: bool = False):
    """Batch iterator: scan the rows of a sorted task from their start states; with ``ends`` the last row of each slice of a key
    carries its state in ``__state``."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        last, state, pos = None, np.zeros(scan.maps.dim), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = fresh_rows(batch, by, last)
            at = _positions(fresh, _whole(batch, "__pos0"), pos)
            cols = {**{c: numbers(batch.column(c)) for c in scan.inputs}, "pos": at}
            begun = fresh & (at > 0)
            prev, cur = np.empty((n, scan.maps.dim)), np.empty((n, scan.maps.dim))
            edges = [0, *[i for i in np.flatnonzero(begun) if i], n]
            for a, b in zip(edges, edges[1:]):
                if begun[a]:
                    state = np.array(batch.column("__s0")[int(a)].as_py(), dtype=float)
                part = {k: v[a:b] for k, v in cols.items()}
                prev[a:b], cur[a:b], _ = run_block(scan, part, fresh[a:b] & (at[a:b] == 0), state)
                state = cur[b - 1]
            last, pos = key_at(batch, by, n - 1), int(at[-1]) + 1
            out = scan.emit(prev, cur, cols)
            yield with_columns(batch, [*drop, *scan.outputs], {c: pa.array(out[c], pa.float64()) for c in scan.outputs}), fresh, cur

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ends:
            yield from (batch for batch, _, _ in scanned(batches))
            return
        held = None
        for now in itertools.chain(scanned(batches), [None]):
            if held is not None:
                batch, fresh, cur = held
                closes = np.append(fresh[1:], now is None or now[1][0])
                states = pa.array([s.tolist() if c else None for s, c in zip(cur, closes)], pa.list_(pa.float64()))
                yield with_columns(batch, ["__state"], {"__state": states})
            held = now

    return run


def _compose(scan: Scan, by: Sequence[str]):
    """Batch iterator: the composed map of each slice of a sorted task, and the key's next slice."""
    def row(at: int, after: int, total) -> pa.RecordBatch:
        values = [pa.array([at], pa.int32()), pa.array([after], pa.int32()), pa.array([scan.maps.pack(total)], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(values, names=[SLICE, "__next", "__map"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, pos, place = None, None, 0, (0, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = fresh_rows(batch, by, last)
            at = _positions(fresh, _whole(batch, "__pos0"), pos)
            cols = {**{c: numbers(batch.column(c)) for c in scan.inputs}, "pos": at}
            edges = [0, *[int(i) for i in np.flatnonzero(fresh) if i], n]
            for a, b in zip(edges, edges[1:]):
                if fresh[a]:
                    if total is not None:
                        yield row(*place, total)
                    total = scan.maps.identity(1)
                    place = (batch.column(SLICE)[a].as_py(), batch.column("__next")[a].as_py())
                part = {k: v[a:b] for k, v in cols.items()}
                _, _, piece = run_block(scan, part, at[a:b] == 0, np.zeros(scan.maps.dim))
                total = scan.maps.then(total, piece)
                last = key_at(batch, by, b - 1)
            pos = int(at[-1]) + 1
        if total is not None:
            yield row(*place, total)

    return run


def sorted_tasks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _stretches(cut: DataFrame, keys: Sequence[str], saved: DataFrame | None) -> DataFrame:
    """``stretches`` with the key as ``__k`` and the state ``__init`` that an earlier run left; its rows count as positions."""
    parts = stretches(cut, keys).withColumn("__k", key_struct(keys))
    if saved is None:
        return parts.withColumn("__init", F.lit(None).cast("array<double>"))
    known = null_safe_join(parts, saved.select(*keys, F.col("pos").alias("__done"), F.col("state").alias("__init")), keys, "left")
    return known.withColumn("__pos0", F.col("__pos0") + F.coalesce("__done", F.lit(0))).drop("__done")


def _starts(scan: Scan, cut: DataFrame, keys: Sequence[str], order: Sequence[str], parts: DataFrame) -> DataFrame:
    """Start state and position of the key that each slice goes on with (at most one row per slice)."""
    by = [SLICE, *keys]
    narrow = cut.select(*dict.fromkeys([*by, *order, *scan.inputs]))
    ending = resumed(narrow, parts.filter(F.col("__next").isNotNull()), keys, __pos0="__pos0", __next="__next")
    map_schema = T.StructType([
        T.StructField(SLICE, T.IntegerType()), T.StructField("__next", T.IntegerType()), T.StructField("__map", T.ArrayType(T.DoubleType()))])
    composed = sorted_tasks(ending.filter(F.col("__next").isNotNull()), by, order).mapInArrow(_compose(scan, by), map_schema)
    named = parts.select(SLICE, *keys, "__init", F.col("__next").alias("__to")).join(composed, SLICE).filter(F.col("__to") == F.col("__next"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        begin = pdf["__init"].iloc[0]
        state, out = np.zeros((1, scan.maps.dim)) if begin is None else np.array([begin], dtype=float), []
        for flat in pdf["__map"]:
            state = scan.maps.apply(scan.maps.unpack(flat), state)
            out.append(state[0].tolist())
        return pd.DataFrame({SLICE: pdf["__next"], "__s0": out})

    states = named.groupBy(*keys).applyInPandas(carry, f"{SLICE} int, __s0 array<double>")
    return parts.filter(F.col("__nth") > 0).join(states, SLICE)


def _relay(fold: Fold, by: Sequence[str], drop: Sequence[str]):
    """Batch iterator for folds; the last row of each slice also carries the state onward."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, pos, held = None, [], 0, None
        named = by[1:]                                          # without the slice

        def done(final: bool) -> pa.RecordBatch:
            batch, results, states = held
            if final:
                states[-1] = state
            added = {o: pa.array([float(r[j]) for r in results], pa.float64()) for j, o in enumerate(fold.outputs)}
            return with_columns(batch, [*drop, *fold.outputs], {**added, "__state": pa.array(states, pa.list_(pa.float64()))})

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = fresh_rows(batch, by, last)
            at = _positions(fresh, _whole(batch, "__pos0"), pos)
            if held is not None:
                yield done(bool(fresh[0]))
            rows = list(zip(*[numbers(batch.column(c)).tolist() for c in fold.inputs]))
            results, states = [], [None] * n
            for i, row in enumerate(rows):
                if fresh[i]:
                    if i:
                        states[i - 1] = state
                    resumed = batch.column("__s0")[i].as_py() if at[i] > 0 else None
                    state = resumed or fold.initial(key_at(batch, named, i))
                state, out = fold.step(state, row, int(at[i]))
                results.append(out)
            last, pos = key_at(batch, by, n - 1), int(at[-1]) + 1
            held = (batch, results, states)
        if held is not None:
            yield done(True)

    return run


def _no_state() -> Column:
    """No state as an empty list: Spark's Arrow writer looks at its size row by row, and for null lists each look starts at the batch's begin."""
    return F.array().cast("array<double>")


def _begun(cut: DataFrame, keys: Sequence[str], saved: DataFrame | None) -> DataFrame:
    """``cut`` with the position and state where each key's first slice begins."""
    if saved is None:
        return cut.withColumn("__done", F.lit(0).cast("long")).withColumn("__init", F.lit(None).cast("array<double>"))
    known = saved.select(*keys, F.col("pos").alias("__done"), F.col("state").alias("__init"))
    return null_safe_join(cut, known, keys, "left").withColumn("__done", F.coalesce("__done", F.lit(0).cast("long")))


def run_scan(
    df: DataFrame, scan: Scan | Fold, keys: Sequence[str], order: Sequence[str], saved: DataFrame | None = None, ends: bool = False,
) -> DataFrame:
    """Add the outputs of a recursive filter to every row of the series.

    ``saved`` (keys, ``pos``, ``state``) makes a series go on where an earlier run ended; with ``ends`` the last row of each key has
    its state in ``__state``.
    """
    cut, done = on_slices(df, keys, order)
    cut, by, extra = settled(cut), [SLICE, *keys], ["__pos0", "__s0"]
    if isinstance(scan, Fold):
        out = _run_fold(cut, scan, keys, order, saved)
    else:
        ready, to = _begun(cut, keys, saved), F.lit(None).cast("int")
        if edgeless(cut):
            ready = ready.withColumns({"__pos0": F.col("__done"), "__s0": F.coalesce("__init", _no_state())})
        else:
            parts = _stretches(cut, keys, saved)
            ready = resumed(ready, _starts(scan, cut, keys, order, parts), keys, __pos0="__pos0", __s0="__s0")
            ready = ready.withColumns({"__pos0": F.coalesce("__pos0", "__done"), "__s0": F.coalesce("__s0", "__init", _no_state())})
            if ends:
                ready, to = resumed(ready, parts.filter(F.col("__next").isNotNull()), keys, __next="__next"), F.col("__next")
        ready = (ready.withColumn("__to", to) if ends else ready).drop("__done", "__init", "__next")
        schema = _schema(ready, extra, scan.outputs)
        out = sorted_tasks(ready, by, order).mapInArrow(_replay(scan, by, extra, ends), schema.add("__state", T.ArrayType(T.DoubleType())) if ends else schema)
    if not ends:
        return done(out.drop("__to", "__state"))
    return done(out.withColumn("__state", F.when(F.col("__to").isNull(), F.col("__state"))).drop("__to"))


def _run_fold(cut: DataFrame, fold: Fold, keys: Sequence[str], order: Sequence[str], saved: DataFrame | None) -> DataFrame:
    """Turn 0 runs every key's first slice, turn n its n-th one, from the states that turn n - 1 has written."""
    by, extra = [SLICE, *keys], ["__pos0", "__s0"]

    def stage(part: DataFrame) -> DataFrame:
        moved = part.withColumn("__s0", F.coalesce("__s0", _no_state())).withColumnRenamed("__next", "__to").drop("__nth", "__done", "__init")
        schema = _schema(moved, extra, fold.outputs).add("__state", T.ArrayType(T.DoubleType()))
        return sorted_tasks(moved, by, order).mapInArrow(_relay(fold, by, extra), schema)

    if edgeless(cut):
        whole = _begun(cut, keys, saved).withColumnsRenamed({"__done": "__pos0", "__init": "__s0"})
        return stage(whole.withColumn("__next", F.lit(None).cast("int")))
    parts = _stretches(cut, keys, saved)
    placed = resumed(_begun(cut, keys, saved), parts.filter(F.col("__nth") > 0), keys, __pos0="__pos0", __nth="__nth")
    placed = resumed(placed, parts.filter(F.col("__next").isNotNull()), keys, __next="__next")
    placed = placed.withColumn("__pos0", F.coalesce("__pos0", "__done")).withColumn("__nth", F.coalesce("__nth", F.lit(0)))
    placed = written(placed, "turns", "__nth")
    turns = parts.agg(F.max("__nth")).first()[0] or 0
    done = [written(stage(placed.filter(F.col("__nth") == 0).withColumn("__s0", F.col("__init"))), "turn")]
    for turn in range(1, turns + 1):
        states = done[-1].filter(F.col("__state").isNotNull() & F.col("__to").isNotNull()).select(F.col("__to").alias(SLICE), F.col("__state").alias("__s0"))
        done.append(written(stage(placed.filter(F.col("__nth") == turn).join(states, SLICE, "left")), "turn"))
    return reduce(DataFrame.unionByName, done)
