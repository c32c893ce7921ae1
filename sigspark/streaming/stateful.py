"""Keyed state on streams: the same filters and windows as in batch, kept alive between micro-batches.

Every operator is a state processor with value, list and map state and timers (RocksDB state store). The rows of a key
inside a micro-batch come frame by frame and in any order. Up to ``MOST`` of them are held and sorted in memory; more are laid into
a map state by span of their order (``span`` units each), then taken out span by span in ascending order: memory holds
so many rows or one span of a key, whatever the batch brings. Rows at or before the last order already processed are dropped and counted. An order may be several
columns, so that samples of one instant stay apart.

Trailing windows and throttles serve many keys in a call: keys are dealt into ``LOTS`` lots, each with one state that names its keys. A
call costs some milliseconds whatever it holds, so many keys of few rows each cost what their rows cost, not a call per key and batch.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sigspark.operators.filters import REGISTRY
from sigspark.operators.scan import Fold, Scan, run_block

MOST = 65_536                                                  # rows of a key or lot and micro-batch that are held without the state store
LOTS = 1024                                                    # groups of keys that share a state
KEY, LOT = "key_text", "key_lot"                               # no underscore in front: rows come as named tuples
NEVER = np.iinfo(np.int64).min
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, time: str, delay: str | None = "0 seconds") -> DataFrame:
    """Watermark for a stream whose time never runs backwards by more than ``delay``; None for no watermark."""
    return df if delay is None else df.withWatermark(time, delay)


def transform(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: T.StructType, time: str = "None") -> DataFrame:
    """Run a state processor over the keys of a stream (``time``: None, ProcessingTime or EventTime for its timers)."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", time)


class Spans:
    """Rows of a key and micro-batch: in memory up to ``MOST``, beyond that in a map state by span of their first order column; a
    span of many rows has several pages. A call to the state store costs about as much as sorting some hundred rows."""

    def __init__(self, handle: StatefulProcessorHandle, schema: T.StructType, order: Sequence[str], span: int) -> None:
        self.names, self.order, self.span = schema.names, list(order), span
        self.pages = handle.getMapState("pages", "span long, page int", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields]))
        self.known = handle.getMapState("known", "span long", "pages int")
        self.frames, self.rows, self.laid = [], 0, False

    def put(self, rows: pd.DataFrame) -> int:
        """Take in the rows whose order has no null; the number of the others."""
        known = rows
        if any(rows[c].dtype != np.int64 for c in self.order):
            known = rows.dropna(subset=self.order).astype({c: np.int64 for c in self.order})
        if len(known):
            self.frames.append(known)
            self.rows += len(known)
        if self.rows > MOST:
            self.lay(pd.concat(self.frames, ignore_index=True))
            self.frames, self.rows, self.laid = [], 0, True
        return len(rows) - len(known)

    def lay(self, rows: pd.DataFrame) -> None:
        for span, part in rows.groupby(rows[self.order[0]].to_numpy(dtype=np.int64) // self.span):
            n = self.known.getValue((int(span),))[0] if self.known.containsKey((int(span),)) else 0
            self.pages.updateValue((int(span), n), tuple([plain(v) for v in part[c].tolist()] for c in self.names))
            self.known.updateValue((int(span),), (n + 1,))

    def take(self, whole: bool = False) -> Iterator[pd.DataFrame]:
        """Span by span in ascending order, sorted (``whole``: at once, if all are in memory); what is taken is not held any more."""
        frames, laid = self.frames, self.laid
        self.frames, self.rows, self.laid = [], 0, False
        if laid:
            if frames:
                self.lay(pd.concat(frames, ignore_index=True))
            yield from self.laid_out()
        elif frames:
            rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
            rows = rows.take(np.lexsort([rows[c].to_numpy() for c in reversed(self.order)])).reset_index(drop=True)
            span = rows[self.order[0]].to_numpy() // self.span
            edges = [0, *([] if whole else (np.flatnonzero(np.diff(span)) + 1).tolist()), len(rows)]
            for a, b in zip(edges, edges[1:]):
                yield rows.iloc[a:b]

    def laid_out(self) -> Iterator[pd.DataFrame]:
        spans = sorted((k[0], v[0]) for k, v in self.known.iterator())
        for span, n in spans:
            parts = [pd.DataFrame(dict(zip(self.names, self.pages.getValue((span, i))))) for i in range(n)]
            for i in range(n):
                self.pages.removeKey((span, i))
            self.known.removeKey((span,))
            yield pd.concat(parts, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)


def plain(v):
    """A value as state takes it."""
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None if not isinstance(v, float) else v
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def fresh_rows(pdf: pd.DataFrame, order: Sequence[str], last: Sequence[int] | None) -> tuple[pd.DataFrame, int]:
    """Of sorted rows those after ``last``, the first of each order, and how many were dropped."""
    after = np.full(len(pdf), last is None)
    level = ~after                                             # equal to ``last`` so far
    cols = [pdf[c].to_numpy(dtype=np.int64) for c in order]
    for v, bound in zip(cols, last or []):
        after |= level & (v > bound)
        level &= v == bound
    first = np.ones(len(pdf), dtype=bool)
    first[1:] = reduce(np.logical_or, [v[1:] != v[:-1] for v in cols])
    keep = after & first
    return (pdf, 0) if keep.all() else (pdf[keep], int((~keep).sum()))


class FilterProcessor(StatefulProcessor):
    """One filter state per key; null orders are dropped and counted as late."""

    def __init__(self, name: str, params: dict, schema: T.StructType, order: Sequence[str], value: str, span: int) -> None:
        self.name, self.params, self.schema, self.order, self.value, self.span = name, params, schema, list(order), value, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filter = REGISTRY[self.name](**self.params)
        self.taps = self.params.get("order", 8) if "taps" in self.filter.inputs else 0
        self.state = handle.getValueState("state", "s array<double>, tail array<double>, pos long, last array<long>, dropped long")
        self.spans = Spans(handle, self.schema, self.order, self.span)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, tail, pos, last, dropped = self.state.get() or ([], [], 0, None, 0)
        for frame in rows:
            dropped += self.spans.put(frame)
        for part in self.spans.take(whole=True):
            pdf, late = fresh_rows(part, self.order, last)
            dropped += late
            if len(pdf):
                s, tail, y = self.run(key, pdf, list(s), list(tail), pos)
                v = pdf[self.value].to_numpy(dtype=float)
                pos, last = pos + len(v), [int(x) for x in pdf[self.order].iloc[-1]]
                yield pdf.assign(filtered=y, residual=v - y, dropped=dropped)
        self.state.update((list(s), list(tail), pos, last, dropped))

    def run(self, key, pdf: pd.DataFrame, s: list, tail: list, pos: int) -> tuple[list, list, np.ndarray]:
        v, chosen = pdf[self.value].to_numpy(dtype=float), self.filter
        cols = {"value": v, "pos": pos + np.arange(len(v))}
        for c in chosen.inputs:
            if c not in ("value", "taps"):
                cols[c] = pdf[c].to_numpy(dtype=float)
        if self.taps:
            padded = np.concatenate([np.zeros(self.taps - 1 - len(tail)), tail, v])
            cols["taps"] = np.lib.stride_tricks.sliding_window_view(padded, self.taps)[:, ::-1]
            tail = padded[-(self.taps - 1):].tolist()
        if isinstance(chosen, Scan):
            start = np.array(s, dtype=float) if len(s) else np.zeros(chosen.maps.dim)
            prev, cur, _ = run_block(chosen, cols, cols["pos"] == 0, start)
            return cur[-1].tolist(), tail, chosen.emit(prev, cur, cols)["filtered"]
        y = np.empty(len(v))
        s = s if len(s) else chosen.initial(key)
        for i, row in enumerate(zip(*[cols[c] for c in chosen.inputs])):
            s, result = chosen.step(s, row, pos + i)
            y[i] = result[0]
        return [float(x) for x in s], tail, y

    def close(self) -> None:
        pass


def filter_stream(
    df: DataFrame, name: str, keys: Sequence[str], order: str | Sequence[str], value: str = "value", span: int = 3_600_000_000, **params,
) -> DataFrame:
    """Run a registered filter with one state per key that survives micro-batches.

    Adds ``filtered``, ``residual`` and ``dropped`` (late rows of the key so far). ``order`` is one
    integer column, or several, that together rise within a key; ``span``: units of the first one that are held at a time.
    """
    order = [order] if isinstance(order, str) else list(order)
    if not isinstance(REGISTRY[name.upper()](**params), (Scan, Fold)):
        raise ValueError(f"{name} is a window filter; run it with trailing_stream or in batch")
    out = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("filtered", "residual")], T.StructField("dropped", T.LongType())])
    return transform(df, keys, FilterProcessor(name.upper(), params, df.schema, order, value, span), out)


def dealt(df: DataFrame, keys: Sequence[str], lots: int) -> DataFrame:
    """``KEY``: the key as one text, lengths first, so that no two keys look alike; ``LOT``: which of ``lots`` groups of keys it is in."""
    def told(k: str) -> Column:
        kind = df.schema[k].dataType
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(k).cast("string")
        return F.to_json(F.struct(k)) if isinstance(kind, (T.StructType, T.ArrayType)) else F.hex(k) if isinstance(kind, T.BinaryType) else F.col(k).cast("string")

    name = F.concat(*[F.coalesce(F.concat(F.length(told(k)), F.lit(":"), told(k)), F.lit("-")) for k in keys])
    return df.withColumn(KEY, name).withColumn(LOT, F.pmod(F.hash(KEY), F.lit(lots)))


def ranked(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Pairs of a key's number and a time as integers that rise with both."""
    known, place = np.unique(np.concatenate([t for _, t in pairs]), return_inverse=True)
    ends = np.cumsum([len(t) for _, t in pairs])[:-1]
    return [code * len(known) + at for (code, _), at in zip(pairs, np.split(place, ends))]


def places(*cols: np.ndarray) -> np.ndarray:
    """Position of each row in its run of equal values."""
    at = np.arange(len(cols[0]))
    new = np.ones(len(at), dtype=bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])
    return at - np.maximum.accumulate(np.where(new, at, 0))


def run_sums(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running sums inside each run, by doubling; nothing is subtracted and nothing crosses a run."""
    values, step, rows = values.copy(), 1, np.flatnonzero(place >= 1)
    while len(rows):
        values[rows] = values[rows] + values[rows - step]
        step *= 2
        rows = rows[place[rows] >= step]
    return values


def trailing(code: np.ndarray, t: np.ndarray, values: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of samples sorted by key and time: sums and number of those in ``[t - width, t]`` of the key, for ``rows``."""
    size = max(width, 1)
    tile = t // size
    here, low = ranked((code, t), (code[rows], t[rows] - width))
    since, upto = np.searchsorted(here, low, side="left"), np.searchsorted(here, here[rows], side="right")         # rows of one instant are peers
    own = run_sums(values, places(code, tile))[upto - 1]
    old = run_sums(values[::-1], places(code[::-1], tile[::-1]))[::-1][since]
    return np.where((tile[since] < tile[rows])[:, None], own + old, own), upto - since


class TrailingProcessor(StatefulProcessor):
    """Powers over ``[t - width, t]`` from tiles of the width: the sums of the own tile up to t, and of the tile before from t - width on.

    A call serves all keys of a lot. The samples that a later row may reach wait in pages of the lot (map state), one more for each
    batch; the pages are written anew once half of their samples are out of reach.
    """

    def __init__(self, schema: T.StructType, order: str, width: int, value: str, filtered: str) -> None:
        self.schema, self.order, self.width, self.value, self.filtered = schema, order, int(width), value, filtered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = max(self.width, 1)
        self.done = handle.getValueState("done", "names array<string>, newest array<long>, processed array<long>, dropped array<long>, pages int, rows long")
        self.pages = handle.getMapState("samples", "page int", "key array<int>, t array<long>, raw array<double>, smooth array<double>")
        self.spans = Spans(handle, self.schema, [self.order], self.size)

    def held(self, n: int) -> list[np.ndarray]:
        """Number of the key, time and samples of ``n`` pages; none is new."""
        parts = [self.pages.getValue((i,)) for i in range(n)]
        cols = [np.array([x for p in parts for x in p[c]], dtype=k) for c, k in enumerate((np.int64, np.int64, float, float))]
        return [*cols, np.zeros(len(cols[0]), dtype=bool)]

    def store(self, held: list[np.ndarray], n: int, rows: int) -> tuple[int, int]:
        """The new samples behind ``n`` pages of ``rows`` samples, or all samples anew; pages and samples then stored."""
        *cols, fresh = held
        if n >= 16 or rows + int(fresh.sum()) > 2 * len(fresh) + 1000:
            for i in range(n):
                self.pages.removeKey((i,))
            n, rows, fresh = 0, 0, np.ones(len(fresh), dtype=bool)
        kept = [x[fresh] for x in cols]
        for a in range(0, len(kept[0]), MOST):
            self.pages.updateValue((n,), tuple(x[a:a + MOST].tolist() for x in kept))
            n += 1
        return n, rows + len(kept[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, newest, processed, dropped, pages, stored = self.done.get() or ([], [], [], [], 0, 0)
        number = {name: i for i, name in enumerate(names)}
        newest, processed, dropped = [np.array(c, dtype=np.int64) for c in (newest, processed, dropped)]

        def numbers(frame: pd.DataFrame) -> np.ndarray:
            code, seen = pd.factorize(frame[KEY])
            return np.array([number.setdefault(name, len(number)) for name in seen], dtype=np.int64)[code]

        for frame in rows:                                     # rows of one instant may come in several frames, not in several batches
            code, t = numbers(frame), frame[self.order].to_numpy()
            more = len(number) - len(newest)
            newest, processed, dropped = [np.append(c, np.full(more, none)) for c, none in ((newest, NEVER), (processed, 0), (dropped, 0))]
            out = pd.isna(t) | (t < newest[code])
            dropped += np.bincount(code[out], minlength=len(number))
            self.spans.put(frame[~out] if out.any() else frame)
        held = None
        for pdf in self.spans.take(whole=True):
            held = self.held(pages) if held is None else held
            code, t = numbers(pdf), pdf[self.order].to_numpy(dtype=np.int64)
            new = [code, t, pdf[self.value].to_numpy(dtype=float), pdf[self.filtered].to_numpy(dtype=float), np.ones(len(t), dtype=bool)]
            whole = [np.concatenate([a, b]) for a, b in zip(held, new)]
            at = np.lexsort([whole[1], whole[0]])
            whole, mine = [x[at] for x in whole], np.flatnonzero(at >= len(held[0]))
            pdf, (code, t, raw, smooth, _) = pdf.iloc[at[mine] - len(held[0])], whole
            sums, n = trailing(code, t, np.stack([raw * raw, smooth * smooth, (raw - smooth) ** 2], axis=1), mine, self.width)
            who = code[mine]
            yield pdf.assign(
                **{c: sums[:, i] / n for i, c in enumerate(("raw_power", "filtered_power", "residual_power"))},
                n=n, processed=processed[who] + 1 + places(who), dropped=dropped[who])[self.given]
            processed += np.bincount(who, minlength=len(number))
            np.maximum.at(newest, who, t[mine])
            held = [x[t // self.size >= newest[code] // self.size - 1] for x in whole]
        if held is not None:
            pages, stored = self.store(held, pages, stored)
        self.done.update((list(number), newest.tolist(), processed.tolist(), dropped.tolist(), pages, stored))

    @property
    def given(self) -> list[str]:
        return [c for c in self.schema.names if c not in (KEY, LOT)] + ["raw_power", "filtered_power", "residual_power", "n", "processed", "dropped"]

    def close(self) -> None:
        pass


def trailing_stream(
    df: DataFrame, keys: Sequence[str], order: str, width: int, value: str = "value", filtered: str = "filtered", lots: int = LOTS,
) -> DataFrame:
    """Mean powers over ``[t - width, t]`` and the running row count, nothing subtracted.

    Rows older than the newest one of an earlier batch are dropped and counted (``dropped``, of the key so far). ``lots``: groups of
    keys with one state each; it must stay the same for the life of a checkpoint.
    """
    out = T.StructType([
        *df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("raw_power", "filtered_power", "residual_power")],
        T.StructField("n", T.LongType()), T.StructField("processed", T.LongType()), T.StructField("dropped", T.LongType())])
    lot = dealt(df, keys, lots)
    return transform(lot, [LOT], TrailingProcessor(lot.schema, order, width, value, filtered), out)


class ReorderProcessor(StatefulProcessor):
    """Rows wait in a map state by number; a timer per open gap lets the rows behind it go."""

    def __init__(self, keys: Sequence[str], seq: str, body: str, wait_ms: int, most: int | None, timer: bool) -> None:
        self.keys, self.seq, self.body, self.wait_ms, self.most, self.timer = list(keys), seq, body, wait_ms, most, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "body string")
        self.state = handle.getValueState("state", "due long, held long, moved_ms long, skipped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.timer else int(time.time() * 1000)
        due, held, moved, skipped = self.state.get() if self.state.exists() else (0, 0, now, 0)
        for frame in rows:
            for s, b in zip(frame[self.seq].tolist(), frame[self.body].tolist()):
                if s is None or s != s or s < due:
                    skipped += 1
                    continue
                held += not self.waiting.containsKey((int(s),))
                self.waiting.updateValue((int(s),), (b,))          # of equal numbers the newest stays
        yield from self.release(key, due, held, moved, skipped, now, now - moved > self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due, held, moved, skipped = self.state.get()
        yield from self.release(key, due, held, moved, skipped, now, now - moved > self.wait_ms)

    def release(self, key, due: int, held: int, moved: int, skipped: int, now: int, overdue: bool) -> Iterator[pd.DataFrame]:
        """The run from ``due`` on; all once the wait is over; with ``most`` so many that half of ``most`` stay when more are held."""
        out: list[tuple[int, str]] = []

        def pop(s: int) -> None:
            out.append((s, self.waiting.getValue((s,))[0]))
            self.waiting.removeKey((s,))

        while held > len(out) and self.waiting.containsKey((due,)):
            pop(due)
            due += 1
        left = held - len(out)
        more = left if overdue else left - self.most // 2 if self.most is not None and left > self.most else 0
        if more:
            for s in sorted(k[0] for k in self.waiting.keys())[:more]:
                skipped += s - due
                pop(s)
                due = s + 1
            while self.waiting.containsKey((due,)):
                pop(due)
                due += 1
        held -= len(out)
        moved = now if out else moved
        self.state.update((due, held, moved, skipped))
        if self.timer and held:
            self.handle.registerTimer(now + self.wait_ms + 1)
        for i in range(0, len(out), 10_000):
            part = out[i:i + 10_000]
            yield pd.DataFrame({
                **{k: [v] * len(part) for k, v in zip(self.keys, key)}, self.seq: [s for s, _ in part], self.body: [b for _, b in part], "skipped": skipped})

    def close(self) -> None:
        pass


def reorder_stream(
    df: DataFrame, keys: Sequence[str], seq: str, body: str, wait_ms: int = 100, most: int | None = None, timer: bool = True,
) -> DataFrame:
    """Rows of each key in sequence order; a processing-time timer skips gaps that stay open.

    Only the rows that wait are in the state, one entry each; a batch touches what it brings and what it releases. Of equal numbers the
    newest row stays. Numbers that went by are not released any more; ``skipped`` counts them and the missing ones.
    Nothing is let out early unless ``most`` is given. A run that should end by itself (``availableNow``) needs ``timer=False``: gaps
    are then judged when the key's next row arrives.
    """
    out = T.StructType([
        *[df.schema[k] for k in keys], T.StructField(seq, T.LongType()), T.StructField(body, T.StringType()), T.StructField("skipped", T.LongType())])
    return transform(df, keys, ReorderProcessor(keys, seq, body, wait_ms, most, timer), out, "ProcessingTime" if timer else "None")


class ThrottleProcessor(StatefulProcessor):
    """The last time sent of every key of a lot."""

    def __init__(self, schema: T.StructType, order: str, width: int) -> None:
        self.schema, self.order, self.width = schema, order, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "names array<string>, t array<long>")
        self.spans = Spans(handle, self.schema, [self.order], max(self.width, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = dict(zip(*(self.last.get() or ([], []))))
        for frame in rows:
            self.spans.put(frame)
        for pdf in self.spans.take(whole=True):
            code, names = pd.factorize(pdf[KEY])
            at = np.argsort(code, kind="stable")
            code, t, n = code[at], pdf[self.order].to_numpy(dtype=np.int64)[at], len(names)
            firsts = np.searchsorted(code, np.arange(n))
            least = np.array([last[name] + self.width if name in last else int(t[i]) for name, i in zip(names, firsts)], dtype=np.int64)
            here, after, begin = ranked((code, t), (code, t + self.width), (np.arange(n), least))
            follow = np.maximum(np.searchsorted(here, after), np.arange(1, len(t) + 1)).tolist()
            picked = []
            for name, i, end in zip(names, np.searchsorted(here, begin).tolist(), [*firsts[1:].tolist(), len(t)]):
                while i < end:
                    picked.append(i)
                    last[name], i = int(t[i]), follow[i]
            if picked:
                yield pdf.iloc[at[picked]].drop(columns=[KEY, LOT])
        if last:
            self.last.update((list(last), list(last.values())))

    def close(self) -> None:
        pass


def throttle_stream(df: DataFrame, keys: Sequence[str], order: str, width: int, lots: int = LOTS) -> DataFrame:
    """At most one row per key per ``width``: a row passes when the last sent one is that old (cool-down). Null orders do not pass.
    ``lots``: groups of keys with one state each; it must stay the same for the life of a checkpoint."""
    lot = dealt(df, keys, lots)
    return transform(lot, [LOT], ThrottleProcessor(lot.schema, order, width), df.schema)


class OfflineProcessor(StatefulProcessor):
    """An event-time timer runs ``limit`` after each key's newest report."""

    def __init__(self, keys: Sequence[str], time: str, limit_ms: int) -> None:
        self.keys, self.time, self.limit = list(keys), time, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, told boolean")

    def told(self, key, last: list[int], back: list[int | None]) -> pd.DataFrame:
        at = lambda us: np.array(us, dtype="datetime64[us]")
        return pd.DataFrame({**{k: [v] * len(last) for k, v in zip(self.keys, key)}, "last_report": at(last), "back_at": at(back)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, told = self.newest.get() or (None, False)
        seen = [frame[self.time].dropna().astype("datetime64[us]").astype(np.int64).to_numpy() for frame in rows]
        times = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        times = times[times > newest] if newest is not None else times
        if not len(times):
            return
        line = times if newest is None else np.concatenate([[newest], times])
        gaps = np.flatnonzero(np.diff(line) > self.limit * 1000)
        if len(gaps):
            yield self.told(key, line[gaps].tolist(), line[gaps + 1].tolist())
        if newest is not None and not told:
            self.handle.deleteTimer(newest // 1000 + self.limit)
        newest = int(times[-1])
        self.handle.registerTimer(newest // 1000 + self.limit)
        self.newest.update((newest, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, told = self.newest.get()
        if not told and expiredTimerInfo.getExpiryTimeInMs() == newest // 1000 + self.limit:
            self.newest.update((newest, True))
            yield self.told(key, [newest], [None])

    def close(self) -> None:
        pass


def offline_stream(df: DataFrame, keys: Sequence[str], time: str, keep_alive_seconds: int, factor: float = 1.5, delay: str = "0 seconds") -> DataFrame:
    """Keys that fall silent: ``last_report``, and ``back_at`` once a report ends the silence (null while the watermark has passed the
    limit and none has come). A silence that ends within one batch gives only the row with ``back_at``."""
    kind = df.schema[time].dataType
    marked = df.select(*keys, time).withWatermark(time, delay)
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("last_report", kind), T.StructField("back_at", kind)])
    return transform(marked, keys, OfflineProcessor(keys, time, int(keep_alive_seconds * factor * 1000)), out, "EventTime")
