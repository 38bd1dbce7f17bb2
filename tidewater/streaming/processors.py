"""Per-key state in the engine's state store: window tails, running values, rings and request logs.

The rows of a key in one micro-batch are put in order first, so size micro-batches by the trigger. State per key is bounded by the
window, and what is computed per row is an array operation over the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Windows that one array operation looks at
STEP = 4096


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _state(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _windows(past: np.ndarray, values: np.ndarray, size: int, offset: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per step the first row's number and, per row, the ``size`` values that end ``offset`` rows before it; NaN where there is none."""
    whole = np.concatenate([np.full(size, np.nan), past, values])
    views = np.lib.stride_tricks.sliding_window_view(whole, size)
    first = len(past) + 1 - offset
    for at in range(0, len(values), STEP):
        yield at, views[first + at : first + min(at + STEP, len(values))]


class TailProcessor(StatefulProcessor):
    """Keeps the last rows of each key as one list of numbers per column."""

    def __init__(self, columns: list[str], order: list[str], keep: int):
        self.columns, self.order, self.keep = columns, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", _state(**{f"c{i}": "double" for i in range(len(self.columns))}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, self.order)
        past = np.array([tuple(np.nan if x is None else x for x in r) for r in self.tail.get()], float).reshape(-1, len(self.columns)) if self.tail.exists() else np.empty((0, len(self.columns)))
        now = batch[self.columns].to_numpy(float)
        kept = np.concatenate([past, now])[-self.keep :] if self.keep else past[:0]
        self.tail.put([tuple(None if x != x else x for x in r) for r in kept.tolist()])
        yield batch.assign(**self.measure(past, now))

    def replay(self, rows: pd.DataFrame) -> pd.DataFrame:
        """What the stream would give for a key whose rows all come at once."""
        batch = _in_order(iter([rows]), self.order)
        return batch.assign(**self.measure(np.empty((0, len(self.columns))), batch[self.columns].to_numpy(float)))

    def measure(self, past: np.ndarray, now: np.ndarray) -> dict:
        raise NotImplementedError

    def close(self) -> None:
        pass


class WindowStatistics(TailProcessor):
    """Count, mean, deviation and quartiles of the ``keep`` values before each row, and the last one."""

    ADDED = "win_n BIGINT, win_mean DOUBLE, win_std DOUBLE, win_q ARRAY<DOUBLE>, prev_value DOUBLE"

    def measure(self, past: np.ndarray, now: np.ndarray) -> dict:
        n, mean, std, quartiles = [], [], [], []
        for _, w in _windows(past[:, 0], now[:, 0], self.keep, 1):
            count = (~np.isnan(w)).sum(axis=1)
            known, ordered, rows = np.maximum(count, 1), np.sort(w, axis=1), np.arange(len(w))
            m = np.nansum(w, axis=1) / known
            n.append(count)
            mean.append(np.where(count, m, np.nan))
            std.append(np.where(count, np.sqrt(np.nansum((w - m[:, None]) ** 2, axis=1) / known), np.nan))
            q = []
            for p in (0.25, 0.75):
                at = (known - 1) * p
                low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
                a, b = ordered[rows, low], ordered[rows, high]
                q.append(np.where(low == high, a, (high - at) * a + (at - low) * b))
            quartiles += [x if c else None for x, c in zip(np.stack(q, axis=1).tolist(), count)]
        values = np.concatenate([past[:, 0], now[:, 0]])
        before = np.concatenate([[np.nan], values[:-1]])[len(past) :]
        # A number that isn't there is a null, not NaN
        plain = lambda x: pd.array(np.concatenate(x), dtype="Float64")
        return {
            "win_n": np.concatenate(n), "win_mean": _nulls(plain(mean)), "win_std": _nulls(plain(std)), "win_q": quartiles,
            "prev_value": _nulls(pd.array(before, dtype="Float64")),
        }


def _nulls(x) -> pd.Series:
    values = np.asarray(pd.Series(x).to_numpy(float, na_value=np.nan))
    made = values.astype(object)
    made[np.isnan(values)] = None
    return pd.Series(made, dtype=object)


class MonitorWindow(TailProcessor):
    """T4: statistics of the last ``keep`` + 1 rows, the row itself included: latency, score and, if given, counts per stage."""

    def __init__(self, columns: list[str], order: list[str], keep: int, stages: int):
        super().__init__(columns, order, keep)
        self.stages = stages

    def measure(self, past: np.ndarray, now: np.ndarray) -> dict:
        made: dict[str, list[np.ndarray]] = {}
        add = lambda name, x: made.setdefault(name, []).append(x)
        size = self.keep + 1
        for (_, latency), (_, score) in zip(*(_windows(past[:, i], now[:, i], size, 0) for i in (0, 1))):
            rows = np.arange(len(latency))
            lengths = np.minimum(len(past) + sum(map(len, made.get("win_n", []))) + rows + 1, size)
            add("win_n", lengths)
            known = np.maximum((~np.isnan(latency)).sum(axis=1), 1)
            add("latency_mean", np.nansum(latency, axis=1) / known)
            some = np.maximum((~np.isnan(score)).sum(axis=1), 1)
            mean = np.nansum(score, axis=1) / some
            add("score_mean", mean)
            add("score_stdev", np.sqrt(np.nansum((score - mean[:, None]) ** 2, axis=1) / np.maximum(some - 1, 1)))
            add("score_min", np.nanmin(score, axis=1))
            add("score_max", np.nanmax(score, axis=1))
            ordered = np.sort(latency, axis=1)
            for p in (50, 95, 99):
                add(f"latency_p{p}", ordered[rows, np.minimum(lengths * p // 100, lengths - 1)])
        if self.stages:
            for _, stage in _windows(past[:, 2], now[:, 2], size, 0):
                for s in range(self.stages):
                    add(f"_in_{s}", (stage == s).sum(axis=1))
        return {name: np.concatenate(parts) for name, parts in made.items()}


class FillAndCount(StatefulProcessor):
    """The last value that was there, and the rows since the last wet one, counted from the first row of the key."""

    def __init__(self, value: str, rain: str, wet: float):
        self.value, self.rain, self.wet = value, rain, wet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _state(value="double", dry="bigint"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["date"])
        value, dry = self.last.get() if self.last.exists() else (None, None)
        at = np.arange(len(batch))
        reset = batch[self.rain].to_numpy(float) > self.wet
        reset[0] |= dry is None
        since = np.maximum.accumulate(np.where(reset, at, -1))
        counted = np.where(since >= 0, at - since, (dry or 0) + 1 + at)
        filled = pd.Series(batch[self.value].to_numpy(float)).ffill()
        filled = filled if value is None else filled.fillna(value)
        end = filled.iloc[-1]
        self.last.update((None if np.isnan(end) else float(end), int(counted[-1])))
        yield batch[[c for c in batch.columns if c not in (self.value, self.rain)]].assign(value=_nulls(filled), dry=counted)

    def close(self) -> None:
        pass


class DeficitIndex(StatefulProcessor):
    """The index of a cell, begun anew each season."""

    def __init__(self, threshold: float, decay: float, ceiling: float):
        self.threshold, self.decay, self.ceiling = threshold, decay, ceiling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _state(season="int", adi="double"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["date"])
        season, adi = self.last.get() if self.last.exists() else (None, 0.0)
        out = self.walk(batch, season, adi)
        self.last.update((int(batch["season"].iloc[-1]), out[-1]))
        yield batch[[c for c in batch.columns if c not in ("din", "weight")]].assign(adi=out)

    def walk(self, batch: pd.DataFrame, season: int | None, adi: float) -> list[float]:
        out = []
        for s, din, weight in zip(batch["season"].tolist(), batch["din"].to_numpy(float).tolist(), batch["weight"].tolist()):
            adi, season = (adi if s == season else 0.0), s
            adi = adi * self.decay if din > self.threshold else min(self.ceiling, adi + weight)
            out.append(float(adi))
        return out

    def replay(self, rows: pd.DataFrame) -> pd.DataFrame:
        """What the stream would give for a key whose rows all come at once."""
        batch = _in_order(iter([rows]), ["date"])
        return batch[[c for c in batch.columns if c not in ("din", "weight")]].assign(adi=self.walk(batch, None, 0.0))

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """The ``size`` newest rows of a key. Emits the whole ring, or with ``fresh`` just what has newly come into it."""

    def __init__(self, schema: T.StructType, order: list[str], size: int, fresh: bool):
        self.schema, self.order, self.size, self.fresh = schema, order, size, fresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = pd.DataFrame([tuple(r) for r in self.ring.get()] if self.ring.exists() else [], columns=names)
        for part in rows:
            part = part[names].assign(_new=True)
            both = part if held.empty else pd.concat([held if "_new" in held else held.assign(_new=False), part], ignore_index=True)
            held = both.sort_values(self.order, ascending=False, kind="stable", ignore_index=True).head(self.size)
        self.ring.put(list(zip(*(held[c].tolist() for c in names))))
        yield (held[held["_new"].astype(bool)] if self.fresh else held)[names]

    def close(self) -> None:
        pass


class SlidingLog(StatefulProcessor):
    """The times of the requests that were let through during the last window; a timer clears what has gone by.

    Takes plain rows: a key has few per batch, so what it costs is what is done once per key.
    """

    def __init__(self, window_micros: int, timers: bool):
        self.window, self.timers = window_micros, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", _state(micros="bigint"))

    def _due(self, log: list[int]) -> int | None:
        return (log[-1] + self.window) // 1000 + 1 if log else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [t[0] for t in self.times.get()] if self.times.exists() else []
        log, out = before, []
        for now, event, limit in sorted((r["micros"], r["event_id"], r["limit"]) for r in rows):
            log = [t for t in log if t >= now - self.window]
            left = limit - len(log)
            reset = ((log[0] if log else now) + self.window) // 1_000_000
            if left > 0:
                log.append(now)
            out.append((event, left > 0, max(left - 1, 0), reset, None if left > 0 else max(0, reset - now // 1_000_000)))
        if log and log != before:
            self.times.put([(t,) for t in log])
        elif before and not log:
            self.times.clear()
        # The timer of a key is that of its newest time
        old, due = self._due(before), self._due(log)
        if self.timers and old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        for event, allowed, remaining, reset, retry in out:
            yield Row(event_id=event, allowed=allowed, remaining=remaining, reset_at=reset, retry_after=retry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
