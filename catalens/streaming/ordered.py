"""Stateful jobs whose verdicts depend on event time alone, not on how rows are dealt to files and batches.

Rows wait in state until the watermark has passed them, then take effect in order of time. What a key
remembers is dropped once that can't matter any more.

Every call of the state store costs as much as many rows, so state belongs to buckets of keys, not to
keys: a bucket's waiting rows lie in slots of time, as pickled blocks that are only ever appended, and
what its keys remember is one value. A task holds one slot of one bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegralType

from catalens.config import DEFAULTS

SECOND = 1_000_000
#: Buckets that the keys are dealt to; a stream's checkpoint depends on it.
BUCKETS = 1024


def _ordered(rows: list[tuple], width: int) -> list[tuple]:
    """Rows by their first ``width`` values, nulls first."""
    try:
        return sorted(rows, key=lambda r: r[:width])
    except TypeError:
        return sorted(rows, key=lambda r: [(x is not None, x) for x in r[:width]])


def _values(column: pd.Series) -> np.ndarray:
    """A column's values, with None for nulls (pandas makes whole numbers beside nulls fractions)."""
    if not column.isna().any():
        return column.to_numpy()
    plain = int if column.dtype.kind == "f" else (lambda x: x)
    return np.array([None if pd.isna(x) else plain(x) for x in column], dtype=object)


class InOrder(StatefulProcessor):
    """Holds rows (at, then ``columns``: name and type) and gives each key's to step() in order of time and columns."""

    #: Columns beside the time, in the order that breaks ties.
    columns: dict[str, str] = {}
    #: Columns of the result, the key's first.
    result: list[str] = []
    #: How many columns the key has; in a row they come last, as k0, k1, ...
    n_keys = 1
    slot_seconds = 86_400

    def step(self, at: int, row: tuple, memory: tuple | None) -> tuple[tuple, tuple | None]:
        """The result's row for one event, and what is remembered after it."""
        raise NotImplementedError

    def expires(self, memory: tuple) -> int | None:
        """From when (microseconds) the memory makes no difference; null: never."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Blocks of rows by slot and number, with their earliest time.
        self.waiting = handle.getMapState("waiting", "slot long, part long", "first long, rows binary")
        self.known = handle.getValueState("known", "memory binary")

    def _hold(self, slot: int, part: int, columns: list[list]) -> None:
        self.waiting.updateValue((slot, part), (min(columns[0]), pickle.dumps(columns, pickle.HIGHEST_PROTOCOL)))

    def _parts(self) -> dict[int, list[int]]:
        """The numbers of each slot's blocks."""
        parts: dict[int, list[int]] = {}
        for slot, part in self.waiting.keys():
            parts.setdefault(slot, []).append(part)
        return parts

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, following = None, None
        for frame in rows:
            frame = frame[~frame["closing"].astype(bool)]
            if not len(frame):
                continue
            if following is None:
                following = {slot: max(parts) + 1 for slot, parts in self._parts().items()}
            at = frame["at"].astype("datetime64[us]").astype("int64").to_numpy()
            slots = at // (self.slot_seconds * SECOND)
            order = np.argsort(slots, kind="stable")
            found, starts = np.unique(slots[order], return_index=True)
            names = [*self.columns, *(f"k{i}" for i in range(self.n_keys))]
            values = [at[order], *(_values(frame[c])[order] for c in names)]
            for slot, a, b in zip(found.tolist(), starts, [*starts[1:], len(order)]):
                part = following.get(slot, 0)
                self._hold(slot, part, [v[a:b].tolist() for v in values])
                following[slot] = part + 1
            first = min(int(at.min()), first) if first is not None else int(at.min())
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.known.get()
        memory: dict[tuple, tuple] = {} if known is None else pickle.loads(known[0])
        width, next_at, changed = 1 + len(self.columns), None, False
        for slot, parts in sorted(self._parts().items()):
            held = [self.waiting.getValue((slot, part)) for part in parts]
            if min(first for first, _ in held) > passed:
                next_at = min(first for first, _ in held)
                break
            rows = _ordered([r for _, block in held for r in zip(*pickle.loads(block))], width)
            due = [r for r in rows if r[0] <= passed]
            for part in parts:
                self.waiting.removeKey((slot, part))
            if len(due) < len(rows):
                rest = rows[len(due) :]
                next_at = rest[0][0]
                self._hold(slot, 0, [list(c) for c in zip(*rest)])
            out = []
            for row in due:
                owner = row[width:]
                made, memory[owner] = self.step(row[0], row[1:width], memory.get(owner))
                out.append((*owner, *made))
            changed = True
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.result, zip(*out))})
            if next_at is not None:
                break
        ends = {owner: self.expires(m) for owner, m in memory.items()}
        for owner, end in ends.items():
            if end is not None and end <= passed:
                del memory[owner]
                changed = True
        later = [end for end in ends.values() if end is not None and end > passed]
        if next_at is not None:
            later.append(next_at)
        if later:
            self.handle.registerTimer(-(-min(later) // 1000))
        if not memory and known is not None:
            self.known.clear()
        elif memory and changed:
            self.known.update((pickle.dumps(memory, pickle.HIGHEST_PROTOCOL),))

    def close(self) -> None:
        pass


def _run(events: DataFrame, keys: list[str], processor: InOrder, schema: str) -> DataFrame:
    processor.result, processor.n_keys = [c.split()[0] for c in schema.split(", ")], len(keys)
    # numbers are dealt as they come, other keys by a hash; the bucket is the state's column ``key``
    number = len(keys) == 1 and isinstance(events.schema[keys[0]].dataType, IntegralType)
    bucket = F.pmod(keys[0] if number else F.xxhash64(*keys), F.lit(BUCKETS)).cast("long")
    rows = events.select(bucket.alias("key"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "at", *processor.columns, "closing")
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "append", "EventTime")


class _RateLimit(InOrder):
    columns = {"event_id": "long"}

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * SECOND

    def step(self, at, row, memory):
        log = [t for t in (memory[0] if memory else ()) if t >= at - self.window]
        allowed = len(log) < self.limit
        return (row[0], allowed), (log + [at] * allowed,)

    def expires(self, memory):
        return max(memory[0]) + self.window + 1 if memory[0] else 0


def rate_limit(events: DataFrame, limit: int = DEFAULTS.rate_limit_per_window, seconds: int = DEFAULTS.rate_limit_window_seconds) -> DataFrame:
    """(key, event_id, allowed) of events (key, event_id, at): at most ``limit`` allowed in any ``seconds``, both ends included; rejected ones do not count."""
    return _run(events, ["key"], _RateLimit(limit, seconds), "key long, event_id long, allowed boolean")


class _Lockout(InOrder):
    columns = {"event_id": "long", "failed": "boolean"}

    def __init__(self, failures: int, seconds: int):
        self.failures, self.window = failures, seconds * SECOND

    def step(self, at, row, memory):
        log, until = (list(memory[0]), memory[1]) if memory else ([], 0)
        event_id, failed = row
        if at < until:
            return (event_id, True), (log, until)
        if not failed:
            return (event_id, False), ([], until)
        log = [t for t in log if at - t < self.window] + [at]
        if len(log) >= self.failures:
            log, until = [], at + self.window
        return (event_id, False), (log, until)

    def expires(self, memory):
        return max([t + self.window for t in memory[0]] + [memory[1]])


def lockout(events: DataFrame, failures: int = DEFAULTS.lockout_failures, seconds: int = DEFAULTS.lockout_seconds) -> DataFrame:
    """(key, event_id, locked) of events (key, event_id, at, failed).

    ``failures`` failures in less than ``seconds`` lock the key for as long; a success clears them, and
    what happens while locked changes nothing.
    """
    return _run(events, ["key"], _Lockout(failures, seconds), "key long, event_id long, locked boolean")


class _FirstOfEach(InOrder):
    columns = {"event_id": "long"}

    def __init__(self, seconds: int):
        self.window, self.slot_seconds = seconds * SECOND, seconds

    def step(self, at, row, memory):
        copy = memory is not None and at - memory[0] < self.window
        return (row[0], not copy), memory if copy else (at,)

    def expires(self, memory):
        return memory[0] + self.window


def first_of_each(events: DataFrame, keys: dict[str, str], seconds: int) -> DataFrame:
    """(keys, event_id) of the first event of each key (name and type), and of each that comes ``seconds`` or more after the last one kept.

    dropDuplicatesWithinWatermark keeps one row of a key a batch, whatever their times, so what it
    keeps depends on the batches; this does not.
    """
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", event_id long, kept boolean"
    return _run(events, list(keys), _FirstOfEach(seconds), schema).filter("kept").drop("kept")


class _PriceDrift(InOrder):
    columns = {"order_no": "long", "line_no": "long", "price_cents": "long", "currency": "string"}
    slot_seconds = 86_400 * 365

    def __init__(self, days: int | None):
        self.window = None if days is None else days * 86_400 * SECOND

    def step(self, at, row, memory):
        _, _, cents, currency = row
        known = memory is not None and (self.window is None or at - memory[2] <= self.window)
        return (cents, currency, *(memory[:2] if known else (None, None))), (cents, currency, at)

    def expires(self, memory):
        return None if self.window is None else memory[2] + self.window + 1


def price_drift(snapshots: DataFrame, days: int | None = DEFAULTS.price_history_retention_days) -> DataFrame:
    """Each snapshot (product_id, source, price_cents, currency, at, order_no, line_no) with the one before it, if that is at most ``days`` old (null: of any age)."""
    schema = "product_id string, source string, price_cents long, currency string, previous_cents long, previous_currency string"
    return _run(snapshots, ["product_id", "source"], _PriceDrift(days), schema)
