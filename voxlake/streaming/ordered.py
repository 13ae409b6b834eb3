"""Event-time ordered folds as keyed streaming state.

Rows may arrive out of order: they wait in state until the watermark passes them and are then folded in order.
The state of a key is one small fold state plus the rows younger than the watermark. They wait in chunks: a slice of event
time, or as many thin slices in a row as hold a few rows. The key has a timer for the first row that waits, and a timer reads
and writes the chunks that are due, not all that waits. Rows later than the watermark are dropped by the engine and counted
in its progress (``numRowsDroppedByWatermark``); ``audit`` says which.

A fold may also say something between rows: ``progress`` after the rows that were ready, ``deadline`` the event time (in
milliseconds) at which its state ends if no row comes, and ``expire`` what that gives.

Every call of the engine for a key, and every access to state, costs far more than a row. Keys with few rows each are
therefore kept many to a slot (:class:`SlotFold`), where neither timers nor expiry are a key's own.
"""

from __future__ import annotations

import heapq
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxlake.operators.folds import Fold
from voxlake.operators.scans import instant


#: Event time of one slice of waiting rows.
SLICE_MS = 60_000
#: Rows up to which thin slices share a chunk, of a key and of a slot.
CHUNK_ROWS, SLOT_CHUNK_ROWS = 16, 256
#: Slots that share all keys, and groups of a slot whose fold states are kept together.
SLOTS, SLOT_GROUPS = 16_384, 32


class _Waiting:
    """Rows ``[ms, order, ...]`` that wait, by chunk."""

    def __init__(self, handle: StatefulProcessorHandle, slice_ms: int, chunk_rows: int):
        self.handle, self.slice_ms, self.chunk_rows = handle, slice_ms, chunk_rows
        self.chunks = handle.getMapState("waiting", "first BIGINT, id STRING", "rows STRING")

    def put(self, rows: list[list], soonest: int) -> None:
        """Keep ``rows`` and wake the key for the first of them."""
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        begin = 0
        for i in range(1, len(rows) + 1):
            new_slice = i == len(rows) or rows[i][0] // self.slice_ms != rows[i - 1][0] // self.slice_ms
            if i == len(rows) or (new_slice and i - begin >= self.chunk_rows):
                self._store(rows[begin:i])
                begin = i
        self.handle.registerTimer(max(rows[0][0], soonest))

    def _store(self, rows: list[list]) -> None:
        self.chunks.updateValue((rows[0][0], uuid.uuid4().hex), (json.dumps(rows, separators=(",", ":")),))

    def due(self, reached: int) -> Iterator[list]:
        """Rows up to ``reached`` in order. They leave the state, and the key is woken for the first that stays."""
        known = sorted(tuple(k) for k in self.chunks.keys())
        ready = [k for k in known if k[0] <= reached]
        soonest = [k[0] for k in known[len(ready) : len(ready) + 1]]
        heap, number, at = [], count(), 0
        while heap or at < len(ready):
            # Chunks overlap: all that begin up to the slice of the next row are open.
            while at < len(ready) and (not heap or ready[at][0] // self.slice_ms <= heap[0][2][0] // self.slice_ms):
                rows = json.loads(self.chunks.getValue(ready[at])[0])
                self.chunks.removeKey(ready[at])
                later = [r for r in rows if r[0] > reached]
                if later:
                    self._store(later)
                    soonest.append(later[0][0])
                for r in rows[: len(rows) - len(later)]:
                    heapq.heappush(heap, (r[1], next(number), r))
                at += 1
            yield heapq.heappop(heap)[2]
        if soonest:
            self.handle.registerTimer(min(soonest))


class OrderedFold(StatefulProcessor):
    """Runs a :class:`Fold` behind the watermark."""

    def __init__(self, fold: Fold, names: list[str], order: list[str], columns: list[str], ttl_ms: int | None, slice_ms: int = SLICE_MS):
        self.fold, self.names, self.order, self.columns, self.ttl_ms, self.slice_ms = fold, names, order, columns, ttl_ms, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows not folded yet never expire.
        self.waiting = _Waiting(handle, self.slice_ms, CHUNK_ROWS)
        self.folded = handle.getValueState("folded", "value STRING", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        for pdf in rows:
            order, values = _plain(pdf, self.order), _plain(pdf, self.columns)
            self.waiting.put([[int(at), o, v] for at, o, v in zip(pdf["ev_ms"], order, values)], soonest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        state = json.loads(self.folded.get()[0]) if self.folded.exists() else self.fold.start(key)
        out, stepped = [], False
        for _, _, values in self.waiting.due(reached):
            state, produced = self.fold.step(state, key, tuple(values))
            out += [(*key, *r) for r in produced]
            stepped = True
        ends = self.fold.deadline(state)
        expires = ends is not None and ends <= reached
        if expires:
            state, produced = self.fold.expire(state, key)
            out += [(*key, *r) for r in produced]
        elif stepped:
            out += [(*key, *r) for r in self.fold.progress(state, key)]
            if ends is not None:
                self.handle.registerTimer(ends)
        if stepped or expires:
            self.folded.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        """Nothing is held outside the state store."""


class SlotFold(StatefulProcessor):
    """Runs a :class:`Fold` without deadlines behind the watermark, over all keys of a slot side by side.

    A slot's keys come as JSON in ``slot_key``; fold states are kept by groups of keys, so a timer reads and writes a few.
    """

    def __init__(self, fold: Fold, names: list[str], order: list[str], columns: list[str], slice_ms: int = SLICE_MS):
        self.fold, self.names, self.order, self.columns, self.slice_ms = fold, names, order, columns, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = _Waiting(handle, self.slice_ms, SLOT_CHUNK_ROWS)
        self.folded = handle.getMapState("folded", "part INT", "states STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        for pdf in rows:
            order, values = _plain(pdf, self.order), _plain(pdf, self.columns)
            self.waiting.put([[int(at), o, k, v] for at, o, k, v in zip(pdf["ev_ms"], order, pdf["slot_key"], values)], soonest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        parts: dict[int, dict[str, Any]] = {}
        keys: dict[str, tuple] = {}
        out = []
        for _, _, name, values in self.waiting.due(timerValues.getCurrentWatermarkInMs()):
            if name not in keys:
                keys[name] = tuple(json.loads(name))
            own, part = keys[name], zlib.crc32(name.encode()) % SLOT_GROUPS
            if part not in parts:
                parts[part] = json.loads(self.folded.getValue((part,))[0]) if self.folded.containsKey((part,)) else {}
            states = parts[part]
            states[name], produced = self.fold.step(states[name] if name in states else self.fold.start(own), own, tuple(values))
            out += [(*own, *r) for r in produced]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=self.names)
                out = []
        for part, states in parts.items():
            self.folded.updateValue((part,), (json.dumps(states, separators=(",", ":")),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        """Nothing is held outside the state store."""


def _plain(pdf: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows of ``columns`` as JSON takes them."""
    plain = [pdf[c].tolist() if pdf[c].notna().all() else pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in columns]
    return zip(*plain)


def stream_fold(
    stream: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    columns: list[str],
    fold: Fold,
    fields: list[T.StructField],
    *,
    delay: str = "0 seconds",
    ttl_ms: int | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Fold ``columns`` of every key along event time and ``order``; output is the keys and ``fields``."""
    schema = T.StructType([stream.schema[k] for k in keys] + fields)
    # The engine hands rows over as named tuples, which do not keep names that begin with an underscore.
    timed = stream.withColumn("ev_ts", instant(F.col(ts))).withWatermark("ev_ts", delay)
    timed = timed.withColumns({"ev_ms": F.unix_millis("ev_ts"), "ev_us": F.unix_micros("ev_ts")})
    needed = ["ev_ts", "ev_ms", "ev_us", *order, *columns]
    if ttl_ms is None and not _has_deadlines(fold) and all(isinstance(stream.schema[k].dataType, (T.IntegralType, T.StringType)) for k in keys):
        # Values of a JSON array are of one type, so each is a text of JSON itself.
        named = F.concat(F.lit("["), F.concat_ws(",", *[_json(k) for k in keys]), F.lit("]"))
        slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
        timed = timed.withColumns({"slot": slot, "slot_key": named})
        keys, needed = ["slot"], ["slot_key", *needed]
        processor: StatefulProcessor = SlotFold(fold, schema.names, ["ev_us", *order], columns, slice_ms)
    else:
        processor = OrderedFold(fold, schema.names, ["ev_us", *order], columns, ttl_ms, slice_ms)
    placed = timed.select(*dict.fromkeys([*keys, *needed])).groupBy(*keys)
    return placed.transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _has_deadlines(fold: Fold) -> bool:
    return any(getattr(type(fold), name) is not getattr(Fold, name) for name in ("progress", "deadline", "expire"))


def _json(key: str) -> Column:
    """A key column's value as JSON."""
    whole = F.to_json(F.struct(F.col(key).alias("k")))
    return F.when(F.col(key).isNull(), "null").otherwise(whole.substr(F.lit(6), F.length(whole) - 6))
