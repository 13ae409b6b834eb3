"""Sequential folds per key in constant memory.

Rows are partitioned by key, sorted inside the partition and streamed through a small state machine. No group is
collected: a task holds one key's state and one Arrow batch. Callers choose keys that cannot grow without bound
(a busy period, a job, a file), not whole clients or folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.scans import islands, micros

Row = tuple


class Fold:
    """State machine over one key's rows in order."""

    def start(self, key: tuple) -> Any:
        """State before the first row."""
        return None

    def step(self, state: Any, key: tuple, row: Row) -> tuple[Any, Iterable[tuple]]:
        """New state and the output rows (without the key) of one row."""
        raise NotImplementedError

    def finish(self, state: Any, key: tuple) -> Iterable[tuple]:
        """Output rows after the last row."""
        return ()

    def progress(self, state: Any, key: tuple) -> Iterable[tuple]:
        """In a stream, output rows after the rows that were ready."""
        return ()

    def deadline(self, state: Any) -> int | None:
        """In a stream, the event time in milliseconds at which the state ends if no row comes before."""
        return None

    def expire(self, state: Any, key: tuple) -> tuple[Any, Iterable[tuple]]:
        """New state and output rows when the deadline has passed."""
        return state, ()


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Fold, fields: list[T.StructField]
) -> DataFrame:
    """Run ``fold`` over ``columns`` of each key's rows along ``order``; output is the keys and ``fields``."""
    schema = T.StructType([df.schema[k] for k in keys] + fields)
    needed = list(dict.fromkeys([*keys, *order, *columns]))
    placed = df.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            key_rows = pdf[keys].itertuples(index=False, name=None)
            for key, row in zip(key_rows, pdf[columns].itertuples(index=False, name=None)):
                if key != current:
                    if current is not None:
                        out += [(*current, *r) for r in fold.finish(state, current)]
                    current, state = key, fold.start(key)
                state, produced = fold.step(state, key, row)
                out += [(*key, *r) for r in produced]
            yield pd.DataFrame(out, columns=schema.names)
        if current is not None:
            yield pd.DataFrame([(*current, *r) for r in fold.finish(state, current)], columns=schema.names)

    return placed.mapInPandas(run, schema)


class Hangover(Fold):
    """Utterance endpoint: fires on the frame where silence after speech first lasts long enough.

    Speech once seen stays seen, and silence keeps adding up after the endpoint; only new speech arms it again.
    Rows are ``(row_id, prob)``.
    """

    def __init__(self, *, threshold: float = 0.5, min_silence: int = 8000, frame: int = 512):
        self.threshold, self.min_silence, self.frame = threshold, min_silence, frame

    def start(self, key):
        return False, 0, False

    def step(self, state, key, row):
        seen, silence, armed = state
        row_id, prob = row
        if prob >= self.threshold:
            return (True, 0, True), ()
        if not seen:
            return state, ()
        silence += self.frame
        fires = armed and silence >= self.min_silence
        return (True, silence, armed and not fires), [(row_id,)] if fires else ()


class Segmenter(Fold):
    """Speech regions frame by frame; equal to the batch regions, with a bounded look-ahead.

    A region is released once no later frame can reach it. Rows are ``(prob,)``; a null probability ends the
    signal, as does ``finish``. Output is ``(region_idx, start, end)``.
    """

    def __init__(self, *, threshold=0.5, min_silence=8000, min_speech=4000, pad=1600, frame: int = 512):
        self.threshold, self.min_silence, self.min_speech = threshold, min_silence, min_speech
        self.pad, self.frame = pad, frame

    def start(self, key):
        # pos; open speech [a, b) with its run still going; padded region waiting for a neighbour; next number
        return {"pos": 0, "open": None, "run": False, "held": None, "next": 0}

    def step(self, state, key, row):
        prob = row[0]
        if prob is None or prob != prob:
            out = self._close(state)
            state.update(self.start(key))
            return state, out
        begin, end = state["pos"], state["pos"] + self.frame
        state["pos"], out = end, []
        if prob >= self.threshold:
            if state["open"] and not state["run"] and begin - state["open"][1] >= self.min_silence:
                out += self._settle(state)
            state["open"] = [state["open"][0] if state["open"] else begin, end]
            state["run"] = True
        else:
            state["run"] = False
            if state["open"] and end - state["open"][1] >= self.min_silence:
                out += self._settle(state)
        earliest = (state["open"][0] if state["open"] else end) - self.pad
        if state["held"] and earliest > state["held"][1]:
            out += self._release(state)
        return state, out

    def _settle(self, state):
        a, b = state["open"]
        state["open"] = None
        if b - a < self.min_speech:
            return []
        start, end, out = max(a - self.pad, 0), b + self.pad, []
        if state["held"] and start <= state["held"][1]:
            state["held"][1] = max(state["held"][1], end)
        else:
            out = self._release(state)
            state["held"] = [start, end]
        return out

    def _release(self, state):
        if not state["held"]:
            return []
        start, end = state["held"]
        state["held"] = None
        state["next"] += 1
        return [(state["next"] - 1, start, min(end, state["pos"]))]

    def _close(self, state):
        out = self._settle(state) if state["open"] else []
        return out + self._release(state)

    def finish(self, state, key):
        return self._close(state)


class RunningGauge(Fold):
    """Running sum of deltas. Rows are ``(row_id, delta)``."""

    def start(self, key):
        return 0

    def step(self, state, key, row):
        return state + int(row[1]), [(row[0], state + int(row[1]))]


class TokenBucket(Fold):
    """Capacity ``burst``, refill ``rpm`` per minute, one token per request; state is (tokens, last refill)."""

    # The largest rate that is told apart.
    MAX_RPM = 60_000

    def __init__(self, rpm: float, burst: int):
        self.per_ms = min(max(rpm, 1), self.MAX_RPM) / 60_000.0
        self.capacity = float(max(burst, 1))

    def start(self, key):
        return self.capacity, None

    def step(self, state, key, row):
        tokens, last = state
        row_id, now = row
        if last is not None and now > last:
            tokens = min(tokens + (now - last) * self.per_ms, self.capacity)
        elif last is not None:
            now = last
        allowed = tokens >= 1.0
        return (tokens - 1.0 if allowed else tokens, now), [(row_id, allowed)]


def rate_limit(
    requests: DataFrame, client: str, row_id: str, ms: Column, *, rpm: float, burst: int, block_s: int = 86_400
) -> DataFrame:
    """Verdict ``row_id, allowed`` for each request under a token bucket per client; ``ms`` is its time.

    A pause long enough to refill the bucket makes what follows independent of what came before, so clients are
    cut at those pauses and a busy client is spread over many tasks.
    """
    bucket = TokenBucket(rpm, burst)
    refill_ms = bucket.capacity / bucket.per_ms
    timed = requests.withColumn("_ms", ms)
    periods = islands(
        timed,
        [client],
        ["_ms", row_id],
        F.floor(timed["_ms"] / (block_s * 1000)),
        look_back={"_prev_ms": timed["_ms"]},
        starts=F.col("_ms") - F.col("_prev_ms") >= refill_ms,
        island="busy_period",
    )
    fields = [requests.schema[row_id], T.StructField("allowed", T.BooleanType())]
    return ordered_fold(periods, [client, "busy_period"], ["_ms", row_id], [row_id, "_ms"], bucket, fields).drop("busy_period")


class JobLifecycle(Fold):
    """Status, attempts and progress of a job; a panic is retried up to ``max_retries`` times."""

    TERMINAL = ("done", "failed", "cancelled")

    def __init__(self, max_retries: int):
        self.max_retries = max_retries

    def start(self, key):
        return {"status": None, "attempts": 0, "processed": 0.0, "body": 0, "updated": None, "error": None}

    def step(self, state, key, row):
        event, when, processed, error, body = row
        job = state
        if event == "submit":
            job.update(status="queued", body=0 if pd.isna(body) else int(body), updated=when)
        elif job["status"] is None or job["status"] in self.TERMINAL:
            # Unknown jobs cannot change, and late results of finished or cancelled jobs are discarded.
            return job, ()
        elif event == "start":
            job.update(status="processing", attempts=job["attempts"] + 1, updated=when)
            job["processed"] += processed
        elif event == "progress":
            job.update(updated=when)
            job["processed"] += processed
        elif event == "done":
            job.update(status="done", body=0, updated=when)
        elif event == "cancel":
            job.update(status="cancelled", body=0, updated=when)
        elif event == "fail":
            if "panicked" in (error or "") and job["attempts"] <= self.max_retries:
                job.update(status="queued", updated=when)
            else:
                job.update(status="failed", body=0, error=error, updated=when)
        return job, ()

    def finish(self, state, key):
        if state["status"] is None:
            return ()
        return [(state["status"], state["attempts"], float(state["processed"]), state["body"], state["updated"])]


JOB_FIELDS = [
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("processed_seconds", T.DoubleType()),
    T.StructField("body_bytes", T.LongType()),
    T.StructField("updated_us", T.LongType()),
]


def job_states(events: DataFrame, *, max_retries: int = 2) -> DataFrame:
    """State of every job after its events ``event, ts, seq, processed_seconds, error, body_bytes``."""
    timed = events.withColumn("_us", micros(events["ts"]))
    columns = ["event", "_us", "processed_seconds", "error", "body_bytes"]
    return ordered_fold(timed, ["job_id"], ["_us", "seq"], columns, JobLifecycle(max_retries), JOB_FIELDS)


class Settle(Fold):
    """Schedule a file once its size and time repeat often enough.

    Rows are ``(poll, kind, size, mtime)`` with kind ``seen`` or ``finished``. Files of poll zero count as done.
    A file that misses a poll is forgotten unless it is in flight; a change in flight is processed again.
    """

    def __init__(self, settle_polls: int):
        self.settle_polls = max(settle_polls, 1)

    def step(self, state, key, row):
        poll, kind, size, mtime = row
        if kind == "finished":
            if state and state["status"] == "in_flight":
                state["status"] = "pending" if state["dirty"] else "done"
                state.update(dirty=False, stable=0 if state["status"] == "pending" else state["stable"])
            return state, ()
        gone = state and state["status"] != "in_flight" and poll > state["poll"] + 1
        if state is None or gone:
            status = "done" if poll == 0 else "pending"
            return {"sig": [size, mtime], "stable": 0, "status": status, "dirty": False, "poll": poll}, ()
        state["poll"] = poll
        if state["sig"] != [size, mtime]:
            state.update(sig=[size, mtime], stable=0)
            if state["status"] == "in_flight":
                state["dirty"] = True
            else:
                state["status"] = "pending"
        elif state["status"] == "pending":
            state["stable"] += 1
            if state["stable"] >= self.settle_polls:
                state["status"] = "in_flight"
                return state, [(int(poll),)]
        return state, ()


def settled_files(polls: DataFrame, *, settle_polls: int = 2) -> DataFrame:
    """Polls at which files are scheduled: ``path, poll``."""
    fields = [T.StructField("scheduled_poll", T.LongType())]
    ordered = polls.selectExpr("*", "CASE WHEN kind = 'finished' THEN 0 ELSE 1 END AS _rank")
    return ordered_fold(ordered, ["path"], ["poll", "_rank"], ["poll", "kind", "size", "mtime"], Settle(settle_polls), fields)


class Assembler(Fold):
    """Partial and final texts of a live session.

    Rows are ``(row_id, text, over_cap, blank, vad)``: the decoded live tail and what ended with it. A full
    window commits the tail without ending the utterance.
    """

    def __init__(self, mode: str = "auto", vad_attached: bool = True):
        if mode not in ("auto", "assistant", "manual"):
            raise ValueError(f"unknown endpoint mode {mode!r}")
        self.mode, self.vad_attached = mode, vad_attached

    def ends(self, blank: bool, vad: bool) -> bool:
        """Whether the utterance is over under the endpoint mode."""
        if self.mode == "manual":
            return False
        return vad or (self.mode == "auto" and blank and not self.vad_attached)

    def start(self, key):
        return []

    def step(self, state, key, row):
        row_id, text, over_cap, blank, vad = row
        live = (text or "").strip()
        full = " ".join([*state, live] if live else state)
        if self.ends(bool(blank), bool(vad)):
            return [], [(row_id, "final", full, "vad" if vad else "blank")] if full.strip() else []
        kept = [full] if over_cap and full else state
        return kept, [(row_id, "partial", full, None)] if full else []


def assemble(
    decodes: DataFrame, keys: list[str], order: list[str], row_id: str, fold: Assembler, *, block: Column
) -> DataFrame:
    """Messages ``row_id, type, text, endpoint_reason`` of every session.

    An endpoint empties the assembler, so sessions are cut there and each utterance is folded on its own.
    """
    ended = F.lit(False)
    if fold.mode != "manual":
        ended = F.col("vad") | F.col("blank") if fold.mode == "auto" and not fold.vad_attached else F.col("vad")
    utterances = islands(
        decodes, keys, order, block, look_back={"_ended": F.coalesce(ended, F.lit(False))}, starts=F.col("_ended"), island="utterance"
    )
    fields = [
        decodes.schema[row_id],
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("endpoint_reason", T.StringType()),
    ]
    columns = [row_id, "text", "over_cap", "blank", "vad"]
    return ordered_fold(utterances, [*keys, "utterance"], order, columns, fold, fields).drop("utterance")


class StrideGate(Fold):
    """When a live window is decoded: after ``stride`` new samples or at the cap, which slides the window."""

    def __init__(self, stride: int = 12_800, cap: int = 40_000, keep: int = 24_000):
        self.stride, self.cap, self.keep = stride, cap, keep

    def start(self, key):
        return 0, 0, 0

    def step(self, state, key, row):
        held, pending, window_start = state
        row_id, samples = row
        held, pending = held + int(samples), pending + int(samples)
        over_cap = held >= self.cap
        if not samples or (pending < self.stride and not over_cap):
            return (held, pending, window_start), ()
        out = [(row_id, window_start, held, over_cap)]
        if over_cap:
            window_start, held = window_start + held - min(self.keep, held), min(self.keep, held)
        return (held, 0, window_start), out


def decode_steps(chunks: DataFrame, keys: list[str], order: list[str], row_id: str, gate: StrideGate) -> DataFrame:
    """Decodes ``row_id, window_start, window_samples, over_cap`` triggered by arriving chunks."""
    fields = [
        chunks.schema[row_id],
        T.StructField("window_start", T.LongType()),
        T.StructField("window_samples", T.LongType()),
        T.StructField("over_cap", T.BooleanType()),
    ]
    return ordered_fold(chunks, keys, order, [row_id, "samples"], gate, fields)


SESSION_FIELDS = [T.StructField(n, T.LongType()) for n in ("session_start_ms", "messages", "ttfp_ms", "finalization_lag_ms", "version")] + [
    T.StructField("open", T.BooleanType())
]


class LiveSession(Fold):
    """Sessions that end ``idle_ms`` after their last message, or with the first message more than ``cap_ms`` after they began.

    Rows are ``(at_ms, type, counted)``. Output are versions of a session; the highest one counts. A session that goes on is
    shown as open after the rows that were ready, and once more when it has ended.
    """

    def __init__(self, idle_ms: int, cap_ms: int):
        self.idle_ms, self.cap_ms = idle_ms, cap_ms

    def start(self, key):
        return None

    def step(self, state, key, row):
        at, kind, counted = row
        out = []
        if state is not None and (at - state["last"] >= self.idle_ms or at - state["from"] > self.cap_ms):
            out, state = [self._row(state, False)], None
        if state is None:
            state = {"from": at, "last": at, "messages": 0, "sent": None, "partial": None, "final": None, "version": 0}
        state["last"] = at
        state["messages"] += 1
        if kind == "send" and state["sent"] is None:
            state["sent"] = at
        if counted and state["partial"] is None:
            state["partial"] = at
        if kind == "final":
            state["final"] = at
        return state, out

    def progress(self, state, key):
        if state is None:
            return []
        row = self._row(state, True)
        state["version"] += 1
        return [row]

    def deadline(self, state):
        return None if state is None else state["last"] + self.idle_ms

    def expire(self, state, key):
        return None, [self._row(state, False)]

    def finish(self, state, key):
        return [] if state is None else [self._row(state, True)]

    @staticmethod
    def _row(state, still_open):
        since = lambda at: None if at is None or state["sent"] is None else at - state["sent"]
        return state["from"], state["messages"], since(state["partial"]), since(state["final"]), state["version"], still_open
