"""Greedy packing of ordered rows into spans, split across blocks.

A span starts at some row and grows until a measure runs past the span's anchor by more than a limit; the row
that would overrun starts the next span. The rule is sequential, but the only thing that crosses a block edge is
the anchor of the open span. Each block is therefore reduced to a short table "anchor on entry -> anchor on
exit" (the span starts reachable from different anchors fall together after a few rows), the tables are
chained per key, and the blocks are finished in parallel with their known entry anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.joins import safe_join
from voxlake.operators.scans import BLOCK
from voxlake.session import materialize


@dataclass(frozen=True)
class Limit:
    """A row overruns when ``measure - anchor > most``."""

    measure: str
    anchor: str
    most: float


class _Rows:
    """One block's rows as arrays, with the search for the row that overruns a span."""

    def __init__(self, column: Callable, limits: list[Limit], changed: np.ndarray | None):
        numbers = lambda name: np.asarray(column(name), dtype="float64")
        self.forced = np.asarray(column("_forced"), dtype="bool")
        self.measures = [numbers(x.measure) for x in limits]
        self.anchors = [numbers(x.anchor) for x in limits]
        self.most = [float(x.most) for x in limits]
        breaks = self.forced if changed is None else self.forced | changed
        # Rows that fall behind the row before them, other than where a segment begins.
        self.rising = [not ((m[1:] < m[:-1]) & ~breaks[1:]).any() for m in self.measures]
        edges = [0, *(np.flatnonzero(breaks[1:]) + 1).tolist(), len(self.forced)]
        self.segments = list(zip(edges, edges[1:]))

    def anchor(self, i: int) -> list[float]:
        return [float(a[i]) for a in self.anchors]

    def next_start(self, anchor: list[float], start: int, stop: int) -> int:
        """First row in [start, stop) with ``measure - anchor > most`` for some limit (``stop`` if none)."""
        best = stop
        for m, a, most, rising in zip(self.measures, anchor, self.most, self.rising):
            if rising:
                at = start + int(m[start:best].searchsorted(a + most, side="right"))
                # The sum may round; the comparison below is the rule.
                while at > start and m[at - 1] - a > most:
                    at -= 1
                while at < best and not m[at] - a > most:
                    at += 1
            else:
                over = np.flatnonzero(m[start:best] - a > most)
                at = start + int(over[0]) if len(over) else best
            best = min(best, at)
        return best

    def last_start(self, i: int, stop: int) -> int:
        """Start of the span that is open at ``stop`` when one starts at ``i``."""
        while True:
            following = self.next_start(self.anchor(i), i + 1, stop)
            if following >= stop:
                return i
            i = following


def greedy_spans(
    df: DataFrame,
    keys: list[str],
    order: str,
    block: Column,
    limits: list[Limit],
    *,
    forced: Column,
    span: str = "span_start",
    gather: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]] | None = None,
    fields: list[T.StructField] | None = None,
) -> DataFrame:
    """Add ``span``: the ``order`` value of the row that opens each row's span.

    ``forced`` marks rows that start a span regardless of the limits; the first row of a key must be one.
    ``order`` is an integer and ``block`` must not decrease along it.

    With ``gather`` the rows of a span are put together where they are found, so that spans move on and not rows. It takes
    a batch and the offsets of the runs in it, and gives an array for each of ``fields``. Output is ``keys, span, piece,
    fields``: a span has a row for each block that it touches, and ``piece`` is the ``order`` of the first row there.
    """
    rows = materialize(df.withColumns({"_forced": F.coalesce(forced, F.lit(True)), BLOCK: block}), "span-rows")
    entries = _block_entries(rows, keys, order, limits)
    known = safe_join(rows, entries, [*keys, BLOCK], "left").withColumn("_group", F.xxhash64(*keys, BLOCK))
    placed = known.repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, order)
    schema = T.StructType(
        [f for f in placed.schema if f.name not in ("_forced", BLOCK, "_group", "entry")]
        + [T.StructField(span, T.LongType())]
    )
    names = schema.names[:-1]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Batches, the span of each row, and whether another block begins with it."""
        group, opened, open_at = None, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column("_group").to_numpy(), batch.column(BLOCK).to_numpy()])
            changed = np.concatenate([[tuple(groups[:, 0]) != group], (np.diff(groups) != 0).any(axis=0)])
            data = _Rows(batch.column, limits, changed)
            positions = batch.column(order).to_numpy()
            out = np.full(batch.num_rows, -1, dtype="int64")
            for lo, hi in data.segments:
                if changed[lo]:
                    entry = batch.column("entry")[lo].as_py()
                    opened, open_at = (entry[:-1], int(entry[-1])) if entry else (None, -1)
                i = lo if data.forced[lo] else data.next_start(opened, lo, hi)
                out[lo:i] = open_at
                while i < hi:
                    opened, open_at = data.anchor(i), int(positions[i])
                    following = data.next_start(opened, i + 1, hi)
                    out[i:following] = open_at
                    i = following
            group = tuple(groups[:, -1])
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names), out, changed

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out, _ in located(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    if gather is None:
        return placed.mapInArrow(finish, schema)
    long = T.LongType()
    piece_schema = T.StructType([schema[k] for k in keys] + [T.StructField(span, long), T.StructField("piece", long), *fields])

    def made(batch: pa.RecordBatch, out: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        first = pa.array(offsets[:-1])
        columns = [*[batch.column(k).take(first) for k in keys], pa.array(out[offsets[:-1]]), batch.column(order).take(first).cast("int64")]
        return pa.RecordBatch.from_arrays(columns + gather(batch, offsets), names=piece_schema.names)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_out = None, None  # the last run, which the next batch may go on with
        for batch, out, changed in located(batches):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                out, changed = np.concatenate([held_out, out]), np.concatenate([np.zeros(len(held_out), "bool"), changed])
            opens = np.flatnonzero(changed[1:] | (out[1:] != out[:-1])) + 1
            last = int(opens[-1]) if len(opens) else 0
            if last:
                yield made(batch.slice(0, last), out, np.concatenate([[0], opens]))
            held, held_out = batch.slice(last), out[last:]
        if held is not None:
            yield made(held, held_out, np.array([0, len(held_out)]))

    return placed.mapInArrow(gathered, piece_schema)


def _block_entries(rows: DataFrame, keys: list[str], order: str, limits: list[Limit]) -> DataFrame:
    """The anchor and position of the span that is open when a block begins, for keys of several blocks."""
    spread = rows.groupBy(*keys).agg(F.min(BLOCK).alias("_lo"), F.max(BLOCK).alias("_hi")).filter("_lo <> _hi")
    columns = dict.fromkeys([*keys, BLOCK, order, "_forced", *[c for x in limits for c in (x.measure, x.anchor)]])
    slim = safe_join(rows.select(*columns), spread.select(*keys), keys, "left_semi")
    anchor_type = T.ArrayType(T.DoubleType())
    table_schema = T.StructType(
        [slim.schema[k] for k in (*keys, BLOCK)]
        + [T.StructField("bounds", T.ArrayType(anchor_type)), T.StructField("exits", T.ArrayType(anchor_type))]
    )
    entry_schema = T.StructType([slim.schema[k] for k in (*keys, BLOCK)] + [T.StructField("entry", anchor_type)])

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        data = _Rows(lambda n: pdf[n], limits, None)
        positions = pdf[order].to_numpy()
        head = data.segments[0][1]
        # Candidate first breaks inside the head: 0..head (head: the open span covers it).
        exit_of = np.full(head + 1, -1, dtype="int64")
        if len(data.segments) > 1 or data.forced[0]:
            exit_of[:] = data.last_start(*data.segments[-1])
        else:
            for p in range(head - 1, -1, -1):
                following = data.next_start(data.anchor(p), p + 1, head)
                exit_of[p] = p if following >= head else exit_of[following]
        bounds, exits = [], []
        for p in [0, *(np.flatnonzero(np.diff(exit_of)) + 1).tolist()]:
            # Reaching break p means no row before p overran.
            bounds.append([float(m[:p].max()) if p else float("-inf") for m in data.measures])
            exits.append(None if exit_of[p] < 0 else [*data.anchor(exit_of[p]), float(positions[exit_of[p]])])
        first = pdf.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in keys}, BLOCK: first[BLOCK], "bounds": bounds, "exits": exits}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        most = [x.most for x in limits]
        entry, entries = None, []
        for bounds, exits in zip(pdf["bounds"], pdf["exits"]):
            entries.append(entry)
            pick = 0
            if entry is not None:
                for n, bound in enumerate(bounds):
                    if all(not b - a > lim for b, a, lim in zip(bound, entry, most)):
                        pick = n
            entry = exits[pick] if exits[pick] is not None else entry
        out = pdf[[*keys, BLOCK]].copy()
        out["entry"] = entries
        return out

    tables = slim.groupBy(*keys, BLOCK).applyInPandas(tabulate, table_schema)
    return tables.groupBy(*keys).applyInPandas(chain, entry_schema)
