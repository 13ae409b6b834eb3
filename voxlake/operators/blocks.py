"""Length-balanced blocks of consecutive segments.

The least-cost tiling of a recording is a shortest path over its cuts (places between segments). A recording is sliced by
time. For a slice, the cuts that a block can still reach back to from its start are open, and so are those at its end; a
table holds the least cost from each open cut at the start to each at the end. Tables combine by (min, +), so:

1. every slice makes its table, from its own rows and the open cuts before it;
2. tables are combined as a tree, FAN at a time, and going down the tree again gives the costs at the start of each slice;
3. with these every slice finds for each of its cuts the cut before it on the best way there, just as a pass over the
   whole recording would, among equal ways the one with the nearest cut;
4. what these say about the open cuts at both ends are tables too. Combined and taken down from the last cut, they say where
   the best path leaves each slice, and each slice reads its part of it.

No task sees more of a recording than a slice, or FAN tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.joins import safe_join
from voxlake.operators.scans import index_block, scan
from voxlake.session import materialize

SLACK = 1e-6
#: Length of a slice in longest blocks (more than one), and tables that are combined at a time.
SLICE, FAN = 64, 64

_TABLE = [T.StructField("slice", T.LongType())] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("entry", "exit")]
_COSTS = [*_TABLE, T.StructField("cost", T.ArrayType(T.DoubleType()))]
_WAYS = [*_TABLE, T.StructField("end", T.LongType())]
_STATE = [T.StructField("slice", T.LongType()), T.StructField("at", T.ArrayType(T.LongType())), T.StructField("cost", T.ArrayType(T.DoubleType()))]
_POINTERS = [*_WAYS, T.StructField("cuts", T.ArrayType(T.LongType())), T.StructField("sources", T.ArrayType(T.LongType()))]


class Band:
    """The wanted length of a block and what it may be, in seconds."""

    def __init__(self, target: float, min_len: float, max_len: float):
        self.target, self.min_len, self.max_len = target, min_len, max_len

    def within(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each cut the first cut, and the one after the last, at which a block that ends there may begin."""
        first = np.searchsorted(times, times - self.max_len - SLACK, "left")
        return first, np.minimum(np.searchsorted(times, times - self.min_len + SLACK, "right"), np.arange(len(times)))

    def costs(self, times: np.ndarray, begin: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least costs of the cuts after ``begin`` from those up to it, a row of ``known`` each, and the cut before on the
        way of the first row (-1: none)."""
        first, last = self.within(times)
        source = np.full(len(times), -1)
        for j in range(begin + 1, len(times)):
            a, b = first[j], last[j]
            if a < b:
                ways = known[:, a:b] + (times[j] - times[a:b] - self.target) ** 2
                known[:, j] = ways.min(1)
                if known[0, j] < np.inf:
                    source[j] = b - 1 - int(ways[0, ::-1].argmin())
        return known, source

    def open_at(self, times: np.ndarray, end: int) -> np.ndarray:
        """The cuts up to ``end`` from which a block may go beyond it."""
        return np.flatnonzero(times[: end + 1] >= times[end] - self.max_len - 2 * SLACK)


def _cuts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and times of the cuts of a slice, those before it first, and which of them is its start."""
    pdf = pdf.sort_values("_position")
    times = np.r_[pdf["_before"].to_numpy(float), pdf["_through"].iloc[-1]]
    positions = np.r_[pdf["_position"].to_numpy(np.int64) - 1, pdf["_position"].iloc[-1]]
    return positions, np.maximum.accumulate(times), int((~pdf["own"]).sum())


def _cost_table(pdf: pd.DataFrame, band: Band) -> tuple:
    positions, times, begin = _cuts(pdf)
    entry, exit_ = band.open_at(times, begin), band.open_at(times, len(times) - 1)
    known = np.full((len(entry), len(times)), np.inf)
    known[np.arange(len(entry)), entry] = 0.0
    known, _ = band.costs(times, begin, known)
    exit_ = exit_[exit_ > begin]
    return positions[entry], positions[exit_], known[:, exit_].ravel()


def _through(table: dict, at: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs at the end of a table from those at its start; ``cost`` may have a row for each of several starts."""
    entry, exit_ = np.asarray(table["entry"]), np.asarray(table["exit"])
    rows = np.full((len(cost), len(entry)), np.inf)
    _, here, there = np.intersect1d(entry, at, return_indices=True)
    rows[:, here] = cost[:, there]
    own = np.asarray(table["cost"], float).reshape(len(entry), len(exit_))
    return exit_, np.array([(r[:, None] + own).min(0) for r in rows])


def _combined_costs(tables: list[dict]) -> tuple:
    first = tables[0]
    at, cost = np.asarray(first["exit"]), np.asarray(first["cost"], float).reshape(len(first["entry"]), -1)
    for table in tables[1:]:
        at, cost = _through(table, at, cost)
    return first["entry"], at, cost.ravel()


def _costs_down(tables: list[dict], state: dict | None) -> list[tuple]:
    at, cost = (np.zeros(1, np.int64), np.zeros(1)) if state is None else (np.asarray(state["at"]), np.asarray(state["cost"], float))
    out = []
    for table in tables:
        out.append((table["slice"], at, cost))
        at, rows = _through(table, at, cost[None, :])
        cost = rows[0]
    return out


def _combined_ways(tables: list[dict]) -> tuple:
    last = tables[-1]
    ways = dict(zip(last["exit"], last["entry"]))
    for table in reversed(tables[:-1]):
        before = dict(zip(table["exit"], table["entry"]))
        ways = {y: before[x] for y, x in ways.items() if x in before}
    return list(ways.values()), list(ways), last["end"]


def _ways_down(tables: list[dict], state: dict | None) -> list[tuple]:
    at = int(tables[-1]["end"] if state is None else state["at"][0])
    out = []
    for table in reversed(tables):
        ways = dict(zip(table["exit"], table["entry"]))
        if at not in ways:
            return []  # only the last cut can lack a way: then there is no tiling
        out.append((table["slice"], [at], []))
        at = int(ways[at])
    return out


def _schema(df: DataFrame, keys: list[str], fields: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + fields)


def _up_and_down(leaves: DataFrame, keys: list[str], fields: list[T.StructField], combine: Callable, down: Callable) -> DataFrame:
    """What ``down`` says for every leaf: tables are combined FAN at a time until one task has all of a key, then unrolled."""
    parent = F.floor(F.col("slice") / FAN).alias("_up")
    schema, state_schema = _schema(leaves, keys, fields), _schema(leaves, keys, _STATE)
    names, state_names = schema.names, state_schema.names

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = pdf.sort_values("slice").to_dict("records")
        return pd.DataFrame([(*key, *combine(tables))], columns=names)

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[:-1], *r) for r in down(pdf.sort_values("slice").to_dict("records"), None)], columns=state_names)

    def follow(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = down(pdf.sort_values("slice").to_dict("records"), above.to_dict("records")[0]) if len(above) and len(pdf) else []
        return pd.DataFrame([(*key[:-1], *r) for r in rows], columns=state_names)

    levels, most = [leaves], leaves.agg(F.max("slice")).first()[0] or 0
    while most >= FAN:
        levels.append(materialize(levels[-1].groupBy(*keys, parent).applyInPandas(merge, schema), "tables"))
        most //= FAN
    state = levels.pop().groupBy(*keys, parent).applyInPandas(begin, state_schema)
    for level in reversed(levels):
        above = materialize(state, "tables").groupBy(*keys, F.col("slice").alias("_up"))
        state = level.groupBy(*keys, parent).cogroup(above).applyInPandas(follow, state_schema)
    return state


def assign_blocks(
    segments: DataFrame, keys: list[str], order: str, *, target: float, min_len: float, max_len: float
) -> DataFrame:
    """Every segment with the block it is in: ``keys, order, seconds, position, before, through, first_position``.

    Blocks deviate from ``target`` by the least sum of squares, every one inside the band; a recording without such a tiling
    drops out. Positions count segments from one, ``before`` and ``through`` are seconds from the start. Null lengths are 0.
    """
    band, span = Band(target, min_len, max_len), SLICE * max_len
    rows = segments.select(*keys, order, F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)).alias("seconds"))
    block = F.floor(F.col(order) / 65_536)
    numbered = scan(rows, keys, [order], block, row_number="_position", sums={"_through": F.col("seconds")})
    # A cut is at one and the same time for both its segments: a difference would be off by a rounding, which decides between equals.
    numbered = scan(numbered, keys, ["_position"], index_block("_position"), lags={"_before": F.col("_through")}).fillna(0.0, ["_before"])
    numbered = materialize(numbered.withColumn("slice", F.floor(F.col("_before") / span)), "segments")

    own = numbered.select(*keys, "slice", "_position", "_before", "_through", F.lit(True).alias("own"))
    reach = F.col("_before") >= (F.col("slice") + 1) * span - max_len - 3 * SLACK
    ahead = own.filter(reach).withColumns({"slice": F.col("slice") + 1, "own": F.lit(False)})
    sliced = own.unionByName(ahead)
    cost_schema, pointer_schema = _schema(numbered, keys, _COSTS), _schema(numbered, keys, _POINTERS)

    def tabulate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = [(*key, *_cost_table(pdf, band))] if pdf["own"].any() else []
        return pd.DataFrame(made, columns=cost_schema.names)

    tables = materialize(sliced.groupBy(*keys, "slice").applyInPandas(tabulate, cost_schema), "tables")
    costs = _up_and_down(tables, keys, _COSTS, _combined_costs, _costs_down)

    def point(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state) or not pdf["own"].any():
            return pd.DataFrame([], columns=pointer_schema.names)
        positions, times, begin = _cuts(pdf)
        known = np.full((1, len(times)), np.inf)
        _, here, there = np.intersect1d(positions[: begin + 1], np.asarray(state["at"].iloc[0]), return_indices=True)
        known[0, here] = np.asarray(state["cost"].iloc[0], float)[there]
        _, source = band.costs(times, begin, known)
        before = source.copy()  # the open cut at the start on the way to each cut
        for j in range(begin + 1, len(times)):
            if source[j] > begin:
                before[j] = before[source[j]]
        open_ = band.open_at(times, len(times) - 1)
        open_ = open_[(open_ > begin) & (before[open_] >= 0)]
        cuts = np.arange(begin + 1, len(times))
        sources = np.where(source[cuts] >= 0, positions[source[cuts]], -1)
        return pd.DataFrame(
            [(*key, positions[before[open_]], positions[open_], positions[-1], positions[cuts], sources)], columns=pointer_schema.names
        )

    pointed = sliced.groupBy(*keys, "slice").cogroup(costs.groupBy(*keys, "slice")).applyInPandas(point, pointer_schema)
    pointed = materialize(pointed, "pointers")
    leaves = _up_and_down(pointed.drop("cuts", "sources"), keys, _WAYS, _combined_ways, _ways_down)
    path = safe_join(pointed.select(*keys, "slice", "cuts", "sources"), leaves.select(*keys, "slice", "at"), [*keys, "slice"])

    out_schema = _schema(numbered, numbered.columns, [T.StructField("first_position", T.LongType())])

    def read(key: tuple, pdf: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        if not len(way) or not len(pdf):
            return pd.DataFrame([], columns=out_schema.names)
        source = dict(zip(way["cuts"].iloc[0].tolist(), way["sources"].iloc[0].tolist()))
        cut, starts = int(way["at"].iloc[0][0]), []
        while cut in source:
            cut = source[cut]
            starts.append(cut)
        place = np.searchsorted(starts[::-1], pdf["_position"].to_numpy(np.int64) - 1, "right") - 1
        tail = pdf["_position"].to_numpy(np.int64) > int(way["at"].iloc[0][0])
        first = np.where(tail, way["at"].iloc[0][0], np.array(starts[::-1])[place]) + 1
        return pdf.assign(first_position=first)[out_schema.names]

    placed = numbered.groupBy(*keys, "slice").cogroup(path.groupBy(*keys, "slice")).applyInPandas(read, out_schema)
    return placed.select(
        *keys, order, "seconds", F.col("_position").alias("position"), F.col("_before").alias("before"),
        F.col("_through").alias("through"), "first_position",
    )


def balanced_blocks(
    segments: DataFrame, keys: list[str], order: str, *, target: float, min_len: float, max_len: float
) -> DataFrame:
    """The blocks of :func:`assign_blocks`: ``block_idx, first_segment, last_segment, seconds``."""
    placed = assign_blocks(segments, keys, order, target=target, min_len=min_len, max_len=max_len)
    blocks = placed.groupBy(*keys, "first_position").agg(
        F.min(order).alias("first_segment"),
        F.max(order).alias("last_segment"),
        (F.max("through") - F.min("before")).alias("seconds"),
    )
    return number_blocks(blocks, keys).select(*keys, "block_idx", "first_segment", "last_segment", "seconds")


def number_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks``, one row for each ``first_position``, with ``block_idx`` from zero."""
    ranked = scan(blocks, keys, ["first_position"], index_block("first_position"), row_number="_rn")
    return ranked.withColumn("block_idx", F.col("_rn") - 1).drop("_rn")
