"""Approximate nearest neighbours by low-dimensional 2-stable projections, kd-trees and a chi-square stopping test.

Largest inner product is made least distance: with M the largest norm, a row x gets one more component sqrt(M^2 - |x|^2), a
query one of 0, and then |q' - x'|^2 = |q|^2 + M^2 - 2<q, x>. A projection on ``dims`` Gaussian directions is 2-stable: the
squared projected distance over the squared distance is a chi-square variable of ``dims`` degrees of freedom.

1. A kd-tree of bounded size is fitted on the projections of a bounded sample. It gives every row a cell; a cell of too many
   rows is dealt into blocks by hash, so that a cluster or copies of one vector never meet in one task.
2. A query searches one block of its own cell first. Its k-th best gives a radius: rows further away in the projection than
   the chi-square quantile allows are not looked at. The cells that the radius reaches are searched then.
3. In a block, a kd-tree of its rows hands out leaves by rising projected distance, in growing portions. Their rows are
   verified on the original vectors until the test holds: the next leaf's squared projected distance over the squared
   distance of the k-th best found is beyond the quantile. Each true neighbour has been seen with that probability or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.session import materialize

#: Directions of the projection (even), the probability of the stopping test, seed of the directions.
DIMS, CONFIDENCE, SEED = 12, 0.98, 7
#: Rows of the sample the cells are fitted on, most cells, rows of a block on average, queries of a task, rows of a leaf.
SAMPLE_ROWS, MOST_CELLS, BLOCK_ROWS, QUERY_ROWS, LEAF_ROWS = 1 << 14, 1 << 12, 1 << 12, 1 << 12, 64
#: Relative slack of bounds made of rounded numbers.
SLACK = 1e-9


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom stays below with probability ``p``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Projection:
    """Rows and queries on the same Gaussian directions, in double precision."""

    def __init__(self, size: int, norm2: float, dims: int, seed: int):
        self.size, self.norm2 = size, norm2
        self.directions = np.random.default_rng(seed).standard_normal((size + 1, dims))

    def matrix(self, vectors) -> np.ndarray:
        """Vectors as rows; shorter ones are filled up with zeros."""
        out = np.zeros((len(vectors), self.size))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return x @ self.directions[:-1] + more[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]


def split_tree(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Axis and value of every inner node of a complete kd-tree with ``cells`` (a power of two) leaves, in heap order."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    while len(level) < cells:
        below = []
        for p in level:
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            nodes.append((axis, value))
            left = p[:, axis] < value if len(p) else np.zeros(0, bool)
            below += [p[left], p[~left]]
        level = below
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    axis = np.array([a for a, _ in nodes], np.int64)
    value = np.array([v for _, v in nodes])
    at = np.zeros(len(points), np.int64)
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= value[at])
    return at - len(nodes)


class LeafTree:
    """A kd-tree of a block: its rows in the order of leaves of at most LEAF_ROWS, and the box of every leaf."""

    def __init__(self, points: np.ndarray):
        parts, leaves = [np.arange(len(points))], []
        while parts:
            p = parts.pop()
            if len(p) <= LEAF_ROWS:
                leaves.append(p)
                continue
            own = points[p]
            half = len(p) // 2  # halves by rank, so that equal points are split too
            order = np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], half)
            parts += [p[order[:half]], p[order[half:]]]
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = np.r_[0, self.ends[:-1]]
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def by_distance(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by rising squared distance of their box, and that distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap * gap).sum(1)
        order = np.argsort(far, kind="stable")
        return order, far[order]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order for every row, so that equal rows have equal scores."""
    return (x * q).sum(1)


class BlockIndex:
    """The rows of a block, ready for incremental search."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projection: Projection, quantile: float, k: int):
        order = np.lexsort((ids,))
        points = projection.rows(x)[order]
        self.tree = LeafTree(points)
        order = order[self.tree.order]
        self.ids, self.x, self.points = ids[order], x[order], points[self.tree.order]
        self.short = self.x.astype(np.float32)
        self.norm2, self.quantile, self.k = projection.norm2, quantile, k
        self.rough = 1e-5 * math.sqrt(max(self.norm2, 0.0))

    def search(self, query: int, q: np.ndarray, point: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of up to k rows, best first, none below ``bound`` (the k-th best known from elsewhere)."""
        q2, k = float(q @ q), self.k
        slack = self.rough * math.sqrt(q2)
        short = q.astype(np.float32)
        leaves, far = self.tree.by_distance(point)
        ids, scores, at, step = np.empty(0, np.int64), np.empty(0), 0, 1
        while at < len(leaves):
            # All rows within the radius may hold a better one with a probability that matters.
            radius = search_radius(q2, self.norm2, bound, self.quantile)
            if far[at] > radius:  # the stopping test
                break
            end = min(at + step, int(np.searchsorted(far, radius, "right")))
            if step == 1:
                rows = np.arange(self.tree.starts[leaves[0]], self.tree.ends[leaves[0]])
            else:
                rows = np.concatenate([np.arange(self.tree.starts[i], self.tree.ends[i]) for i in leaves[at:end]])
            if bound > -np.inf:
                d = self.points[rows] - point
                rows = rows[np.einsum("ij,ij->i", d, d) <= radius]
                rows = rows[self.short[rows] @ short >= bound - slack]
            rows = rows[self.ids[rows] != query]
            exact = inner(self.x[rows], q)
            ids, scores = best(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, exact]), k)
            if len(ids) == k:
                bound = max(bound, float(scores[-1]))
            at, step = end, 2 * step
        keep = scores >= bound if bound > -np.inf else slice(None)
        return ids[keep], scores[keep]


def search_radius(q2: float, norm2: float, bound: float, quantile: float) -> float:
    """The squared projected distance at which the chi-square test stops a search whose k-th best score is ``bound``."""
    return quantile * max(q2 + norm2 - 2 * bound, 0) * (1 + SLACK) + SLACK * (q2 + norm2)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if len(ids) > 1:
        _, first = np.unique(ids, return_index=True)
        if len(first) < len(ids):
            first.sort()
            ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, and a component other than 0."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def search_blocks(rows: DataFrame, visits: DataFrame, projection, quantile: float, k: int) -> DataFrame:
    """``query_id, vec_id, score``: what each visit of a query to a block (``cell, block``) finds.

    A block's visitors are dealt into tasks of QUERY_ROWS on average, and the block's rows go to each of these tasks.
    """
    many = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("tasks"))
    many = materialize(many, "tasks")
    none = F.lit(None)
    data = rows.join(many, ["cell", "block"]).select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"),
        none.cast("long").alias("query_id"), "vec_id", "vector", none.cast("double").alias("bound"),
    )
    asked = visits.join(many, ["cell", "block"]).select(
        "cell", "block", F.pmod(F.xxhash64("query_id", "vector"), F.col("tasks")).cast("int").alias("task"),
        "query_id", none.cast("long").alias("vec_id"), "vector", "bound",
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        p = projection.value
        is_row = pdf["query_id"].isna().to_numpy()
        own, queries = pdf[is_row], pdf[~is_row]
        found = []
        if len(own) and len(queries):
            index = BlockIndex(own["vec_id"].to_numpy(np.int64), p.matrix(own["vector"].tolist()), p, quantile, k)
            q = p.matrix(queries["vector"].tolist())
            points = p.queries(q)
            bounds = queries["bound"].fillna(-np.inf).to_numpy()
            for i, query in enumerate(queries["query_id"].to_numpy(np.int64)):
                ids, scores = index.search(int(query), q[i], points[i], float(bounds[i]))
                found.append((np.full(len(ids), query), ids, scores))
        columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns)))

    sent = data.unionByName(asked).groupBy("cell", "block", "task")
    return sent.applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` (``vec_id, vector``) with the largest inner product
    with each of ``queries`` (``query_id, vector``) other than the row of the query's own id, ties to the smaller id.

    Fewer rows than ``k`` are all returned, if fewer there are. Scores are the exact inner products in double precision;
    which rows are found is approximate, by ``confidence``. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows without an id. A shorter vector counts as filled up with zeros. Rows that repeat an id count
    once, with the best of their scores. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kinds = {df.schema["vector"].dataType.simpleString() for df in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    vector = F.col("vector").cast(kind).alias("vector")
    rows = vectors.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", vector)
    asked = queries.filter(usable(F.col("vector")) & F.col("query_id").isNotNull()).select("query_id", vector)
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"), F.max(F.size("vector")).alias("size")).first()
    longest = asked.agg(F.max(F.size("vector"))).first()[0]
    if not facts.n or not longest:
        return spark.createDataFrame([], schema)
    projection = spark.sparkContext.broadcast(Projection(max(facts["size"], longest), facts.norm2, dims, seed))
    quantile = chi_square_quantile(confidence, dims)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = projection.value
        for pdf in batches:
            yield pd.DataFrame({"p": list(p.rows(p.matrix(pdf["vector"].tolist())))})

    sieve = rows.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(facts.n)) < 2 * SAMPLE_ROWS)
    sample = sieve.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE_ROWS).select("vector")
    points = np.array([r.p for r in sample.mapInPandas(projected, "p array<double>").collect()])
    cells = 1 << max(0, min(MOST_CELLS, math.ceil(facts.n / BLOCK_ROWS)) - 1).bit_length()
    tree = spark.sparkContext.broadcast(split_tree(points, cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = projection.value
        for pdf in batches:
            at = p.rows(p.matrix(pdf["vector"].tolist()))
            yield pdf.assign(cell=cell_of(at, tree.value).astype(np.int32), p=list(at))

    placed = materialize(rows.mapInPandas(place, f"vec_id long, vector {kind}, cell int, p array<double>"), "cells")
    edges = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()  # at most MOST_CELLS rows
    blocks = [(b.cell, math.ceil(b.n / BLOCK_ROWS)) for b in boxes]
    sizes = spark.createDataFrame(blocks, "cell int, blocks int")
    names = np.array([b.cell for b in boxes], np.int32)
    low = np.array([[b[f"low{i}"] for i in range(dims)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(dims)] for b in boxes])
    bounds = spark.sparkContext.broadcast((names, low, high))
    data = placed.drop("p").join(F.broadcast(sizes), "cell")  # at most MOST_CELLS rows
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that a query's radius reaches: all without a bound, the nearest one only where ``home`` is to be found."""
        p, (cell, low, high) = projection.value, bounds.value
        for pdf in batches:
            q = p.matrix(pdf["vector"].tolist())
            out = []
            for v, at, known, home in zip(q, p.queries(q), pdf["bound"], pdf["home_cell"]):
                gap = np.maximum(np.maximum(low - at, at - high), 0)
                far = (gap * gap).sum(1)
                if pd.isna(home):
                    out.append([int(cell[np.argmin(far)])])
                elif pd.isna(known):
                    out.append(cell.tolist())
                else:
                    out.append(cell[far <= search_radius(float(v @ v), p.norm2, float(known), quantile)].tolist())
            yield pdf.assign(cells=out)

    schema_reached = f"query_id long, vector {kind}, bound double, home_cell int, home_block int, cells array<int>"

    def visits(asked_: DataFrame) -> DataFrame:
        reached = asked_.select("query_id", "vector", "bound", "home_cell", "home_block").mapInPandas(reach, schema_reached)
        return reached.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(sizes), "cell")

    none = F.lit(None)
    first = asked.withColumns({"bound": none.cast("double"), "home_cell": none.cast("int"), "home_block": none.cast("int")})
    own = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    first = materialize(visits(first).withColumn("block", own).select("query_id", "vector", "bound", "cell", "block"), "home")
    hits = materialize(search_blocks(data, first, projection, quantile, k), "hits")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    kth = top(hits).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    again = first.drop("bound").withColumnsRenamed({"cell": "home_cell", "block": "home_block"}).join(kth, "query_id", "left")
    again = visits(again).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = materialize(again.filter("cell != home_cell or block != home_block").select(first.columns), "away")
    more = search_blocks(data, again, projection, quantile, k)
    return top(hits.unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
