"""Connected components over an edge table, without gathering links anywhere.

Each partition first contracts its own edges to stars (bounded slices, numpy), then
large-star and small-star rounds run as joins and aggregations until nothing changes. Every
round's edges are cut through the shared folder. A hot star centre is only ever the key of
an aggregation with map-side combine or of a sort-merge join, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop_cut, wide_batches

#: Edges contracted at once within a partition.
SLICE = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local components of the edges as stars: each node but the smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def best_forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges with the least costs: each tree takes its cheapest edge to
    another tree, in rounds, until none is left."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, cost))] = np.arange(len(a))
    edge = np.arange(len(a))
    label, taken = np.arange(len(nodes)), np.zeros(len(a), bool)
    by_rank = np.argsort(rank)
    while True:
        apart = label[x[edge]] != label[y[edge]]
        edge = edge[apart]
        if not len(edge):
            return a[taken], b[taken]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[edge]], rank[edge])
        np.minimum.at(best, label[y[edge]], rank[edge])
        chosen = by_rank[np.unique(best[best < len(a)])]
        taken[chosen] = True
        own, root = stars(label[x[chosen]], label[y[chosen]])
        move = np.arange(len(nodes))
        move[own] = root
        label = move[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= SLICE:
            held = [stars(*(np.concatenate(side) for side in zip(*held, strict=True)))]
            n = len(held[0][0])
            if n > SLICE // 2:  # what is left doesn't fold any more here
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["a", "b"])
                held, n = [], 0
    if held:
        a, b = stars(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that an edge ``(a, b)`` of longs touches; the component is
    its smallest node. Self loops and repeated edges are fine; nulls are ignored; no edges
    give no rows."""
    wide_batches(edges.sparkSession)
    links = edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long")
    now = cut(links.distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        then = cut(small.distinct())
        after = _mark(then)
        drop_cut(large)
        drop_cut(now)
        now, before, mark = then, mark, after
        if before == after:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
