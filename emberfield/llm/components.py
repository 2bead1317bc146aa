"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

# Edges that a task contracts together.
CONTRACTED = 1 << 18


def _stars(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each node of some edges (id, k, id, k) with the smallest node that they lead to."""
    ends = np.concatenate(held)
    nodes, to = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    a, b = to.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        np.minimum.at(fresh, label[a], least)
        np.minimum.at(fresh, label[b], least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    at = np.flatnonzero(label != np.arange(len(nodes)))
    columns = [nodes[label[at], 0], nodes[label[at], 1], nodes[at, 0], nodes[at, 1]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a_id", "a_k", "b_id", "b_k"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a_id, a_k, b_id, b_k) as stars around the smallest nodes, CONTRACTED at a time: no more edges, shorter ways."""
    held, waiting = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("a_id", "a_k", "b_id", "b_k")], axis=1))
            waiting += batch.num_rows
        if waiting >= CONTRACTED:
            yield from _stars(held)
            held, waiting = [], 0
    if held:
        yield from _stars(held)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root), nodes as structs (id, k), for each node of ``edges`` (a_id, a_k, b_id, b_k); root is the smallest node reachable.

    Tasks contract what they hold to stars. Then each round sends every node's smallest neighbour to its neighbours, then to that
    neighbour (large star and small star), until a round changes nothing. Minima are summed before they are shuffled, the
    number of edges never grows, and the joins that bring a minimum back to a node of many edges are ones that adaptive execution
    splits. Each round is cut by a checkpoint.
    """
    node = lambda x: F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_k").alias("k")).alias(x)
    edges = edges.mapInArrow(contract, "a_id long, a_k long, b_id long, b_k long").select(node("a"), node("b"))
    edges = durable(edges.distinct())
    state = None
    while True:
        # The same edges as before are stars: a fixed point of both steps.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: greater neighbours go to the least of the neighbourhood.
        edges = both.join(least, "a").filter("b > a AND b != m").select(F.col("m").alias("a"), "b")
        # Small star: smaller neighbours, and the node, go to the smallest.
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        low = edges.join(least, "b")
        edges = durable(
            low.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
        )
