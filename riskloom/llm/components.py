"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import drop_table
from .shared import materialise_few as materialise

#: Edges that a task joins at once, before a round of stars; memory of a task is bounded by it at every size of the table.
BLOCK = 1 << 16


def _stars(batches):
    """The edges of a part of the table as stars, block by block: each node with the least node of all that its block links it with."""
    for block in _blocks(batches):
        ends = pa.concat_arrays([*block.column("u").chunks, *block.column("v").chunks]).dictionary_encode()
        nodes = ends.dictionary.take(order := pc.array_sort_indices(ends.dictionary))
        rank = np.empty(len(nodes), np.int64)
        rank[order.to_numpy()] = np.arange(len(nodes))
        u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[u] != root[v]).any():
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        away = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_pydict({"a": nodes.take(pa.array(away)), "b": nodes.take(pa.array(root[away]))})


def _blocks(batches):
    held, rows = [], 0
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            held.append(part := batch.slice(at, BLOCK))
            rows += len(part)
            if rows >= BLOCK:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _joined(edges: DataFrame, count: int) -> DataFrame:
    """Edges with the same components and at most as many rows: parts of at most about BLOCK edges become stars on their own."""
    kind = edges.schema["u"].dataType.simpleString()
    stars = edges.coalesce(max(1, -(-count // BLOCK))).mapInArrow(_stars, f"a {kind}, b {kind}")
    return materialise(stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Of each u the least of u and its neighbours; written, so that the join with hot nodes can be split."""
    return materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the least node that it reaches.

    Nodes are of any orderable type. Links with a null end and self links are left out, repeated links count once,
    no links give an empty table. Each round replaces edges by edges to the least neighbour, first to the larger
    neighbours of each node, then to the smaller ones; the edge table never grows, a hub's edges stay separate rows,
    and each round's table is written to the shared folder. Before each round blocks of edges become stars on their own,
    as a combiner, so that chains inside a block take no rounds. Ends when a round changes nothing.
    """
    ship(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        joined = _joined(edges, before[0])
        drop_table(edges)
        edges, before = joined, _state(joined)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both)
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least_small = _least_neighbour(large)
        small = large.join(least_small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least_small.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        for t in (edges, least, large, least_small):
            drop_table(t)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
