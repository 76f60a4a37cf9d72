"""Connected components of an edge list: local forests of chunks of edges, then large-star and small-star rounds as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import stored


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links i-j, the least node that each reaches."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while not np.array_equal(root, again := root[root]):
            root = again
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _contracted(edges: DataFrame, chunk: int, tasks: int) -> DataFrame:
    """Edges (u > v) with the same components: of every `chunk` edges of a task, each node and the least it reaches."""

    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(parts)
        nodes, at = np.unique(np.concatenate([part["u"], part["v"]]), return_inverse=True)
        root = forest(len(nodes), at[: len(part)], at[len(part) :])
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[linked], "v": nodes[root[linked]]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if n and n + len(batch) > chunk:
                yield stars(held)
                held, n = [], 0
            held.append(batch)
            n += len(batch)
        if n:
            yield stars(held)

    return edges.coalesce(tasks).mapInPandas(solve, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u > v): links each node's neighbours, the larger or the smaller ones, to its least neighbour.

    The least neighbour is found by a grouped minimum with partial sums, so a hub costs one row a task; the join back
    is an equi-join whose large partitions adaptive execution can split.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = 250_000) -> DataFrame:
    """(node, root) for every node of an edge list of longs; root is the least node of its component.

    Edges with a null end and loops are ignored; an empty list gives no rows. Tasks first contract their edges, at most
    `chunk` of them in memory, so that rounds over all edges have less to do. Each round is written out, and rounds go on
    until the edges no longer change, so the result is exact at any diameter.
    """
    edges = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = stored(edges)
    while n := edges.count():
        edges = stored(_contracted(edges, chunk, -(-n // chunk)).distinct() if n > chunk else _contracted(edges, chunk, 1))
        if n <= chunk:  # one task has seen all edges
            break
        before = _signature(edges)
        edges = stored(_star(_star(edges, True), False))
        if _signature(edges) == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
