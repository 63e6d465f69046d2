"""Connected components of a link table, spread over the cluster.

Partitions first contract their own links to forests. What is then few enough for
the memory of one task is contracted there; more goes through large-star and
small-star rounds, which turn the forests into stars around each component's smallest
node. No task holds more than its share of links, and nothing but two numbers a round
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pa_schema

#: Links that a partition contracts at once; bounds a worker's memory.
HELD = 400_000
#: Links of all forests up to which one task contracts them, in place of rounds of shuffles.
FEW = 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not its tree's smallest, and that smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = [*range(len(nodes))]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    half = len(a)
    for i, j in zip(flat[:half].tolist(), flat[half:].tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.fromiter((root(i) for i in range(len(nodes))), np.int64, len(nodes))
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def contracted(links: DataFrame) -> DataFrame:
    out = pa_schema(links.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], schema=out)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= HELD:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that ``links`` (a long, b long) names.

    The component is its smallest node. Links may repeat, point either way or lead
    from a node to itself; links with a null end are ignored, and an empty table
    gives an empty result.
    """
    given = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = cut(contracted(given))
    if edges.count() <= FEW:
        edges = cut(contracted(edges.coalesce(1)))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
    edges = edges.distinct()
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
