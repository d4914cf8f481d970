"""Connected components of an edge table, by alternating large and small stars, without collecting anything."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    # each neighbour below u, and u itself, now points at the lowest of them
    small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _forest(most: int):
    """Rows (u, v) -> the same components within each ``most`` rows, as edges (u > v) to their lowest nodes."""

    def run(batches):
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def pointing():
            ends = [(x, r) for x in parent if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind) for k in (0, 1)], names=["u", "v"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield pointing()
                parent.clear()
        if parent:
            yield pointing()

    return run


def drawn_together(edges: DataFrame, keep: Scratch, most: int = 1_000_000) -> DataFrame:
    """Edges (u > v) with the components of ``edges`` (u, v): joined within each task, then drawn towards their lowest nodes by one step."""
    kind = edges.schema["u"].dataType.simpleString()
    return keep.written(_stars(edges.mapInArrow(_forest(most), f"u {kind}, v {kind}")))


def _unfinished(edges: DataFrame) -> bool:
    """Whether an upper end points at two nodes or is itself pointed at."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").limit(1).count())


def connected_components(edges: DataFrame, keep: Scratch, steps: int | None = None) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b): the label is the lowest node of the component.

    Rounds grow with the logarithm of the largest component at most. Each is written to the shared folder, so
    a lost executor costs a re-read. Nodes may be of any type that has an order; edges to oneself are ignored.
    After fewer ``steps``, nodes of one label are in one component, but one component may have several labels.
    """
    e = keep.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")))
    while True:
        e = drawn_together(e, keep)
        steps = None if steps is None else steps - 1
        if steps == 0 or not _unfinished(e):
            break
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    lowest = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return nodes.unionByName(lowest if steps is None else lowest.join(nodes, "node", "left_anti"))
