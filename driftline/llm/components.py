"""Connected components by alternating large-star and small-star steps over forests made in tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

# Edges that a task turns into a forest, about, and nodes that it holds at once.
EDGES, NODES = 1 << 16, 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges are (u, v) of one integer type, component is its least node.

    ``edges`` is read twice. Each task first turns its edges into stars, so steps only join what several tasks
    hold. A step is grouped sums and joins, written to the shared folder. A star's hub is a join key
    with many rows on one side only, which adaptive execution splits. Self-loops count as no edge.
    Edges only ever get lesser ends, so the steps end, and what no step changes are stars about their least nodes.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.col("u").cast("long"), F.col("v").cast("long"))
    n = pairs.count()
    e = stored(forest(pairs, n))
    while not starred(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), rows=n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        e = stored(forest(small.unionByName(low.select(F.col("a").alias("u"), F.col("m").alias("v"))), n))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(edges: DataFrame, n: int) -> DataFrame:
    """(u, v) for u > v: stars about the least nodes of what the edges of a task connect, no more than they are. ``n``: how many edges there are, about."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def stars():
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > NODES:
                yield stars()
                up.clear()
        yield stars()

    return edges.coalesce(max(1, -(-n // EDGES))).mapInArrow(run, "u long, v long")


def starred(e: DataFrame) -> bool:
    """Whether every u has one v only, which is no u itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("hub")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("hub")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).where("up > 1 OR up = 1 AND hub = 1").limit(1).count()
