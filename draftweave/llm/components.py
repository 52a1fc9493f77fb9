"""Connected components of a large graph, by alternating large and small stars.

Each round touches every edge a fixed number of times and leaves a graph with
the same components; the number of rounds grows with the logarithm of the
graph's size. A node's neighbours are never gathered: only their minimum is,
and edges meet it in a join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.storage import dropped, stored


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """One pass over edges ``(a, b)`` with ``a > b``; also the table of minima it rests on."""
    if small:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")))
        joined = edges.join(least, "a")
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        new = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.filter("a > b").distinct(), least


def _size(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that ``edges(a, b)`` names.

    The component is the smallest node of it. Edges with a null end, loops and
    repeated edges add nothing; a node with loops alone has no row. An empty
    table gives an empty one.
    """
    edges = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _size(edges)
    while before[0]:
        large, first = _star(edges, small=False)
        middle = stored(large)
        small, second = _star(middle, small=True)
        new = stored(small)
        after = _size(new)
        for old in (first, second, middle, edges):
            dropped(old)
        edges = new
        if after == before:
            break
        before = after
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
