"""Connected components over an edge table, with DataFrame operations only.

Large-star / small-star rounds: every node hands its larger (then its smaller) neighbours
to the smallest node it knows, until all nodes hang on the smallest of their component.
The number of rounds grows with the logarithm of the longest path. Each half round is an
aggregate with map-side combine and one equi join of two written tables, so AQE can split
the join of a node that has very many neighbours. Nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (a, b) with a > b; gives edges of the same form."""
    if large:
        sides = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                  F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        pairs = edges.select(sides.alias("e")).select("e.u", "e.v")
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = saved(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = pairs.join(least, "u")
    if large:
        joined = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        ends = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                 F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
        joined = joined.select(ends.alias("e")).select("e.a", "e.b")
    out = saved(joined.filter("a <> b").distinct(), "edges")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is its smallest node.

    Edges may be given in any direction, repeated, and from a node to itself (such a node
    has no row unless another edge names it). No edges give an empty table.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = saved(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    mark = None
    while True:
        count, digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or (count, digest) == mark:
            break
        mark = (count, digest)
        wide = _star(now, large=True)
        after = _star(wide, large=False)
        discard(wide)
        discard(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
