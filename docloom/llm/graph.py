"""Connected components by alternating star contraction, with every round written
to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its
    smallest node. Null ends, loops and repeated edges are ignored.

    Each round joins edges with one smallest neighbour per node, so a node of very
    many edges costs one row per edge, never pairs of them. Rounds grow with the
    logarithm of the longest path."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    pairs = staged(pairs, "edges")
    last = None
    while True:
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (written, so that the join reads both sides from a shuffle and a node of very many edges can be split)
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("shuffle_merge"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        now = staged(tied.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        pairs = now
        if state == last:
            break
        last = state
    leaves = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.unionByName(roots)
