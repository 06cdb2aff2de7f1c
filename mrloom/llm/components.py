"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round ties every node to the least node that it or its neighbours see; the number of rounds
grows with the logarithm of the longest chain. Rounds end in a written table, so a lost executor costs no earlier round.
The least neighbours are written too: the joins then stand between two plain exchanges, and adaptive execution can split
the node that most edges meet in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component; a, b: the ends of the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for ends in (a, b):
            np.minimum.at(root, root[ends], low)
            np.minimum.at(root, ends, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if (before == root).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component. edges: u and v, long."""
    known, before = stored(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, known = known, stored(small, "stars")
        forget(last, least)
        now = known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
