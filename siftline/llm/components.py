"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every node with an edge; the root is the component's least node.

    Large-star and small-star rounds (Kiveris et al., 2014) alternate until the
    edges stay the same. Each round's minima are aggregated before the join and
    written out, so a hub's rows can be split by adaptive execution. Self-loops
    and repeated edges are allowed, null ends are dropped, and no edges give an
    empty table.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = materialize(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state["n"] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(large.where("u <> v").distinct(), "large")
        low = materialize(now.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = now.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
    else:
        raise RuntimeError("the components did not settle")
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components")
