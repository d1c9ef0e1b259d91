"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.runtime import cut_lineage


def connected(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """``id, root``: each id of the pairs with the smallest id it is connected to.

    Each round hooks the larger neighbours of an id to the smallest id it sees, then the smaller ones, so
    the number of rounds grows with the logarithm of a component's size. Minima are taken before rows are
    shuffled, and each round is written to the shared checkpoint folder. Nulls and loops are left out.
    """
    edges = cut_lineage(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(down, "v").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y"))
        fresh = cut_lineage(star.filter("x < y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        moved = fresh.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(fresh, ["u", "v"], "left_anti").limit(1).count()
        edges = fresh
        if not moved:
            roots = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("id"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
