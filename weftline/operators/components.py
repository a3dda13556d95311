"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the smallest node id reachable from node.

    Alternates the large-star and small-star contraction, which needs O(log n) rounds even on long
    chains and emits one row per edge end, never the pairs of a neighbourhood. Both steps are a
    grouped minimum (combined before the shuffle, so a hub node does not gather its neighbours) and
    an equi-join. Null ends and self loops are ignored; an empty edge table gives an empty result. If
    ``max_rounds`` do not settle the components, an error is raised: no unfinished result is returned.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = (
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        nxt = cut(small)
        n_new, n_old = nxt.count(), e.count()
        same = n_new == n_old and nxt.exceptAll(e).isEmpty()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = star.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("u").alias("node"), "component").union(roots)
