"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stored


def components(edges: DataFrame, folder: str, *, a: str = "a", b: str = "b", most: int = 100) -> DataFrame:
    """(node, root) for each node of an edge that is not the least of its component, which is the root.

    Each round joins edges with one minimum for each node; a node with very
    many edges is split by adaptive execution, as its other side is one row.
    Rounds are written to the shared folder; their number grows as the
    logarithm of the component sizes.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    before = None
    for i in range(most):
        now = stored(now, f"{folder}/edges-{i}")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # now every edge goes from a node to a lesser one
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    raise RuntimeError(f"no end after {most} rounds")
