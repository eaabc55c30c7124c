"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest node beside ``u`` or ``u`` itself, by ``u`` (pre-aggregated before the shuffle)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``u``, ``v``): ``root`` is
    the smallest node of its component. Self loops and repeated edges are
    harmless, edges with a null are ignored, no edges give no rows.

    Alternating large-star and small-star rounds: each keeps at most the number of
    edges and the number of rounds is logarithmic in the size of the largest
    component. Every round is written to the shared folder.
    """
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, name)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_nearest(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _nearest(down)
        small = (down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stored(small, name)
        # order-free digest of the edge set: a star forest maps to itself
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
