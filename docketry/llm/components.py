"""Connected components by large-star and small-star steps.

Edges are a table (u, v); each round writes the next table to the shared folder, so a
lost executor costs one round at most. Minima are aggregated before they are shuffled and
joined back; no list of a node's neighbours is ever built, so a node may have any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs, any direction, repeats and loops allowed).

    Returns one row (node, root) for every node but the roots; root is the least node of
    the component. An empty table of edges gives an empty table.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or sign[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(sign)
        now = materialize(_small(_large(now)), "edges")
