"""Connected components by contraction, in rounds of joins; nothing but row counts reaches the driver.

In each round every node points to the neighbour (or itself) of smallest random rank, and the links are redrawn
between the nodes pointed to. Nodes that nobody points to leave, about half or more each round; ranks are drawn anew
by round, so no numbering of the nodes makes long chains slow. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``(a, b)``; nodes of one component share the root, one of them."""
    links = stored(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    roots: DataFrame | None = None
    turn = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c.alias("node"))  # noqa: E731, B023
        aims = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        aims = aims.select(F.col("a").alias("node"), F.least(F.col("best"), rank(F.col("a")))["node"].alias("aim"))
        aims = stored(aims, f"aims-{turn}")
        ends = links.join(aims.withColumnsRenamed({"node": "a", "aim": "to_a"}), "a").join(aims.withColumnsRenamed({"node": "b", "aim": "to_b"}), "b")
        links = ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links = stored(links.filter(F.col("a") != F.col("b")).distinct(), f"links-{turn}")
        if roots is None:
            roots = aims.withColumnRenamed("aim", "root")
        else:
            step = roots.join(aims, roots["root"] == aims["node"], "left")
            roots = stored(step.select(roots["node"], F.coalesce(aims["aim"], roots["root"]).alias("root")), f"roots-{turn}")
        turn += 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
