"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every node of the links (``a``, ``b``): equal labels are one component.

    Each round every node joins the neighbour (or itself) of the smallest hash in that
    round, and links are drawn anew between what is left.  Hashes differ by round, so
    chains shrink by a constant factor too.  All steps are aggregates with map-side
    combine and plain joins, so a node with very many links is split like any hot key.
    Each round's tables are written, which cuts the lineage.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))
        least = ends.groupBy("a").agg(F.min(rank("b")).alias("other"))
        moves = written(least.select(F.col("a").alias("old"), F.least("other", rank("a"))["to"].alias("new")), "moves")
        labels = written(labels.join(moves, F.col("label") == F.col("old"), "left").select(
            "node", F.coalesce("new", "label").alias("label")), "labels")
        one = edges.join(moves, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        two = one.join(moves, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = written(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
