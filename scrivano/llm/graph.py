"""Connected components over edges of any number, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.store import drop, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v; each keeps the components as they are.

    The least neighbours are written before they are joined: a sum and a join in one stage would keep all edges of a hub in
    one task, where a join alone can split them. The steps are written, so that their tables can go.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
    drop(least)
    least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
    small = materialise(small, "edges")
    drop(large, least)
    return small


def components(edges: DataFrame) -> DataFrame:
    """(u, v), any order of ends, to (node, root): root is the least node of the component. Unlinked nodes are not in it.

    Each round is written to the shared folder; the rounds end when a round changes no edge.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, old = mark, edges
        edges = _stars(edges)
        drop(old)
