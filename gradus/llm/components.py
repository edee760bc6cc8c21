"""Connected components by alternating large-star and small-star steps, each a join and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's neighbours on the smallest of them and itself: the larger neighbours, or the smaller ones and itself.

    ``edges`` (u, v) has each edge once, u > v.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # A node's larger neighbours: the edges in which it is the smaller end.
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        hung = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = smaller.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the component's smallest node. No links, no rows.

    Rounds go on until a round changes nothing; each at least halves a long path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
        if not mark.n:
            break
        after = written(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
