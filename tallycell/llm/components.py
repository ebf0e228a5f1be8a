"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import attach, written


def _star(links: DataFrame, all_sides: bool) -> DataFrame:
    """Point nodes at the smallest neighbour: larger neighbours of every node (all_sides), or the node and its smaller ones."""
    if all_sides:
        links = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    low = links.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
    met = attach(links, low, ["node"], ["root"], "inner")
    if all_sides:
        out = met.filter("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
    else:
        out = met.select(F.explode(F.array("node", "root")).alias("node"), F.col("low").alias("root"))
    return out.filter("node != root").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (node, root: any linked pair) that isn't the smallest of its component."""
    links = links.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).filter("node != root").distinct()
    links = written(links, "links")
    while True:
        nodes = links.groupBy("node").count()
        tied = nodes.filter("count > 1").select("node").union(links.select(F.col("root").alias("node")).distinct().join(nodes.select("node"), "node"))
        if tied.isEmpty():
            return links
        links = written(_star(_star(links, True), False), "links")
