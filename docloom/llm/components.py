"""Connected components of an edge table, by Spark joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable type to (node, label): label is the least node of node's component.

    Every round sends each node to its least neighbour, or stays, and contracts the edges to the nodes
    that are left; edges within one node go. A star, whatever its size, takes one round. Rounds
    are written tables, of which the last one's labels stay, and the driver sees only whether edges are left.
    """
    edges = written(edges.select("u", "v").distinct())
    labels = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")))
    while edges.filter("u != v").limit(1).count():
        both = edges.filter("u != v").union(edges.filter("u != v").select("v", "u"))
        least = written(both.groupBy(F.col("u").alias("was")).agg(F.least(F.col("was"), F.min("v")).alias("now")))
        to = lambda c: least.select(F.col("was").alias(c), F.col("now").alias(f"{c}_now"))
        fewer = written(
            edges.filter("u != v").join(to("u"), "u").join(to("v"), "v")
            .select(F.col("u_now").alias("u"), F.col("v_now").alias("v")).filter("u != v").distinct()
        )
        now = written(
            labels.join(to("label"), "label", "left").select("node", F.coalesce("label_now", "label").alias("label"))
        )
        dropped(edges, labels, least)
        edges, labels = fewer, now
    dropped(edges)
    return labels
