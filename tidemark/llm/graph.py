"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in links (a, b): nodes have one label if and only if links connect them.

    Each round names every node after the least of itself and its neighbours, in an order of random
    digests, and joins the nodes of one name. Chains so halve in about as many rounds as their length
    has digits, stars end in two. Every round is written to the shared folder; a node with many links
    is one row for each task before anything is shuffled.
    """
    edges = stored(links.select(F.col("a"), F.col("b")).where("a <> b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("rank"), F.col("b").alias("node")))
        own = F.struct(F.xxhash64("a").alias("rank"), F.col("a").alias("node"))
        names = stored(
            both.groupBy("a").agg(least.alias("least")).select("a", F.least("least", own).getField("node").alias("name")),
            "names",
        )
        labels = stored(
            labels.join(names, F.col("label") == F.col("a"), "left").select(
                "node", F.coalesce("name", "label").alias("label")
            ),
            "labels",
        )
        first = names.select(F.col("a"), F.col("name").alias("x"))
        second = names.select(F.col("a").alias("b"), F.col("name").alias("y"))
        edges = stored(
            edges.join(first, "a")
            .join(second, "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
        if edges.isEmpty():
            return labels
