"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch, written
from .groups import hot_keys, join_groups


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of links (x, y) the least node that it can reach.

    Each round maps every node to its least neighbour (or itself), twice, and contracts the links by that map; the least
    node of a component always stays, so it is what remains. Rounds are logarithmic in the longest path in practice, each
    round's tables are written, and nodes with very many links are met by broadcast.
    """
    spark = links.sparkSession
    with scratch(spark) as kept:
        links = written(links.where("x <> y").distinct(), "links")
        labels = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct()
        labels = written(labels.withColumn("label", F.col("node")), "labels")
        kept += [links, labels]
    while links.limit(1).count():
        with scratch(spark) as kept:
            links, labels = _contracted(links, labels)
            kept += [links, labels]
    return labels


def joined_by(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (node, label) of components once the links more (x, y) are added. Only components, not nodes, are linked."""
    at = lambda c: F.coalesce("label", F.col(c)).alias(c)
    ends = more.join(labels, more["x"] == labels["node"], "left").select(at("x"), "y")
    ends = ends.join(labels, ends["y"] == labels["node"], "left").select("x", at("y")).where("x <> y")
    moved = components(ends)
    sizes = labels.groupBy("label").agg(F.count("*").alias("m"))
    step = written(moved.select(F.col("node").alias("label"), F.col("label").alias("to")).join(sizes, "label", "left"), "moved")
    old = join_groups(labels, step, ["label"], "m").select("node", F.coalesce("to", "label").alias("label"))
    new = step.where("m is null").select(F.col("label").alias("node"), F.col("to").alias("label"))  # nodes that had no link
    return old.unionByName(new)


def _contracted(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of `components`: (links between what is left, labels so far)."""
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    near = both.groupBy("x").agg(F.min("y").alias("to"), F.count("*").alias("n"))
    near = near.withColumn("to", F.least("x", "to"))
    again = near.select(F.col("x").alias("to"), F.col("to").alias("far"))
    hop = written(near.join(again, "to").select("x", F.col("far").alias("to"), "n"), "hop")
    hot = hot_keys(hop, ["x"], "n")
    moved = join_groups(links, hop, ["x"], "n", hot=hot).select("y", F.col("to").alias("p"))
    moved = join_groups(moved, hop.withColumnRenamed("x", "y"), ["y"], "n", hot=hot).select(F.col("p").alias("x"), F.col("to").alias("y"))
    counted = labels.groupBy("label").agg(F.count("*").alias("m"))
    step = hop.where("x <> to").select(F.col("x").alias("label"), "to").join(counted, "label")
    labels = written(join_groups(labels, step, ["label"], "m").select("node", F.coalesce("to", "label").alias("label")), "labels")
    links = written(moved.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    return links, labels
