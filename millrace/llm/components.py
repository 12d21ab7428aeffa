"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b); a component is named by its least id.

    Each round takes the least label of the neighbours and then the label of the label, so that the number of
    rounds grows with the logarithm of the longest path; every round is checkpointed. Rows with a null end are
    ignored. No links give no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")).checkpoint()
    while True:
        reached = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("low"))
        near = labels.join(reached, labels["id"] == reached["a"]).select("id", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        jump = near.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = near.join(jump, near["component"] == jump["to"]).select("id", F.least("component", "far").alias("component"), "old").checkpoint()
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels
