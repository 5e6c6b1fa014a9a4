"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for (a, b) links of long ids: component is the smallest node reachable.

    Each round, a node and the node that it points to take the smallest label
    next to them, then labels are followed one step (pointer jumping), so the
    number of rounds grows with the logarithm of a component's breadth. Labels
    are written to the shared folder each round. A node without links has no row.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select("a", F.col("component").alias("other"))
        own = near.join(labels, near.a == labels.node).select("node", "component", "other")
        offers = own.select("node", F.col("other").alias("component")).union(own.select(F.col("component").alias("node"), F.col("other").alias("component"))).union(labels.select("node", "component"))
        hooked = offers.groupBy("node").agg(F.min("component").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = hooked.join(jump, "to").join(labels, "node").select("node", F.least("to", "further").alias("component"), F.col("component").alias("was"))
        moved = stored(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.where("component <> was").limit(1).count():
            return labels
