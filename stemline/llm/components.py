"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links(a, b); component: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, hooks the
    node's present root to it, and then follows the label of its label, so that chains
    shorten by more than half. Only minima are gathered (pre-aggregated before the
    shuffle) and each join has one unique side, so that a hub is no hot group:
    adaptive execution splits it. Links with a null end and loops are ignored;
    no links give no rows.
    """
    both = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    edges = checkpoint(links.where(F.col(a) != F.col(b)).select(both.alias("e")).select("e.*").distinct())
    label = checkpoint(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = (
            edges.join(label, F.col("dst") == F.col("node"))
            .groupBy("src").agg(F.min("component").alias("near"))
        )
        own = label.join(near, F.col("node") == F.col("src")).select("node", "component", F.least("component", "near").alias("best"))
        # a root takes the best label any of its members has seen
        hooked = own.select("node", "best").unionByName(own.select(F.col("component").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("best"))
        up = hooked.select(F.col("node").alias("up"), F.col("best").alias("up_best"))
        nxt = hooked.join(up, F.col("best") == F.col("up")).select("node", F.least("best", "up_best").alias("component"))
        old = label.select(F.col("node").alias("was"), F.col("component").alias("before"))
        nxt = checkpoint(nxt.join(old, F.col("node") == F.col("was")).select("node", "component", (F.col("component") != F.col("before")).alias("moved")))
        label = nxt.select("node", "component")
        if nxt.where("moved").isEmpty():
            return label
