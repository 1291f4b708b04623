"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of the nodes in ``links`` (``a, b``).

    Every node takes the smallest label of its neighbours, then the label of its
    label, until nothing changes. Each round is written, so that neither plans nor
    lost executors pile up; a hot node's links are aggregated before they move.
    """
    both = materialise(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("component").alias("low"))
        )
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("before"), F.least("component", "low").alias("now")
        )
        ends = labels.select(F.col("node").alias("now"), F.col("component").alias("end"))
        jumped = materialise(
            hooked.join(ends, "now", "left").select(
                "node", "before", F.least("now", F.coalesce("end", "now")).alias("component")
            ),
            "labels",
        )
        changed = jumped.where("component <> before").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
