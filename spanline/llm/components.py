"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm.common import Shared


def components(links: DataFrame, shared: Shared, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; the component is its least node.

    Each round moves a node to the least label among its neighbours, then to the label of
    that label, so chains shorten by halves.  Sums over a node's links are combined before
    they are shuffled; nothing is collected but the number of changes.
    """
    edges = shared.keep(
        links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges"
    )
    labels = shared.keep(
        edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")),
        f"{name}-0",
    )
    step = 0
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("_a"))
            .agg(F.min("component").alias("_near"))
        )
        moved = labels.join(near, F.col("node") == F.col("_a")).select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_to")
        )
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        nxt = moved.join(jump, F.col("_to") == F.col("_n"), "left").select(
            "node",
            F.least("_to", F.coalesce("_c", "_to")).alias("component"),
            "_old",
        )
        step += 1
        nxt = shared.keep(nxt, f"{name}-{step}")
        changed = nxt.filter("component <> _old").limit(1).count()
        shared.drop(f"{name}-{step - 1}")
        labels = nxt.select("node", "component")
        if not changed:
            shared.drop(f"{name}-edges")
            return labels
