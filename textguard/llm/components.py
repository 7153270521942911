"""Connected components by label propagation with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of ``edges`` (a, b): comp is the least node of the component.

    A round gives each node the least label among its neighbours, then follows the label's own
    label, so long chains shorten by half each time. A node with many neighbours is combined
    before its shuffle (a partial min)."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("comp")), "cc-label")
    while True:
        near = (both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        hooked = staged(label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "cc-hook")
        over = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        # the label's label: labels are few against nodes, so the hot side is the left one, which AQE can split
        jumped = staged(hooked.join(over, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "cc-jump")
        label = jumped.select("node", "comp")
        if jumped.where(F.col("old") != F.col("comp")).isEmpty():
            return label
