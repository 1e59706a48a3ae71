"""Connected components over a table of links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evstat.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) to ``node, comp``: the smallest node of each component.

    Every round a node takes the smallest label among its neighbours, then
    the label of its label (path halving), so long chains close in a
    logarithmic number of rounds.  Labels live in written tables; the driver
    sees one count a round.  A node with many links is pre-aggregated.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                       "cc-links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")),
                        "cc-label")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c")))
        low = (label.join(near, "node")
               .select("node", "comp", F.least("comp", "c").alias("new")))
        up = label.select(F.col("node").alias("new"), F.col("comp").alias("up"))
        nxt = materialise(low.join(up, "new").select("node", F.least("new", "up").alias("comp"),
                                                     (F.least("new", "up") != F.col("comp")).alias("moved")),
                          "cc-label")
        label = nxt.select("node", "comp")
        if nxt.where("moved").limit(1).count() == 0:
            return label
