"""Connected components by least labels and pointer jumping, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): component is the least node reached.

    Labels and links stay distributed; a round lands the labels in the shared
    folder and sends one count to the driver.  A hot node's links are combined
    before they move.  Empty links give an empty result.
    """
    both = land(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .distinct(), "cc-links")
    labels = land(both.groupBy("a").agg(F.min("b").alias("m"))
                  .select("a", F.least("a", "m").alias("c")), "cc-labels")
    while True:
        seen = (both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("m")), "b")
                .groupBy("a").agg(F.min("m").alias("m")))
        hooked = labels.join(seen, "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        onward = labels.select(F.col("a").alias("c"), F.col("c").alias("up"))
        step = land(hooked.join(onward, "c", "left")
                    .select("a", "old", F.least("c", F.coalesce("up", "c")).alias("c")), "cc-labels")
        labels = step.select("a", "c")
        if step.where("c <> old").limit(1).count() == 0:
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
