"""Connected components of a link table, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, spread_join, written


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of links (a, b); no node reaches the driver.

    Each round every node takes the least label next to it, and then its label's label, so paths halve; rounds end when no
    label changes. A node with a great many links is no hot key, as both joins are spread. Loops, repeated links and both directions are fine; no links give no rows.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        beside = spread_join(both, labels.withColumnsRenamed({"node": "b", "label": "next"}), ["b"], "a").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        hooked = labels.join(beside, "node").select("node", F.col("label").alias("was"), F.least("label", "next").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        new = written(spread_join(hooked, jump, ["label"], "node", "left").select("node", F.least("label", F.coalesce("farther", "label")).alias("label"), "was"), "labels")
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        drop_written(labels)
        labels = new
        if not changed:
            drop_written(both)
            return labels.select("node", "label")
