"""Connected components of a link table, in rounds of smallest-label exchange with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tables import cut


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node reachable) for every node of ``links`` (``a``, ``b``).

    Each round a node takes the smallest label around it, then its label's own label, so
    chains halve. Labels are aggregated before they move; the links of a node with very many
    are one key of the join, which adaptive execution splits. Null ends link nothing.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut(ends.union(ends.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        shortcut = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(nearer.join(shortcut, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
