"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapewright.llm.common import dropped, kept_alone


def components(links: DataFrame) -> DataFrame:
    """a, b -> node, root: the least node that links reach, for every node with a link.

    Each round takes the least label among the neighbours (summed before the shuffle, so a node with very many links is no
    large group) and then follows labels to the labels of their nodes, which halves long chains. Every round is written.
    """
    both = kept_alone(links.select("a", "b").where("a <> b").union(links.select(F.col("b"), F.col("a")).where("a <> b")).distinct(), "links")
    labels = kept_alone(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), F.lit(None).cast("bigint").alias("own"), "root")
        low = labels.select("node", F.col("root").alias("own"), "root").union(near).groupBy("node").agg(F.max("own").alias("root"), F.min("root").alias("low"))
        up = labels.select(F.col("node").alias("of"), F.col("root").alias("up"))
        seen = Observation()
        new = low.join(up, F.col("low") == F.col("of"), "left").select("node", "root", F.least("low", F.coalesce("up", "low")).alias("new"))
        new = kept_alone(new.observe(seen, F.count_if(F.col("new") != F.col("root")).alias("moved")), "labels")
        dropped(labels)
        labels = new.select("node", F.col("new").alias("root"))
        if not seen.get["moved"]:
            dropped(both)
            return labels
