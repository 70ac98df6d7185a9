"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from glyphmill.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every linked node; the label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so the rounds grow with the logarithm of the longest
    path.  Every round is written to the shared folder, which cuts the lineage.
    """
    ways = written(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct(),
        "ways",
    )
    labels = ways.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    labels = written(labels.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        heard = ways.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label")
        told = labels.withColumn("old", F.col("label")).unionByName(heard, allowMissingColumns=True)
        told = told.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        # Counted while it is written: where no neighbour knows a smaller label, all of a component have the same.
        heard_of = Observation()
        changes = F.count_if(F.col("label") != F.col("old")).alias("changes")
        told = written(told.observe(heard_of, changes).select("node", "label"), "told")
        if not heard_of.get["changes"]:
            return told
        above = told.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = told.join(above, F.col("label") == F.col("up"), "left")
        labels = written(jumped.select("node", F.least("label", "top").alias("label")), "labels")


def contracted(links: DataFrame, grouped: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``group, label`` of every group that ``links`` join to another; ``grouped`` holds ``key, group``.

    A group is named by its smallest node, so the label is the smallest node
    reachable, as ``components`` of all links would find it, but only links
    between groups take part.
    """
    ends = [grouped.select(F.col("key").alias(e), F.col("group").alias(f"group_{e}")) for e in (a, b)]
    between = links.select(a, b).join(ends[0], a).join(ends[1], b)
    found = components(between, f"group_{a}", f"group_{b}")
    return found.withColumnRenamed("node", "group")
