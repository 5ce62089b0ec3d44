"""Connected components by spreading the least label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortile.llm.common import stored


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(v, label) for every end of ``edges`` (a, b): the least id that its links reach.

    Ids are longs; an edge may come twice or either way round. ``labels`` (v, label) from an earlier
    call starts from known components; its own ids stay in the result. Every round is written to the
    shared folder, joins on equal ids only and pre-aggregates per id, so a node with very many links
    is a skewed join, never one task's list.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    both = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    nodes = both.select(F.col("a").alias("v")).distinct()
    if labels is None:
        now = stored(nodes.select("v", F.col("v").alias("label")), "labels")
    else:
        own = nodes.join(labels, "v", "full_outer").select("v", F.coalesce("label", "v").alias("label"))
        now = stored(own, "labels")
    while True:
        # the least label among a node's neighbours, handed to the node and to the node its label names
        seen = both.join(now.withColumnsRenamed({"v": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = now.join(seen.withColumnRenamed("a", "v"), "v").filter("near < label")
        offers = lower.select("v", "near").unionByName(lower.select(F.col("label").alias("v"), "near"))
        best = offers.groupBy("v").agg(F.min("near").alias("near"))
        moved = now.join(best, "v", "left").select("v", F.least("label", F.coalesce("near", "label")).alias("label"),
                                                   F.coalesce(F.col("near") < F.col("label"), F.lit(False)).alias("new"))
        moved = stored(moved, "labels")
        if moved.filter("new").isEmpty():
            return now
        up = moved.select(F.col("v").alias("label"), F.col("label").alias("higher"))
        now = stored(moved.join(up, "label", "left").select("v", F.coalesce("higher", "label").alias("label")), "labels")
