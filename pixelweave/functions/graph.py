"""Connected components of an edge table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every end of an edge; root is the least vertex of its component.

    Each round takes the least label among a vertex's neighbours and then the
    label of that label, so the number of rounds grows with the logarithm of the
    longest path. Every round is staged; only the count of changes is read.
    """
    both = staged(
        edges.select(F.col(a).alias("v"), F.col(b).alias("w")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w"))).where("v <> w").distinct(),
        "edges",
    )
    labels = staged(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        hooked = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("far"))
        moved = staged(hooked.join(jump, "next").select("v", F.col("root").alias("was"), F.least("next", "far").alias("root")), "labels")
        changed = moved.where("was <> root").limit(1).count()
        labels = moved.select("v", "root")
        if not changed:
            return labels
