"""Connected components of a link table, by minimum labels with pointer jumping; every round is a few shuffles of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Salts by which the rows of one label are dealt out: one component may hold most nodes.
SALTS = 32


def components(links: DataFrame) -> DataFrame:
    """links (a, b), undirected -> (node, component), the smallest node reachable; a row for each node that has a link.

    Rounds grow with the logarithm of a component's diameter, because labels jump along labels. Nulls are left out; repeated links do no harm.
    """
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        # The least label of the neighbours, then that label's own label.
        labels_now = labels.select("node", "component")
        near = edges.join(labels_now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels_now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
        lower = written(lower, "labels")
        # Only labels that are no longer their own: a finished component's isn't among them. Each stands once for each salt.
        moved = lower.where(F.col("component") < F.col("node")).select(F.col("node").alias("component"), F.col("component").alias("next"))
        jump = lower.select("component").distinct().join(moved, "component").select("component", "next", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        jumped = written(lower.join(jump, ["component", "salt"], "left").select("node", F.coalesce("next", "component").alias("component"), "old"), "labels")
        discard(labels, lower)
        labels = jumped
        if labels.where(F.col("old") != F.col("component")).isEmpty():
            discard(edges)
            out = labels.select("node", "component")
            out.shared_path = labels.shared_path
            return out
