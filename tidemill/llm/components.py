"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import forget, keep


def components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """``node, comp``: each node of ``links`` with the least node that it reaches; a kept table.

    Each round gives a node the least label among its neighbours' and then that
    label's own label, so labels travel twice as far with every round. Joins are
    on nodes, which adaptive execution splits where one node has most links. Only
    the last round's table stays on disk.
    """
    edges = links.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t")
    edges = keep(edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct(), "edges")
    labels = keep(edges.groupBy("s").agg(F.min("t").alias("m")).select(F.col("s").alias("node"), F.least("s", "m").alias("comp"), F.lit(None).cast("long").alias("was")), "labels")
    while True:
        near = edges.join(labels, edges.s == labels.node).groupBy("t").agg(F.min("comp").alias("m"))
        new = labels.join(near, labels.node == near.t, "left").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("c"))
        far = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        new = keep(new.join(far, F.col("c") == F.col("n2"), "left").select("node", F.least("c", "c2").alias("comp"), "was"), "labels")
        forget(labels)
        labels = new
        if not new.where("comp <> was").limit(1).count():
            forget(edges)
            return labels
