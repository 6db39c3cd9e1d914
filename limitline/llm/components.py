"""Classes of linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, for links (a, b).

    Every round, a node takes the smallest root among its neighbours' and then that root's
    root, so distances halve or better. Rounds end when nothing changes; each is stored.
    Roots reach a node's neighbours through partial minima, so a node may have any number.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("r"))
        hooked = near.join(roots, F.col("n") == F.col("node")).select(
            "node", F.col("root").alias("old"), F.least("root", "r").alias("up")
        )
        above = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = stored(
            hooked.join(above, "up", "left").select(
                "node", F.least("up", F.coalesce("top", "up")).alias("root"), "old"
            ),
            "roots",
        )
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
