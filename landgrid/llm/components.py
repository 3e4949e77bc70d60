"""Connected components of a link table by random-order contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.session import cut_lineage


def release(df: DataFrame) -> None:
    """Let the driver collect the plans of past rounds, whose shuffles and broadcasts Spark then cleans up."""
    df.sparkSession.sparkContext._jvm.System.gc()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(src long, dst long)`` -> ``(node long, root long)`` for every node that has a link.

    Each round points every node at the neighbour (or itself) that comes first in a fresh random order, follows that
    pointer once more, and replaces the links by links between the nodes pointed at. A round removes a constant share
    of the nodes in expectation, so the rounds grow with the logarithm of the largest component. Links, pointers and
    labels stay distributed; each round is cut with a reliable checkpoint. Null ends and self links are ignored.
    """
    links = cut_lineage(
        links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    )
    labels, turn = None, 0
    while not links.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = (
            links.union(links.select("dst", "src"))
            .groupBy(F.col("src").alias("node"))
            .agg(F.min(order("dst")).alias("best"))
            .select("node", F.least("best", order("node"))["v"].alias("next"))
        )
        jump = first.select(F.col("node").alias("mid"), F.col("next").alias("far"))
        step = cut_lineage(first.join(jump, first.next == jump.mid).select("node", F.col("far").alias("up")))
        a = step.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = step.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        links = cut_lineage(
            links.join(a, "src").join(b, "dst").where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        )
        if labels is None:
            labels = step.select("node", F.col("up").alias("root"))
        else:
            up = step.select(F.col("node").alias("root"), "up")
            labels = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = cut_lineage(labels)
        turn += 1
        release(labels)
    return labels if labels is not None else links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
