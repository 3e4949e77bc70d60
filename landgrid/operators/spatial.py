"""Grid-key spatial join and jobs on axis-aligned rectangles ``x0, y0, x1, y1`` with integer coordinates.

Both sides are dealt to the cells of a fixed grid that they cover and joined on the cell; the exact inequality comes
after, and a pair is kept only in the cell that holds the lower corner of its overlap, so no pair appears twice and no
second shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.session import written

BOX = ("x0", "y0", "x1", "y1")


def cover(boxes: DataFrame, g: int, grow: int = 0) -> DataFrame:
    """Rows for every grid cell ``kx, ky`` of size ``g`` that a box, grown by ``grow``, touches."""
    span = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor(({lo} - {grow}) / {g}) as bigint), cast(floor(({hi} + {grow}) / {g}) as bigint))"))
    return boxes.withColumn("kx", span("x0", "x1")).withColumn("ky", span("y0", "y1"))


def overlap_join(a: DataFrame, b: DataFrame, g: int, grow: int = 0, on: str = "true") -> DataFrame:
    """Pairs of boxes that touch or overlap within ``grow``; b's columns get the prefix ``b_``. ``on`` is an extra condition."""
    right = cover(b, g).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], "kx", "ky")
    pairs = cover(a, g, grow).join(right, ["kx", "ky"])
    touch = F.expr(f"b_x0 <= x1 + {grow} AND b_x1 >= x0 - {grow} AND b_y0 <= y1 + {grow} AND b_y1 >= y0 - {grow}")
    home = F.expr(f"cast(floor(greatest(x0 - {grow}, b_x0) / {g}) as bigint) = kx AND cast(floor(greatest(y0 - {grow}, b_y0) / {g}) as bigint) = ky")
    return pairs.where(touch & home & F.expr(on)).drop("kx", "ky")


def overlap_area() -> Column:
    return F.expr("greatest(least(x1, b_x1) - greatest(x0, b_x0), 0) * greatest(least(y1, b_y1) - greatest(y0, b_y0), 0)")


def overlapping_pairs(parcels: DataFrame, g: int = 128) -> DataFrame:
    """Each unordered pair of parcels with a positive overlap area once."""
    pairs = overlap_join(parcels.select("parcel_id", *BOX), parcels.select("parcel_id", *BOX), g, on="parcel_id < b_parcel_id")
    return pairs.withColumn("area", overlap_area()).where("area > 0")


def contains_point(points: DataFrame, boxes: DataFrame, g: int) -> DataFrame:
    """Pairs of a point ``px, py`` and a box that holds it, half open, so that a partition owns each point once."""
    keyed = points.withColumns({"kx": F.expr(f"cast(floor(px / {g}) as bigint)"), "ky": F.expr(f"cast(floor(py / {g}) as bigint)")})
    right = cover(boxes, g).select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns], "kx", "ky")
    return keyed.join(right, ["kx", "ky"]).where("px >= b_x0 AND px < b_x1 AND py >= b_y0 AND py < b_y1").drop("kx", "ky")


def clip(boxes: DataFrame, w: int, s: int, e: int, n: int) -> DataFrame:
    """Boxes cut to a window; what lies outside goes."""
    inside = boxes.where(f"x1 > {w} AND x0 < {e} AND y1 > {s} AND y0 < {n}")
    return inside.withColumns({"x0": F.greatest("x0", F.lit(w)), "y0": F.greatest("y0", F.lit(s)), "x1": F.least("x1", F.lit(e)), "y1": F.least("y1", F.lit(n))})


def is_sliver(area: Column, perimeter: Column, width: float = 1.5, most: float = 100.0) -> Column:
    """Thin and small, or degenerate."""
    return (area <= 0) | ((area / perimeter < width) & (area < most))


def resolve_overlaps(parcels: DataFrame, g: int = 128) -> DataFrame:
    """Cells of overlap that each parcel gives up, as ``(parcel_id, area, lost)``.

    Of a pair the smaller parcel loses the overlap (equal areas: the higher id). A parcel's losses are the union of all
    its overlaps, measured by cutting them along each other's x edges and adding the covered y spans of every strip.
    """
    pairs = overlapping_pairs(parcels, g).select(
        "parcel_id", "b_parcel_id", F.expr("(x1 - x0) * (y1 - y0)").alias("a"), F.expr("(b_x1 - b_x0) * (b_y1 - b_y0)").alias("b"),
        F.greatest("x0", "b_x0").alias("x0"), F.greatest("y0", "b_y0").alias("y0"), F.least("x1", "b_x1").alias("x1"), F.least("y1", "b_y1").alias("y1"),
    )
    loser = F.when(F.expr("a < b OR (a = b AND parcel_id > b_parcel_id)"), F.col("parcel_id")).otherwise(F.col("b_parcel_id"))
    cuts = pairs.select(loser.alias("parcel_id"), *BOX)
    edges = cuts.groupBy("parcel_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("x0", "x1"))))).alias("xs"))
    strips = edges.select("parcel_id", F.explode(F.expr("transform(sequence(1, size(xs) - 1), i -> struct(xs[i - 1] AS a, xs[i] AS b))")).alias("s"))
    spans = strips.join(cuts, "parcel_id").where("x0 <= s.a AND x1 >= s.b").select("parcel_id", F.expr("s.a").alias("a"), F.expr("s.b").alias("b"), "y0", "y1")
    before = F.max("y1").over(Window.partitionBy("parcel_id", "a").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.col("y0"))), F.lit(0))
    lost = spans.withColumn("area", (F.col("b") - F.col("a")) * new).groupBy("parcel_id").agg(F.sum("area").alias("lost"))
    areas = parcels.select("parcel_id", F.expr("(x1 - x0) * (y1 - y0)").alias("area"))
    return areas.join(lost, "parcel_id", "left").select("parcel_id", "area", F.coalesce("lost", F.lit(0)).alias("lost"))


def seam_candidates(parcels: DataFrame, line: int, g: int = 128, grow: int = 2) -> DataFrame:
    """Pairs of parcels of different blocks with the same label, close to each other, both near a block line (every ``line`` metres)."""
    near = F.expr(f"least(x0 % {line}, {line} - x1 % {line}, y0 % {line}, {line} - y1 % {line}) <= 3")
    some = parcels.where(near).select("parcel_id", "block_id", "pred_class", *BOX)
    return overlap_join(some, some, g, grow, "parcel_id < b_parcel_id AND block_id <> b_block_id AND pred_class = b_pred_class").select("parcel_id", "b_parcel_id")


def linked_groups(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(node, root)``, root the smallest node of each connected group.

    Each round takes the smallest label among a node's neighbours and jumps to that label's own. Labels are written each round: the
    sizes that a checkpoint's plan keeps would be multiplied by every join, to numbers that fill the driver. Merge joins by
    name, because files of such numbers are so small that the plan would broadcast their many rows.
    """
    links = written(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = written(links.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = links.join(labels.withColumnsRenamed({"node": "v", "root": "other"}).hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(near.hint("merge"), "node").select("node", F.least("root", "other").alias("next"), "root")
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = written(hooked.join(jump.hint("merge"), "next").select("node", F.least("far", "next").alias("new"), "root"))
        labels = new.select("node", F.col("new").alias("root"))
        if new.where("new <> root").isEmpty():
            return labels


def merge_slivers(parcels: DataFrame, reach: int = 1, g: int = 128) -> DataFrame:
    """One round of sliver elimination: ``(parcel_id, target)``, the largest parcel near each sliver that is no sliver itself
    (ties to the lower id); null for a sliver without one."""
    flagged = parcels.select("parcel_id", *BOX, is_sliver(F.expr("(x1 - x0) * (y1 - y0)"), F.expr("2 * (x1 - x0 + y1 - y0)")).alias("sliver"))
    flagged = flagged.withColumn("area", F.expr("(x1 - x0) * (y1 - y0)"))
    slivers, rest = flagged.where("sliver"), flagged.where("NOT sliver")
    # Area and id as one number: pairs are hashed to their sliver as they come, while the maximum of a struct would sort them all first.
    rank = F.expr("cast(area AS decimal(19, 0)) * 10000000000000000000BD - parcel_id")
    near = overlap_join(slivers.select("parcel_id", *BOX), rest.select("parcel_id", rank.alias("rank"), *BOX), g, reach)
    best = near.groupBy("parcel_id").agg(F.max_by("b_parcel_id", "b_rank").alias("target"))
    return slivers.select("parcel_id").join(best, "parcel_id", "left")


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of the boxes of each key on unit cells: rows of y spans per unit of x, merged by running maxima."""
    strips = boxes.select(*keys, F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"), "y0", "y1")
    before = F.max("y1").over(Window.partitionBy(*keys, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.col("y0"))), F.lit(0))
    return strips.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("area"))
